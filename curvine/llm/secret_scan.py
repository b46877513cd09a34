"""Secret scans with DataFrame expressions only: certain patterns, and linked parts of a credential.

Certain spans are matches of fixed patterns. Weak parts (a dense random-looking word, an
account name, an address) prove nothing alone. An interval join of the parts inside
scopes links them: a weak secret is reported only near an access identifier, and the
address only near both. Scopes are windows of characters; the join goes by the numbers
of all windows that one part covers and the other reaches, and a window has room for few
parts, so no text makes many pairs, whatever its length.

Spark has no function for the positions of all matches, so a text is split at the
matches, and the positions are running totals of the lengths of gaps and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from curvine.llm.common import text_of
from curvine.session import checkpoint

SCOPE = 400

# Certain patterns as (kind, pattern, group to measure, characters needed, cheap test).
CERTAIN = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    # a match takes all it can, so asking for the length in the pattern finds the same spans without the short ones
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
]
# Weak parts, in the same form; a key is of any length, in either alphabet of base 64.
WEAK = [
    ("account", r"(?i:client_?id|access_?key_?id|account|user_?name|login|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]+", 0, 0, r"(?i:client_?id|access_?key_?id|account|user_?name|login|user)[\"']?\x20*[:=]"),
    ("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?!=)", 0, 32, r"[A-Za-z0-9+/_-]{32}"),
    ("endpoint", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.-]*", 0, 0, r"[a-z0-9+]://"),
]
KINDS = [k for k, *_ in CERTAIN + WEAK]
KEY = "row_key"


def _matches(pattern: str, group: int, test: str) -> Column:
    """Every match with the text before it: ``array<struct<gap, match, measured>>``; null if the cheap test fails."""
    text = F.col("_text")
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), all_of(0).alias("match"), all_of(group).alias("measured"))
    lengths = F.transform(found, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("match"), F.length(m["measured"]).alias("measured")))
    return F.when(text.rlike(test), F.filter(lengths, lambda m: m["match"].isNotNull()))


def _row_key() -> Column:
    """Rows with the same id and text share their spans."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_of()), 256)


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(row_key, kind, start, end)``: certain spans, and the weak ones linked with complementary parts.

    Positions count code points, the end is exclusive. ``row_key`` stands for id and text.
    """
    specs = CERTAIN + WEAK

    def hits_of(kind: str, pattern: str, group: int, test: str) -> Column:
        named = lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), m["match"].alias("match"), m["measured"].alias("measured"))
        none = F.array().cast("array<struct<gap:int,match:int,measured:int>>")
        return F.transform(F.coalesce(_matches(pattern, group, test), none), named)

    hits = F.flatten(F.array(*[hits_of(k, p, g, t) for k, p, g, _, t in specs]))
    rows = docs.select(text_of().alias("_text"), _row_key().alias(KEY)).withColumn("hits", hits).filter(F.size("hits") > 0)
    each = rows.select(KEY, F.explode("hits").alias("h")).select(KEY, "h.*").dropDuplicates([KEY, "kind", "nth"])
    sofar = Window.partitionBy(KEY, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.element_at(F.create_map(*[x for k, _, _, n, _ in specs for x in (F.lit(k), F.lit(n))]), F.col("kind"))
    # few rows, which the parts below read several times
    spans = checkpoint(
        each.withColumn("end", F.sum(F.col("gap") + F.col("match")).over(sofar))
        .filter(F.col("measured") >= least)
        .select(KEY, "kind", (F.col("end") - F.col("match")).alias("start"), "end")
    )
    return spans.filter(F.col("kind").isin([k for k, *_ in CERTAIN])).unionByName(_linked(spans, scope))


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that have their complement within ``scope`` characters."""
    # texts without a weak part leave before any join
    has = spans.groupBy(KEY).agg(F.collect_set("kind").alias("kinds"))
    both = has.filter(F.arrays_overlap("kinds", F.array(F.lit("access"), F.lit("account"))) & F.array_contains("kinds", "key")).select(KEY)
    parts = spans.filter(F.col("kind").isin(["access", "account", "key", "endpoint"])).join(both, KEY, "left_semi")

    def windows(of: DataFrame, reach: int) -> DataFrame:
        """One row for each window between ``reach`` characters before a part and as many behind it."""
        ends = of.withColumn("first", F.expr(f"greatest(start - {reach}, 0) div {scope}"))
        return ends.withColumn("scope", F.explode(F.sequence("first", F.expr(f"(end + {reach}) div {scope}"))))

    near = windows(parts, scope)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of parts at most a scope apart, each from the first window both have."""
        a, b = left.alias("a"), right.alias("b")
        close = (F.col("a.start") <= F.col("b.end") + scope) & (F.col("b.start") <= F.col("a.end") + scope)
        return a.join(b, (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.scope") == F.greatest("a.first", "b.first")) & close)

    pair = beside(windows(parts.filter(F.col("kind").isin(["access", "account"])), 0), near.filter("kind = 'key'"))
    linked = pair.select(
        F.col(f"a.{KEY}").alias(KEY),
        F.explode(F.array(F.struct("a.kind", "a.start", "a.end"), F.struct("b.kind", "b.start", "b.end"))).alias("s"),
    ).select(KEY, "s.*").distinct()
    keys = windows(linked.filter("kind = 'key'"), 0)
    places = beside(keys, near.filter("kind = 'endpoint'")).select(F.col(f"b.{KEY}").alias(KEY), "b.kind", "b.start", "b.end").distinct()
    return linked.filter("kind <> 'access'").unionByName(places)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per input row.

    ``spans`` joins ``kind:start:end`` of all spans by start, then kind; ``base_sha256``
    is the digest of the same string over the certain kinds only. A null text is
    empty and has no span; null and repeated ids and repeated rows each keep their
    row; an empty table gives no rows; other columns are not read.
    """
    found = _with_spans(docs.select("doc_id", "text"), scope)
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k, *_ in CERTAIN]
    return found.select("doc.doc_id", *counts, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _with_spans(docs: DataFrame, scope: int) -> DataFrame:
    """``(doc, n_..., base_sha256, spans, list)``: the row as one struct, so that none of its names meets ours; null without spans."""
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    found = find_spans(docs, scope).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("list"))
    base = F.filter("list", lambda s: s["order"] < len(CERTAIN))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("list", lambda s: s["kind"] == k)).cast("bigint")
    digest = found.select(KEY, *[count(k).alias(f"n_{k}") for k, *_ in CERTAIN], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("list")).alias("spans"), "list")
    return docs.select(F.struct("*").alias("doc"), _row_key().alias(KEY)).join(digest, KEY, "left").drop(KEY)


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark.

    Columns stay as they are, whatever their names, but ``n_chars``, where it is a number,
    follows the text of a changed row. A null text stays null; null and repeated ids and
    repeated rows each keep their row; an empty table gives no rows.
    """
    rows = _with_spans(docs, scope)
    text = F.col("doc.text")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("upto"))
    # spans come by start: copy what lies before, skip what is covered already
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["upto"], acc["done"])
        .otherwise(F.concat(acc["done"], F.substr(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")), F.lit(mark)))
        .alias("done"),
        F.greatest(acc["upto"], s["end"]).alias("upto"),
    )
    clean = F.aggregate("list", start, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["upto"] + 1).cast("int"))))
    changed = F.col("list").isNotNull()
    columns = {"text": F.when(changed, clean).otherwise(text)}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        columns["n_chars"] = F.when(changed, F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
