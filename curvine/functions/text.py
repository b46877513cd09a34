"""Text preparation: filters, token ids, prompts, term weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import MODULUS, id_hash, id_hash_values
from curvine.plans.bounded import broadcast_if_small
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.session import checkpoint

# --- filters and pairs ---------------------------------------------------------


def long_enough(text, minimum: int) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.length(text) >= minimum, F.lit(False))


def code_doc_filter(code, doc, min_code: int = 50, min_doc: int = 10) -> Column:
    """Both texts present, code longer than ``min_code`` and documentation than ``min_doc``."""
    code, doc = (F.col(c) if isinstance(c, str) else c for c in (code, doc))
    return F.coalesce((F.length(code) > min_code) & (F.length(doc) > min_doc), F.lit(False))


# Column names under which the two sides of a pair are known.
SOURCE_NAMES = ("original", "complex", "source", "src", "original_text")
TARGET_NAMES = ("simple", "simplified", "target", "tgt", "simple_text")
SIMPLIFY_PREFIX = "Simplify this sentence: "


def detect_pair(columns: list[str]) -> tuple[str, str]:
    """Names of the source and target column; the first two columns when none is known."""
    source = [c for c in columns if c.lower() in SOURCE_NAMES]
    target = [c for c in columns if c.lower() in TARGET_NAMES]
    if source and target:
        return source[-1], target[-1]
    return columns[0], columns[1]


def pair_prepare(df: DataFrame, *, keep: list[str] = (), prefix: str = SIMPLIFY_PREFIX, task: str = "simplification") -> DataFrame:
    """Trimmed, prefixed pairs ``(src, tgt, task)`` without blank sides."""
    source, target = detect_pair([c for c in df.columns if c not in keep])
    strip = r"^\s+|\s+$"
    rows = df.select(*keep, F.regexp_replace(source, strip, "").alias("s"), F.regexp_replace(target, strip, "").alias("tgt"))
    rows = rows.filter((F.col("s") != "") & (F.col("tgt") != ""))
    return rows.select(*keep, F.concat(F.lit(prefix), F.col("s")).alias("src"), "tgt", F.lit(task).alias("task"))


# --- token ids -------------------------------------------------------------------


def clamp_ids(ids, vocab: int) -> Column:
    """Ids beyond the vocabulary become its last id, negative ones 0."""
    return F.transform(ids, lambda t: F.greatest(F.least(t, F.lit(vocab - 1)), F.lit(0)))


def pad_or_cut(ids, length: int, pad: int = 0) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), missing))


# Ids are spread by this factor before the position of a token is added.
POSITIONS = 1_000_003


def mask_tokens(id_col, ids, *, mask_id: int, vocab: int, special: list[int] = (), rate: float = 0.15, seed: int = 0) -> tuple[Column, Column]:
    """Inputs and labels for masked-token training.

    A token is chosen with probability ``rate``; of the chosen, 80 % become the
    mask, 10 % a random id, 10 % stay. Labels are -100 elsewhere. The choice
    depends only on the row id, the position and the seed.
    """
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    ids = F.col(ids) if isinstance(ids, str) else ids

    def draw(i, salt, buckets):
        return F.pmod(id_hash(id_col.cast("bigint") * POSITIONS + i, 10 * seed + salt), F.lit(buckets))

    def chosen(t, i):
        plain = ~t.isin(*special) if special else F.lit(True)
        return plain & (draw(i, 1, 1_000_000) < int(rate * 1_000_000))

    def replace(t, i):
        kind = draw(i, 2, 10)
        swapped = F.when(kind < 8, F.lit(mask_id)).when(kind == 8, draw(i, 3, vocab).cast("int")).otherwise(t)
        return F.when(chosen(t, i), swapped).otherwise(t)

    return F.transform(ids, replace), F.transform(ids, lambda t, i: F.when(chosen(t, i), t).otherwise(F.lit(-100)))


# Rows of a batch that leaves a task, and tokens hashed at once.
MASK_ROWS, MASK_TOKENS = 256, 1 << 18


def mask_texts(docs: DataFrame, id_col: str, text_col: str, *, mask_id: int, vocab: int, special: list[int] = (), rate: float = 0.15, seed: int = 0) -> DataFrame:
    """``(id_col, input_ids, labels)``: ``mask_tokens`` over the code points of whole texts, in one pass with arrays.

    A null text has null ids and labels; without an id no token is chosen.
    """

    def masked(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = (id_hash_values(place, 10 * seed + 1) % 1_000_000 < int(rate * 1_000_000)) & ~np.isin(ids, special)
        picked = place[chosen]
        kind = id_hash_values(picked, 10 * seed + 2) % 10
        inputs, labels = ids.copy(), np.full(len(ids), -100, np.int32)
        labels[chosen] = ids[chosen]
        drawn = np.where(kind == 8, id_hash_values(picked, 10 * seed + 3) % vocab, ids[chosen])
        inputs[chosen] = np.where(kind < 8, mask_id, drawn)
        return inputs, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MASK_ROWS):
                batch = whole.slice(at, MASK_ROWS)
                texts, known = batch.column(text_col).to_pylist(), batch.column("_id").is_valid().to_numpy(zero_copy_only=False)
                lengths = np.array([len(t or "") for t in texts], np.int64)
                ends = np.cumsum(lengths)
                ids = np.frombuffer("".join([t or "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.int32)
                # the remainder of the id first, so that the product stays inside 64 bits
                base = batch.column("_id").fill_null(0).to_numpy() % MODULUS * POSITIONS - (ends - lengths)
                row = np.repeat(np.arange(len(texts)), lengths)
                inputs, labels = ids.copy(), np.full(len(ids), -100, np.int32)
                for first in range(0, len(ids), MASK_TOKENS):
                    part = slice(first, first + MASK_TOKENS)
                    use = np.flatnonzero(known[row[part]]) + first
                    inputs[use], labels[use] = masked(ids[use], base[row[use]] + use)
                # a null offset makes a null list
                offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append([t is None for t in texts], False))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (inputs, labels)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *lists], names=[id_col, "input_ids", "labels"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.col(id_col).cast("bigint").alias("_id")).mapInArrow(run, f"`{id_col}` {kind}, input_ids array<int>, labels array<int>")


# --- prompts ---------------------------------------------------------------------------

# The layout of a prompt per task, with the text fields in braces.
TEMPLATES = {
    "sst2": ("Review: {sentence}\nSentiment:", " {label}\n"),
    "subj": ("Input: {sentence}\nType:", " {label}\n"),
    "agnews": ("input: {sentence}\ntype:", " {label}\n"),
    "cb": ("premise: {premise}\nhypothesis: {hypothesis}\nprediction:", " {label}\n"),
    "cr": ("Review: {sentence}\nSentiment:", " {label}\n"),
    "dbpedia": ("input: {sentence}\ntype:", " {label}\n"),
    "mpqa": ("Review: {sentence}\nSentiment:", " {label}\n"),
    "mr": ("Review: {sentence}\nSentiment:", " {label}\n"),
    "rte": ("premise: {sentence_1}\nhypothesis: {sentence_2}\nprediction:", " {label}\n"),
    "sst5": ("Review: {sentence}\nSentiment:", " {label}\n"),
    "trec": ("Question: {sentence}\nType:", " {label}\n"),
}

# The word that stands for each label of a task, labels in order of their class number.
VERBALIZERS = {
    "sst2": {"0": "negative", "1": "positive"},
    "subj": {"0": "subjective", "1": "objective"},
    "agnews": {"1": "world", "2": "sports", "3": "business", "4": "technology"},
    "cb": {"contradiction": "false", "entailment": "true", "neutral": "neither"},
    "cr": {"0": "negative", "1": "positive"},
    "dbpedia": {
        "1": "company", "2": "school", "3": "artist", "4": "athlete", "5": "politics", "6": "transportation", "7": "building", "8": "nature",
        "9": "village", "10": "animal", "11": "plant", "12": "album", "13": "film", "14": "book",
    },
    "mpqa": {"0": "negative", "1": "positive"},
    "mr": {"0": "negative", "1": "positive"},
    "rte": {"not_entailment": "false", "entailment": "true"},
    "sst5": {"0": "terrible", "1": "bad", "2": "okay", "3": "good", "4": "great"},
    "trec": {"0": "description", "1": "entity", "2": "expression", "3": "human", "4": "location", "5": "number"},
}


def render(template: str, fields: dict[str, str]) -> Column:
    """Fill the braces of a template with columns."""
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(F.col(fields[name]).cast("string"), F.lit("")))
    return F.concat(*parts)


def prompt(task: str, fields: dict[str, str], mode: str = "inference") -> Column:
    """A query prompt, or with ``mode="train"`` a demonstration that ends in its label word."""
    head, tail = TEMPLATES[task]
    return render(head + (tail if mode == "train" else ""), fields)


def join_demonstrations(demos: DataFrame, group: list[str], text_col: str, *order: str) -> DataFrame:
    """Demonstrations of a group one after the other, each followed by a line break.

    A group is the fixed few shots of one prompt.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(text_col).alias("_text"))))
    joined = F.array_join(F.transform(packed, lambda d: F.concat(d["_text"], F.lit("\n"))), "")
    return demos.groupBy(*group).agg(joined.alias("demonstrations"))


def label_words(df: DataFrame, task: str, label_col: str, verbalizers: dict[str, str] | None = None) -> DataFrame:
    """Add the class number and the word of each label; unknown labels get NULL."""
    words = verbalizers or VERBALIZERS[task]
    table = df.sparkSession.createDataFrame([(k, i, w) for i, (k, w) in enumerate(words.items())], f"{label_col} string, label_id int, label_word string")
    return df.withColumn(label_col, F.col(label_col).cast("string")).join(F.broadcast(table), label_col, "left")


# --- term weights ---------------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]{2,}"
# Bytes of texts whose term rows a task groups at once.
TERM_BYTES = 4 << 20


def tfidf(df: DataFrame, *, id_col: str, text_col: str, stop_words: list[str] | None = None, max_terms: int | None = None) -> DataFrame:
    """Normalised term weights ``(id, term, weight)`` of all terms, or of the ``max_terms`` most frequent ones.

    Weight = count * (ln((1 + n) / (1 + df)) + 1), each row scaled to length 1. All
    terms are joined with frequent ones kept out of the shuffle; a vocabulary bounded
    by ``max_terms`` is broadcast if the bound is small.
    """
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))
    stops = F.array(*[F.lit(w) for w in stop_words]) if stop_words else None
    kept = F.filter(tokens, lambda t: ~F.array_contains(stops, t)) if stop_words else tokens
    # as many partitions as the texts need, so that what a task groups does not grow with the table
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TERM_BYTES))
    # whole texts are shuffled by id once; the longer term rows are grouped in place, and
    # written down, as the vocabulary and both ways of the lookup read them
    terms = df.repartition(tasks, id_col).select(id_col, F.explode(kept).alias("term"))
    counts = checkpoint(terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    vocab = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_terms is not None:
        vocab = vocab.orderBy(F.col("total").desc(), "term").limit(max_terms)
    idf = vocab.select("term", "df", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    if max_terms is not None:
        with_idf = counts.join(broadcast_if_small(idf, max_terms), "term")
    else:
        # terms in very many texts; a text holds each once, so with t terms a text at most t * MAX_HOT_KEYS of them
        with_idf = join_lookup(counts, idf, "term", max(1000, n // MAX_HOT_KEYS), "df")
    weighted = with_idf.select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w")).repartition(tasks, id_col)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("w") / norm).alias("weight"))


# --- vectors from tokens -----------------------------------------------------------------------


def masked_mean_pool(vectors, mask) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is set; zeros when none is."""
    vectors, mask = (F.col(c) if isinstance(c, str) else c for c in (vectors, mask))
    weights = F.transform(mask, lambda m: m.cast("double"))
    weighted = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    return V.let(F.greatest(V.total(weights), F.lit(1e-9)), lambda n: V.mean_of_rows(weighted, n))


def center_and_cap(df: DataFrame, *, per_class: int, id_col: str, class_col: str, vec_col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Vectors minus the mean vector of ``fit_on`` (default: all rows), one-hot labels, few rows per class.

    The cap is the feature: a class keeps its first ``per_class`` rows by id.
    """
    from curvine.operators.cluster import group_means
    from curvine.plans.bounded import collect_bounded
    from curvine.plans.ranking import top_k_within

    source = (fit_on if fit_on is not None else df).withColumn("_one", F.lit(0))
    mean = group_means(source, ["_one"], vec_col, "_mean").select("_mean").scalar()
    classes = sorted(r[0] for r in collect_bounded(df.select(class_col).distinct()))
    onehot = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.when(c == F.col(class_col), 1.0).otherwise(0.0))
    capped = top_k_within(df, [class_col], [F.col(id_col)], per_class).drop("rank")
    return capped.withColumn("_mean", mean).select(
        id_col, class_col, F.zip_with(V.doubles(vec_col), "_mean", lambda x, m: x - m).alias("centered"), onehot.alias("onehot")
    )
