"""Evaluation aggregates; every function returns a small DataFrame."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions import vectors as V
from curvine.plans.blocks import BLOCK_ROWS, block_join
from curvine.plans.ranking import running_totals

TINY = 2.220446049250313e-16  # spacing of doubles at 1, added inside logarithms


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_agreement(spaces: dict[str, DataFrame], labels: DataFrame, id_col="vec_id", label_col="label") -> DataFrame:
    """Share of each query's neighbours that carry its own label, per feature space."""
    own = labels.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("own"))
    theirs = labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("theirs"))
    shares = []
    for name, near in spaces.items():
        rows = near.select("query_id", "neighbor_id").join(theirs, "neighbor_id").join(own, "query_id")
        share = F.try_divide(F.count_if(F.col("own") == F.col("theirs")).cast("double"), F.count(F.lit(1)))
        shares.append(rows.groupBy("query_id").agg(share.alias(f"same_label_{name}")))
    return reduce(lambda a, b: a.join(b, "query_id"), shares)


# --- classification ----------------------------------------------------------------


def confusion_matrix(df: DataFrame, pred="pred", label="label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _per_class(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Hits, truths and predictions of each class, from the small table of counts."""
    cells = confusion_matrix(df, pred, label)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")),
        )
    ).alias("x")
    return cells.select(sides).groupBy("x.c").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.hit").alias("hit"))


def classification_report(df: DataFrame, pred="pred", label="label") -> DataFrame:
    """Accuracy, macro F1, precision and recall, and the mean of accuracy and F1; 0/0 counts as 0."""
    per = _per_class(df, pred, label)
    precision, recall = _ratio(F.col("hit"), F.col("p")), _ratio(F.col("hit"), F.col("t"))
    scores = per.select("t", "hit", precision.alias("pr"), recall.alias("re"))
    f1 = _ratio(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re"))
    out = scores.agg(
        F.sum("t").alias("n"), _ratio(F.sum("hit"), F.sum("t")).alias("acc"), F.avg(f1).alias("f1"), F.avg("pr").alias("precision"), F.avg("re").alias("recall")
    )
    return out.withColumn("acc_and_f1", (F.col("acc") + F.col("f1")) / 2)


def matthews(df: DataFrame, pred="pred", label="label") -> DataFrame:
    """Matthews correlation for any number of classes."""
    per = _per_class(df, pred, label)
    sums = per.agg(
        F.sum("hit").cast("double").alias("c"), F.sum("t").cast("double").alias("s"), F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"),
        F.sum(F.col("p").cast("double") * F.col("p")).alias("pp"), F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"),
    )
    s = F.col("s")
    return sums.select(_ratio(F.col("c") * s - F.col("tp"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))).alias("mcc"))


def _average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the mean of the ranks their rows take."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, [F.col(value)], {"upto": F.col("n")})
    return run.select(value, (F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(f"rank_{value}"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation and their mean."""
    rows = df.select(x, y)
    ranked = rows.join(_average_ranks(rows, x), x).join(_average_ranks(rows, y), y)
    out = ranked.agg(F.corr(x, y).alias("pearson"), F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))
    return out.withColumn("mean", (F.col("pearson") + F.col("spearman")) / 2)


TASK_METRICS = {
    # fixed values: which measure a task is judged by
    "cola": "mcc", "sst-2": "acc", "mrpc": "acc_and_f1", "sts-b": "correlation", "qqp": "acc_and_f1", "mnli": "acc", "mnli-mm": "acc",
    "qnli": "acc", "rte": "acc", "wnli": "acc", "hans": "acc", "ag_news": "macro_f1", "dbpedia": "macro_f1", "trec-6": "macro_f1",
    "imdb": "macro_f1", "pubmed": "macro_f1", "nli": "macro_f1", "sentiment": "macro_f1",
}


def task_metrics(df: DataFrame, task: str, pred="pred", label="label") -> DataFrame:
    """The measures by which a task is judged."""
    kind = TASK_METRICS[task]
    if kind == "mcc":
        return matthews(df, pred, label)
    if kind == "correlation":
        return correlations(df, pred, label)
    report = classification_report(df, pred, label)
    if kind == "acc":
        return report.select("acc")
    if kind == "macro_f1":
        return report.select("acc", "f1", "acc_and_f1")
    positive = df.agg(
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("acc"), F.count_if((F.col(pred) == 1) & (F.col(label) == 1)).alias("tp"),
        F.count_if(F.col(pred) == 1).alias("p"), F.count_if(F.col(label) == 1).alias("t"),
    )
    f1 = _ratio(2 * F.col("tp"), F.col("p") + F.col("t"))
    return positive.select("acc", f1.alias("f1"), ((F.col("acc") + f1) / 2).alias("acc_and_f1"))


def topk_accuracy(df: DataFrame, ks: list[int], prob_col="probs", label="label") -> DataFrame:
    """Share of rows whose label is among the k largest scores; ties to the smaller class."""
    p = V.doubles(prob_col)
    own = F.element_at(p, (F.col(label) + 1).cast("int"))
    ahead = V.let(own, lambda mine: F.size(F.filter(p, lambda x, i: (x > mine) | ((x == mine) & (i < F.col(label))))))
    rows = df.select(ahead.alias("ahead"))
    return rows.agg(*[F.round(F.avg((F.col("ahead") < k).cast("double")), 6).alias(f"top{k}") for k in ks])


def calibration_bins(df: DataFrame, prob_col="probs", label="label", bins: int = 10) -> DataFrame:
    """Rows, mean confidence and accuracy per confidence bin (lo, hi]."""
    conf = F.array_max(V.doubles(prob_col))
    rows = df.select(conf.alias("conf"), (V.argmax(prob_col) == F.col(label)).cast("double").alias("hit"))
    per = rows.filter(F.col("conf") > 0).groupBy(F.ceil(F.col("conf") * bins).cast("bigint").alias("bin"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("conf"))


def ece(df: DataFrame, prob_col="probs", label="label", bins: int = 10) -> DataFrame:
    """Expected calibration error and refinement."""
    per = calibration_bins(df, prob_col, label, bins)
    acc = F.col("acc")
    return per.agg(
        _ratio(F.sum(F.abs(F.col("conf") - acc) * F.col("n")), F.sum("n")).alias("ece"), _ratio(F.sum(acc * (1 - acc) * F.col("n")), F.sum("n")).alias("refinement")
    )


def row_uncertainty(prob_col="probs") -> dict[str, Column]:
    """Per-row uncertainty: variation ratio, entropy in bits, deviation over the classes, margin."""
    p = V.doubles(prob_col)
    first, second = V.top2(p)
    mean = V.total(p) / F.size(p)
    var = V.let(mean, lambda m: V.total(F.transform(p, lambda x: (x - m) * (x - m)))) / F.size(p)
    return {
        "var_ratio": F.lit(1.0) - first,
        "entropy": -V.total(F.transform(p, lambda x: x * F.ln(x + F.lit(TINY)))) / F.ln(F.lit(2.0)),
        "std": F.sqrt(var),
        "margin": first - second,
    }


def row_scores(prob_col="probs", label="label", norm: str = "row", global_norm: Column | None = None) -> dict[str, Column]:
    """Per-row losses: log loss, Brier score as a mean over classes, spherical loss.

    ``norm="global"`` divides by the norm of all rows together, given as ``global_norm``.
    """
    p = V.doubles(prob_col)
    own = F.element_at(p, (F.col(label) + 1).cast("int"))
    diff = V.minus_onehot(p, label)
    length = V.l2_norm(p) if norm == "row" else global_norm
    return {
        "nll": -F.ln(own + F.lit(TINY)),
        "brier": V.dot(diff, diff) / F.size(p),
        "spherical": F.lit(1.0) - own / (length + F.lit(TINY)),
    }


def mean_and_var(df: DataFrame, columns: dict[str, Column], digits: int = 3) -> DataFrame:
    rows = df.select(*[c.alias(n) for n, c in columns.items()])
    return rows.agg(*[x for n in columns for x in (F.round(F.avg(n), digits).alias(f"{n}_mean"), F.round(F.var_pop(n), digits).alias(f"{n}_var"))])


def label_entropy(df: DataFrame, label="label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = counts.select((F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p"))  # one row per label
    return share.agg((-F.sum(F.col("p") * F.ln(F.col("p") + F.lit(TINY)))).alias("entropy"))


# --- retrieval -----------------------------------------------------------------------


def retrieval_ranks(pairs: DataFrame, *, id_col="vec_id", query_col="query", code_col="code", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rank of each query's own code among all codes: 1 + how many are more similar.

    A task reports one count per query, so nothing of the size of queries times
    codes is ever written.
    """
    ready = pairs.select(F.col(id_col).cast("bigint").alias("id"), V.l2_normalize(query_col, 1e-12).alias("q"), V.l2_normalize(code_col, 1e-12).alias("c"))
    left = ready.select("id", F.col("q").alias("vec"), V.dot("q", "c").alias("own"))
    right = ready.select("id", F.col("c").alias("vec"), F.lit(None).cast("double").alias("own"))

    def count(_group, queries, codes):
        q, c = kernels.matrix(queries.column("vec")), kernels.matrix(codes.column("vec"))
        q_ids, c_ids = queries.column("id").to_numpy(), codes.column("id").to_numpy()
        own = queries.column("own").to_numpy()
        above = np.zeros(len(q), np.int64)
        step = max(1, kernels.CHUNK_CELLS // max(1, len(c)))
        for start in range(0, len(q), step):
            rows = slice(start, start + step)
            lead = -kernels.near("ip", q[rows], c) - own[rows, None]
            lead[q_ids[rows, None] == c_ids[None, :]] = -np.inf
            above[rows] = (lead > kernels.SLACK).sum(axis=1)
            i, j = np.nonzero(np.abs(lead) <= kernels.SLACK)
            if len(i):
                exact = -kernels.exact("ip", q, c, i + start, j) > own[i + start]
                above[rows] += np.bincount(i[exact], minlength=len(above[rows]))
        return pa.table({"id": queries.column("id"), "above": pa.array(above)})

    counts = block_join(left, right, count, "id bigint, above bigint", False, block_rows)
    return counts.groupBy(F.col("id").alias(id_col)).agg((F.sum("above") + 1).cast("bigint").alias("rank"))


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"))


# --- text ----------------------------------------------------------------------------------


def words(col, lower: bool = True) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(col) if lower else col, r"\s+"), lambda w: w != "")


SOURCE, PREDICTION = -2, -1  # sides of a row beside its references 0, 1, ...


def _grams(df: DataFrame, id_col: str, texts: dict[int, Column], references: str, lower: bool, max_n: int = 4) -> DataFrame:
    """Every n-gram of every side: ``(id, refs, n, gram, side)``.

    The whole texts are shuffled by id once; every later step groups by the id
    first and stays in place, so the many times larger n-grams are never shuffled.
    """
    refs = F.transform(F.col(references), lambda r, i: F.struct(i.alias("side"), r.alias("text")))
    fixed = F.array(*[F.struct(F.lit(side).alias("side"), text.alias("text")) for side, text in texts.items()])
    rows = df.repartition(id_col).select(id_col, F.size(references).alias("refs"), F.explode(F.concat(fixed, refs)).alias("t"))
    rows = rows.select(id_col, "refs", "t.side", words(F.col("t.text"), lower).alias("g1"))
    for n in range(2, max_n + 1):
        rows = NGram(n=n, inputCol="g1", outputCol=f"g{n}").transform(rows)
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("grams")) for n in range(1, max_n + 1)]))
    return rows.select(id_col, "refs", "side", sizes.alias("g")).select(id_col, "refs", "side", "g.n", F.explode("g.grams").alias("gram"))


def _gram_counts(df: DataFrame, id_col: str, texts: dict[int, Column], references: str, lower: bool, max_n: int = 4) -> DataFrame:
    """Count of every n-gram per row and side: ``(id, refs, n, gram, side, k)``."""
    return _grams(df, id_col, texts, references, lower, max_n).groupBy(id_col, "refs", "n", "gram", "side").agg(F.count(F.lit(1)).alias("k"))


# Tokens counted at once; a row with more is a part of its own.
SARI_TOKENS = 200_000


def _gram_ids(codes: np.ndarray, side: np.ndarray, row: np.ndarray, max_n: int):
    """Per size of n-gram: the number of each n-gram, equal in a row where its words are, and the side it lies in."""
    kinds = int(codes.max(initial=0)) + 1
    gram = np.unique(row * kinds + codes, return_inverse=True)[1]
    for n in range(1, max_n + 1):
        if n > 1:
            whole = side[: len(side) - n + 1] == side[n - 1 :]
            at = np.flatnonzero(whole)
            full = np.full(len(side), -1)
            full[at] = np.unique(gram[at] * kinds + codes[at + n - 1], return_inverse=True)[1]
            gram = full
        here = np.flatnonzero(gram >= 0)
        yield gram[here], here
        if n < max_n:
            # a longer n-gram begins where one of this size does
            gram = np.where(gram >= 0, gram, 0)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def _sari_part(texts: pa.ListArray) -> np.ndarray:
    """SARI of rows of token lists: source, prediction, then the references."""
    sizes = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lists = texts.flatten()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    side = np.repeat(np.arange(len(row_of)), lengths)
    refs, total = sizes - 2, np.zeros(len(sizes))
    for gram, at in _gram_ids(codes, side, row_of[side], 4):
        grams = int(gram.max(initial=-1)) + 1
        row = np.zeros(grams, np.int64)
        row[gram] = row_of[side[at]]
        of = place[side[at]]

        def count(k: int, gram=gram, of=of, grams=grams) -> np.ndarray:
            return np.bincount(gram[of == k], minlength=grams)

        def by_row(x: np.ndarray, row=row) -> np.ndarray:
            return np.bincount(row, x, len(sizes))

        s, p = count(0), count(1)
        gone, new = np.maximum(s - p, 0), np.maximum(p - s, 0)
        common, added, dropped = by_row(np.minimum(s, p)), by_row(new), by_row(gone)
        for r in range(int(refs.max(initial=0))):
            k = count(2 + r)
            kept, shared = by_row(np.minimum(np.minimum(s, p), k)), by_row(np.minimum(s, k))
            hit, wrong = by_row(np.minimum(new, np.maximum(k - s, 0))), by_row(gone - np.minimum(gone, np.maximum(s - k, 0)))
            kp, kr = _share(kept, common), _share(kept, shared)
            total += np.where(refs > r, _share(2 * kp * kr, kp + kr) + _share(hit, added) + _share(dropped - wrong, dropped), 0.0)
    return _share(total / 4 / 3 * 100, refs.astype(float))


def sari(df: DataFrame, *, id_col: str, source="source", prediction="prediction", references="references") -> DataFrame:
    """SARI of every row, 1- to 4-grams, averaged over its references; a row without references scores 0.

    Tokens are numbered and n-grams counted for many rows at once inside a task, in
    memory bounded by ``SARI_TOKENS`` or the largest row; nothing but texts is moved.
    """
    none = F.array().cast("array<array<string>>")
    side = lambda col: F.coalesce(words(F.col(col)), F.array().cast("array<string>"))
    others = F.transform(F.col(references), lambda r: F.coalesce(words(r), F.array().cast("array<string>")))
    rows = df.select(id_col, F.concat(F.array(side(source), side(prediction)), F.coalesce(others, none)).alias("texts"))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column(1)
            inner = np.concatenate([[0], np.cumsum(texts.flatten().value_lengths().to_numpy(zero_copy_only=False))])
            ends = inner[np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))]
            out, first, base = [], 0, 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, base + SARI_TOKENS, side="right")))
                out.append(_sari_part(texts.slice(first, last - first)))
                first, base = last, int(ends[last - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=[id_col, "sari"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, sari double")


# Bytes of texts whose n-grams are counted at once; a larger id is a part of its own.
BLEU_BYTES = 1 << 21


def _bleu_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, as ``words`` finds them; a null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    full = np.append(0, np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(full[ends], pa.int32()), flat.filter(pc.not_equal(flat, "")))


def _bleu_part(rows: pa.ListArray, scored: np.ndarray) -> list[tuple[int, int | None, int | None]]:
    """``(n, hit, all)`` for n-grams of 1 to 4 words and, with n = 0, the lengths of predictions and references.

    A list holds the rows of one id, a row the prediction and then its references. The
    n-grams of an id are counted together, unless it is not ``scored``.
    """
    id_of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
    texts = rows.flatten()
    sizes = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    missing = texts.flatten().is_null().to_numpy(zero_copy_only=False)
    lists = _bleu_words(texts.flatten())
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(row_of)) - first[row_of]

    # the nearest length of each row's references, the shorter of two; none where a reference is null
    mine = np.where(missing[first], 0, lengths[first])
    order = np.lexsort((lengths, np.abs(lengths - mine[row_of]) * ~missing[first][row_of], place == 0, row_of))
    has = np.bincount(row_of, (place > 0), len(sizes)) > 0
    has &= np.bincount(row_of, missing & (place > 0), len(sizes)) == 0
    near = lengths[order[first[has]]]
    known = ~missing[first]
    out = [(0, int(mine[known].sum()) if known.any() else None, int(near.sum()) if len(near) else None)]

    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(row_of)), lengths)
    keep = scored[id_of[row_of[text]]]
    codes, text = codes[keep], text[keep]
    for n, (gram, at) in enumerate(_gram_ids(codes, text, id_of[row_of[text]], 4), 1):
        kinds, of = int(gram.max(initial=-1)) + 1, place[text[at]]
        p, r = np.bincount(gram[of == 0], minlength=kinds), np.zeros(kinds, np.int64)
        for k in range(1, int(of.max(initial=0)) + 1):
            r = np.maximum(r, np.bincount(gram[of == k], minlength=kinds))
        out.append((n, int(np.minimum(p, r).sum()), int(p.sum())))
    return out


def bleu(df: DataFrame, *, id_col: str, prediction="prediction", references="references", lower: bool = False, smooth: bool = True) -> DataFrame:
    """Corpus BLEU over whitespace tokens: clipped 1- to 4-gram precisions and brevity penalty.

    A count of matches without any hit is replaced by 1/2, 1/4, ... of one when ``smooth``.
    Whole texts are shuffled by id once, rows of the same id and number of references
    count together; a task numbers its words and reports ten sums for each part of at most
    ``BLEU_BYTES`` or the largest id, never its n-grams.
    """
    cased = (lambda c: F.lower(c)) if lower else (lambda c: c)
    refs = F.coalesce(F.transform(F.col(references), cased), F.array().cast("array<string>"))
    rows = df.select(id_col, F.size(references).alias("refs"), F.concat(F.array(cased(F.col(prediction))), refs).alias("texts"))
    ids = rows.groupBy(id_col, "refs").agg(F.collect_list("texts").alias("rows")).select("refs", "rows")

    def run(batches):
        for batch in batches:
            scored, texts = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(1)
            bytes_of = pc.fill_null(pc.binary_length(texts.flatten().flatten()), 0).to_numpy(zero_copy_only=False)
            inner = np.append(0, np.cumsum(texts.flatten().value_lengths().to_numpy(zero_copy_only=False)))
            outer = np.append(0, np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False)))
            ends = np.append(0, np.cumsum(bytes_of, dtype=np.int64))[inner[outer]]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLEU_BYTES, side="right")) - 1)
                found = _bleu_part(texts.slice(first, last - first), scored[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["n", "hit", "all"])
                first = last

    parts = ids.mapInArrow(run, "n bigint, hit bigint, all bigint")
    of = lambda n, name: F.sum(F.when(F.col("n") == n, F.col(name)))
    counts = [of(n, name).alias(f"{name}{n}") for n in range(1, 5) for name in ("hit", "all")]
    one = parts.agg(of(0, "hit").alias("hyp_len"), of(0, "all").alias("ref_len"), *counts)
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        hit, all_ = F.coalesce(F.col(f"hit{n}"), F.lit(0)), F.coalesce(F.col(f"all{n}"), F.lit(0))
        zeros = zeros + F.when((hit == 0) & (all_ > 0), 1).otherwise(0)
        value = F.when(hit > 0, hit.cast("double")).otherwise(F.pow(F.lit(0.5), zeros) if smooth else F.lit(0.0))
        logs = logs + F.when(all_ > 0, F.ln(F.greatest(value / all_, F.lit(1e-300)))).otherwise(F.ln(F.lit(1e-300)))
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).when(F.col("hyp_len") == 0, 0.0).otherwise(F.exp(1 - F.try_divide(F.col("ref_len").cast("double"), F.col("hyp_len"))))
    return one.select("hyp_len", "ref_len", (penalty * F.exp(logs / 4) * 100).alias("bleu"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table packed into one integer."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _rouge_part(texts: pa.ListArray) -> list[float | None]:
    """Best F1 of rows of token lists: the prediction, then its references; None without references."""
    sizes = texts.value_lengths().to_numpy(zero_copy_only=False)
    lists = texts.flatten()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sides = np.split(codes, ends[:-1]) if len(ends) else []
    mark, out, at = np.zeros(int(codes.max(initial=0)) + 1, bool), [], 0
    for n in sizes:
        best, p = None, sides[at]
        for r in sides[at + 1 : at + n]:
            # words of one side only are in no common subsequence
            mark[r] = True
            mine = p[mark[p]]
            mark[r] = False
            mark[mine] = True
            common = lcs_length(mine.tolist(), r[mark[r]].tolist())
            mark[mine] = False
            precision, recall = common / len(p) if len(p) else 0.0, common / len(r) if len(r) else 0.0
            f1 = 2 * precision * recall / (precision + recall) * 100 if common else 0.0
            best = f1 if best is None else max(best, f1)
        out.append(best)
        at += n
    return out


def rouge_l(df: DataFrame, *, id_col: str, prediction="prediction", references="references") -> DataFrame:
    """ROUGE-L F1 of every row, whole texts, the best over its references; rows without references are left out.

    Tokens are numbered for a whole batch, and a row of the table is one number of as many
    bits as the text has words, so a text of n words against one of m takes m steps.
    """
    side = lambda col: F.coalesce(words(col), F.array().cast("array<string>"))
    # long texts spread over the tasks, as they are: their words take more room
    moved = df.filter(F.size(references) > 0).select(id_col, prediction, references).repartition(id_col)
    rows = moved.select(id_col, F.concat(F.array(side(F.col(prediction))), F.transform(references, side)).alias("texts"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_rouge_part(batch.column(1)), pa.float64())], names=[id_col, "rouge_l"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, rouge_l double")


def fkgl(text) -> Column:
    """Flesch-Kincaid grade. Syllables of a word: its groups of a, e, i, o, u, y, one less
    for a final e after another group, at least one; sentences end at . ! or ?."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = words(text)
    sentences = F.greatest(F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1))

    def syllables(w):
        groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
        return F.greatest(groups - F.when(F.endswith(w, F.lit("e")) & (groups > 1), 1).otherwise(0), F.lit(1))

    n = F.size(tokens)
    total = F.aggregate(tokens, F.lit(0), lambda acc, w: acc + syllables(w))
    return F.lit(0.39) * n / sentences + F.lit(11.8) * F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)) - F.lit(15.59)


# --- selections and runs ----------------------------------------------------------------


def pass_at_1(results: DataFrame, task_col: str, passed: Column) -> DataFrame:
    """Share of tasks that some completion solves."""
    per = results.groupBy(task_col).agg(F.bool_or(passed).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("double")).alias("pass_at_1"))


def selection_recall(truth: DataFrame, found: DataFrame, by: str | None = None, id_col="vec_id") -> DataFrame:
    """Share of the true selection that was found, overall or per group."""
    keys = [by] if by else []
    a = truth.select(*keys, id_col).distinct()
    marked = a.join(found.select(*keys, id_col).distinct().withColumn("_hit", F.lit(1)), [*keys, id_col], "left")
    grouped = marked.groupBy(*keys) if by else marked.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("truth"), F.count("_hit").alias("found"), F.round(_ratio(F.count("_hit"), F.count(F.lit(1))), 6).alias("recall")
    )


def assignment_agreement(a: DataFrame, b: DataFrame, id_col="vec_id", cid_col="cid") -> DataFrame:
    joined = a.select(id_col, F.col(cid_col).alias("x")).join(b.select(id_col, F.col(cid_col).alias("y")), id_col)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agreement"))


def farthest_by_mean_distance(neighbors: DataFrame, b: int) -> DataFrame:
    """The b queries whose neighbours are farthest away on average."""
    per = neighbors.groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.avg("dist"), 9).alias("mean_dist"))
    return per.orderBy(F.col("mean_dist").desc(), "vec_id").limit(b)


def sweep(settings: dict[str, DataFrame]) -> DataFrame:
    """Results of several settings under one another, marked by ``setting``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("setting"), "*") for name, df in settings.items()])


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    return df.select(length.alias("n")).agg(
        F.count(F.lit(1)).alias("num_samples"), F.round(F.avg("n"), 6).alias("avg_length"), F.max("n").cast("bigint").alias("max_length"),
        F.min("n").cast("bigint").alias("min_length"), F.sum("n").cast("bigint").alias("total_tokens"),
    )


def run_summary(iterations: DataFrame) -> DataFrame:
    """Last accuracy and total time of a run from its iteration rows ``(iteration, acc, time)``."""
    return iterations.agg(
        F.max("iteration").alias("last_iteration"), F.max_by("acc", "iteration").alias("last_acc"), F.sum("time").alias("total_time")
    )
