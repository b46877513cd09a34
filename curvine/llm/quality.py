"""Quality scores by compression.

Two zstandard dictionaries are built from labelled text, one from good rows and one from
bad ones. A text is compressed in pieces with each of them; how many bytes the good
dictionary saves over the bad one, per byte of text, becomes a probability by a logistic
curve fitted on labelled rows that built no dictionary. Pieces keep a dictionary's
influence equal along a text of any length.

The fit reads at most ``DICT_ROWS`` rows of each label for the dictionaries (one piece of
each, ``PIECE`` bytes) and ``FIT_ROWS`` rows for the curve, chosen by a hash of the id;
these bounds are parameters. Scoring reads whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import id_bucket, text_of

PIECE = 4096
LEVEL = 3
DICT_BYTES = 128 * 1024
DICT_ROWS = 2000
FIT_ROWS = 8000
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    """Dictionaries and curve; ``dictionaries`` is None if a label had no rows."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float
    offset: float


def savings(texts: list[str], dictionaries: tuple[bytes, bytes], piece: int = PIECE) -> np.ndarray:
    """Bytes that the good dictionary saves over the bad one, per byte of text; 0 for an empty text."""
    packers = []
    for data in dictionaries:
        kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        ready = zstandard.ZstdCompressionDict(data, dict_type=kind)
        ready.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=ready, write_content_size=False, write_checksum=False, write_dict_id=False))
    bad, good = (p.compress for p in packers)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        saved = 0
        for at in range(0, len(data), piece):
            part = data[at : at + piece]
            saved += len(bad(part)) - len(good(part))
        out[i] = saved / max(1, len(data))
    return out


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with a light pull to zero."""
    scale = float(np.std(x)) or 1.0
    rows = np.stack([x / scale, np.ones(len(x))], axis=1)
    pull = np.diag([1e-3, 1e-3])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (y - p) - pull @ w
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + pull, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", piece: int = PIECE, dict_rows: int = DICT_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that are not held out. A row labelled twice takes its higher label."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .filter(id_bucket(FOLDS) != HELD_OUT)
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    chosen = {}
    for use, half, bound, groups in (("dict0", 0, dict_rows, [0]), ("dict1", 0, dict_rows, [1]), ("curve", 1, fit_rows, [0, 1])):
        chosen[use] = known.filter(F.pmod("turn", F.lit(2)).eqNullSafe(half) & F.col("label").isin(groups)).orderBy("turn", "doc_id").limit(bound).select("doc_id", "label", F.lit(use).alias("use"))
    # at most 2 * dict_rows + fit_rows ids travel
    picked = F.broadcast(chosen["dict0"].unionByName(chosen["dict1"]).unionByName(chosen["curve"]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).join(picked, "doc_id")
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - piece + 1)).cast("int") + 1
    built = texts.filter("use <> 'curve'").select("doc_id", "label", F.substr("text", at, F.lit(piece)).alias("part")).dropDuplicates(["doc_id"])
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in built.orderBy("doc_id").collect():
        if row["part"]:
            samples[row["label"]].append(row["part"].encode("utf-8", "surrogatepass")[:piece])
    if not samples[0] or not samples[1]:
        # one label only: its share is all there is to tell
        shares = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()[0]
        p = (float(shares["good"] or 0) + 1) / (shares["n"] + 2)
        return Model(None, 0.0, float(np.log(p / (1 - p))))
    dictionaries = (build_dictionary(samples[0]), build_dictionary(samples[1]))
    curve = texts.filter("use = 'curve'").select("doc_id", "label", "text").mapInArrow(_saving_rows(dictionaries, piece, ["doc_id", "label"]), "doc_id bigint, label int, saved double").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if not len(curve):
        return Model(dictionaries, 100.0, 0.0)
    return Model(dictionaries, *_logistic(curve["saved"].to_numpy(float), curve["label"].to_numpy(float)))


def _saving_rows(dictionaries: tuple[bytes, bytes] | None, piece: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            saved = savings(texts, dictionaries, piece) if dictionaries else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(saved)], names=[*kept, "saved"])

    return run


def score(docs: DataFrame, model: Model, piece: int = PIECE) -> DataFrame:
    """``(doc_id, held_out, score, predicted, saved)``, one row per input row.

    A null text is empty; an empty text saves nothing and gets the curve's value there.
    Null ids count as the empty id for ``held_out``; repeated ids and rows are scored
    each for itself; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    scored = rows.mapInArrow(_saving_rows(model.dictionaries, piece, ["doc_id"]), "doc_id bigint, saved double")
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("saved") + F.lit(model.offset))))
    return scored.select("doc_id", (id_bucket(FOLDS) == HELD_OUT).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "saved")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every row.

    A null text is empty and has a score; null and repeated ids and repeated rows each keep
    their row; a label without a document or value teaches nothing, an id labelled twice
    takes its higher label; without labels every score is the same; an empty table gives no rows; other
    columns are not read.
    """
    return score(docs, fit(docs, labels, label))
