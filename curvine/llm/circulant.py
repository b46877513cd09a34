"""Near copies by circulant MinHash: two permutations give all coordinates of a signature.

A shingle is a number of 64 bits. One permutation of these numbers mixes the sets, and a
second one, shifted circularly by 0, 1, 2, ..., gives coordinate after coordinate: the
least permuted value under each shift (Li and Li, 2022). Bands of coordinates are the
buckets in which sets meet. With 32 bands of 5, a pair at a similarity of exactly 0.85
meets in no bucket in 7 of a thousand million cases, and less often the closer it is.
Links are confirmed on the full sets by their exact Jaccard similarity, and the groups
are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import few_rows, lower_words, text_of
from curvine.llm.set_links import linked_sets, number_sets
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.session import checkpoint

WIDTH, SIMILARITY, SEED = 3, 0.85, 42
BANDS, ROWS = 32, 5
# Shingles permuted at once.
CHUNK = 512


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct word shingles as numbers of 64 bits, in order; fewer words are one shingle, none give no shingle."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.int64)
    parts = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) > width else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64)).view(np.int64)


def _initial(x: np.ndarray) -> np.ndarray:
    """The first permutation of the numbers of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shifted(x: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The second permutation under every circular shift: ``(shingles, shifts)``."""
    x = x[:, None] - shifts
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(by)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The least value under each shift of the second permutation."""
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    shifts = np.arange(coordinates, dtype=np.uint64)
    mixed = _initial(shingles.view(np.uint64))
    for at in range(0, len(mixed), CHUNK):
        np.minimum(least, _shifted(mixed[at : at + CHUNK], shifts).min(axis=0), out=least)
    return least


def buckets(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One bucket for each band, none for an empty set."""
    if not len(shingles):
        return []
    values = signature(shingles, bands * rows).reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), band) for band, v in enumerate(values)], np.uint64).view(np.int64).tolist()


def set_prints(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, row_key, key, size, buckets)``, one row per input row.

    ``key`` names the set by 128 bits, ``row_key`` id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            columns = {
                "key": pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "buckets": pa.array([buckets(s, bands, rows) for s in sets], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *columns.values()], names=["doc_id", "row_key", *columns])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), text_of().alias("text"))
    return named.mapInArrow(run, "doc_id bigint, row_key string, key binary, size bigint, buckets array<bigint>")


def row_key():
    """Id and text by 128 bits."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_of()))


def sets_of_rows(docs: DataFrame, width: int = WIDTH):
    """For ``linked_sets``: the shingles of wanted sets, read again from one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            sets = pa.array([shingle_set(t, width) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "parts"])

    def read(wanted: DataFrame) -> DataFrame:
        rows = docs.select(row_key().alias("row_key"), text_of().alias("text")).join(wanted, "row_key")
        return rows.dropDuplicates(["id"]).select("id", "text").mapInArrow(run, "id bigint, parts array<bigint>")

    return read


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, **limits: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    ``component_id`` is the smallest id among all documents that links reach. Texts with
    fewer than ``width`` words are one shingle; null, empty and blank texts have an empty
    set, link with nothing and keep their own id. A null id is nobody's smallest unless
    all ids of the group are null; ``kept`` holds for the rows with the smallest id,
    also for null ids where that is null. Repeated ids and rows keep their rows; other
    columns are not read; an empty table gives no rows.
    """
    prints = checkpoint(set_prints(docs, width, bands, rows))
    # the row whose text is read again, and the smallest id
    classes = number_sets(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    read = sets_of_rows(docs, width)
    source = classes.select(F.col("set_id").alias("id"), F.col("first.row_key").alias("row_key"))
    groups = linked_sets(classes, lambda ids: read(source.join(ids, "id")), similarity, **limits).select(F.col("id").alias("set_id"), "component")
    named = classes.filter("size > 0").select("set_id", "key", "n", F.col("first.doc_id").alias("smallest")).join(groups, "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labels = checkpoint(named.join(smallest, "component").select("key", "n", "component_id"))
    full = prints.filter("size > 0").select("doc_id", "key", "size")
    found = join_lookup(full, labels, "key", max(1, prints.count() // MAX_HOT_KEYS), "n").select("doc_id", "size", "component_id")
    bare = prints.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return found.unionByName(bare).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
