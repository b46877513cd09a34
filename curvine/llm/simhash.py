"""Near-duplicates by SimHash fingerprints, found by the generalised pigeonhole principle.

Fingerprints that differ in at most ``max_bits`` of 64 bits are linked. The bits are cut
into partitions, correlated bits together, so that skew gathers in few partitions and
the others stay selective. If the partition thresholds add up to
``max_bits - partitions + 1``, two linked fingerprints agree within the threshold in at
least one partition; a threshold of -1 leaves a partition out. Every fingerprint gets
its own thresholds, by dynamic programming over the estimated number of candidates, so
it does not probe a value that many share if other partitions are cheaper. Candidates
from equal values are verified on all bits.

Only different fingerprints are compared, whatever the number of copies. A value that
very many share is cut into pairs of blocks, and a task reports a spanning forest of the
links it sees, never the pairs. The groups are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import lower_words, text_of
from curvine.operators.dedup import connected_components
from curvine.plans.blocks import block_join
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.session import checkpoint

BITS, WIDTH, MAX_BITS, SEED = 64, 3, 3, 42
# Counters per partition for the estimates: exact up to 16 bits, hashed beyond.
COUNTER_BITS = 16
# Values with more fingerprints than this are compared in blocks.
HOT_VALUE, BLOCK_ROWS = 4096, 2048
CHUNK = 1 << 16


# --- fingerprints ----------------------------------------------------------------------


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The SimHash of the word shingles, as a signed 64-bit number; 0 without a word."""
    words = lower_words(text)
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*[words[i:] for i in range(width)]))) or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), CHUNK):
        hashes = np.array([digest(p, SEED) for p in parts[at : at + CHUNK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, row_key, fp)``, one row per input row; ``row_key`` stands for id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(prints, pa.int64())], names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, fp bigint")


# --- partitions and thresholds ------------------------------------------------------------


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            for at in range(0, len(bits), CHUNK):
                both += bits[at : at + CHUNK].T @ bits[at : at + CHUNK]
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    # 4097 sums
    rows = prints.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for row in rows:
        sums[row["cell"]] = row["n"]
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    share = np.diag(both)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs((both - np.outer(share, share)) / np.outer(spread, spread))


def partition_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Groups of (nearly) equal size; each grows by the bit most correlated with it."""
    left = set(range(BITS))
    groups = []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (correlation[b, rest].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def choose_parts(n: int, max_bits: int) -> int:
    """The number of partitions with the least probes and candidates, if bits were independent."""

    def cost(parts: int) -> float:
        free, width = max_bits - parts + 1, BITS / parts
        each, more = divmod(free, parts)
        ball = lambda r: sum(_choose(width, k) for k in range(r + 1))
        probes = more * ball(each + 1) + (parts - more) * ball(each)
        return n * probes * (1 + n / 2**width)

    return min(range(1, max_bits + 2), key=cost)


def _choose(n: float, k: int) -> float:
    out = 1.0
    for i in range(k):
        out *= (n - i) / (i + 1)
    return out


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(prints: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a partition as one number."""
    u = prints.view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for i, bit in enumerate(group):
        out |= ((u >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def _mask(bits: tuple[int, ...]) -> np.int64:
    return np.array(sum(1 << b for b in bits), np.uint64).view(np.int64)[()]


def _counter(values: np.ndarray, width: int) -> np.ndarray:
    """The counter of a value: itself while the partition is narrow, else a hash of it."""
    if width <= COUNTER_BITS:
        return values
    mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - COUNTER_BITS)).view(np.int64)


def count_values(prints: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Fingerprints by partition and counter: at most ``parts * 65536`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(groups), 1 << COUNTER_BITS), np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for p, group in enumerate(groups):
                counts[p] += np.bincount(_counter(_values(fp, group), len(group)), minlength=1 << COUNTER_BITS)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(len(groups) << COUNTER_BITS, np.int64)
    flat[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return flat.reshape(len(groups), -1)


def thresholds(prints: np.ndarray, groups: list[list[int]], counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Per fingerprint and partition the threshold (-1: none) with the least estimated work.

    Work is the probes plus the candidates they meet. Counts within one bit are read
    from the counters, wider balls are taken as evenly filled beyond that.
    """
    n, total = len(prints), counts[0].sum()
    choices = range(-1, max_bits + 1)
    goal = max_bits - len(groups) + 1
    # best[s]: least work of the partitions so far with thresholds adding up to s
    best: dict[int, np.ndarray] = {0: np.zeros(n)}
    picks: list[dict[int, np.ndarray]] = []
    for p, group in enumerate(groups):
        width, values = len(group), _values(prints, group)
        at = lambda v: counts[p][_counter(v, width)]  # noqa: B023, E731
        work = {-1: np.zeros(n), 0: at(values) + 1.0}
        if max_bits >= 1:
            work[1] = work[0] + sum(at(values ^ _mask((b,))) for b in range(width)) + width
        for t in range(2, max_bits + 1):
            ball = _choose(width, t)
            work[t] = work[t - 1] + ball * (1 + total / 2.0**width)
        after: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s, cost in best.items():
            for t in choices:
                new = cost + work[t]
                if s + t not in after:
                    after[s + t], pick[s + t] = new, np.full(n, t, np.int8)
                else:
                    less = new < after[s + t]
                    after[s + t] = np.where(less, new, after[s + t])
                    pick[s + t] = np.where(less, np.int8(t), pick[s + t])
        best = after
        picks.append(pick)
    out = np.empty((n, len(groups)), np.int8)
    rest = np.full(n, goal)
    for p in range(len(groups) - 1, -1, -1):
        for s in np.unique(rest):
            out[rest == s, p] = picks[p][int(s)][rest == s]
        rest = rest - out[:, p]
    return out


def _probe_rows(groups: list[list[int]], counts, max_bits: int):
    """Rows ``(part, value, fp)``: every value within the threshold of a fingerprint's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            chosen = thresholds(prints, groups, counts.value, max_bits)
            for p, group in enumerate(groups):
                values = _values(prints, group)
                for t in range(max_bits + 1):
                    rows = chosen[:, p] >= t
                    if not rows.any():
                        break
                    for flips in combinations(range(len(group)), t):
                        mask = _mask(flips)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.sum(), p), pa.int32()), pa.array(values[rows] ^ mask), pa.array(prints[rows])], names=["part", "value", "fp"])

    return run


def _own_rows(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            for p, group in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), p), pa.int32()), pa.array(_values(prints, group)), pa.array(prints)], names=["part", "value", "fp"])

    return run


# --- links and groups -----------------------------------------------------------------------


def _forest(max_bits: int):
    """A kernel for two blocks of fingerprints: links that join what is linked between them."""

    def kernel(_, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column("id").to_numpy() for t in (left, right))
        near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= max_bits
        ends: list[tuple[np.ndarray, int]] = []
        waiting = np.flatnonzero(near.any(axis=1))
        seen = np.zeros(len(a), bool)
        for i in waiting:
            if seen[i]:
                continue
            mine, other = np.array([i]), np.zeros(len(b), bool)
            seen[i] = True
            while len(mine):
                fresh = near[mine].any(axis=0) & ~other
                other |= fresh
                mine = np.flatnonzero(near[:, fresh].any(axis=1) & ~seen) if fresh.any() else mine[:0]
                seen[mine] = True
                ends.append((a[mine], a[i]))
            ends.append((b[other], a[i]))
        u = np.concatenate([e for e, _ in ends]) if ends else np.zeros(0, np.int64)
        v = np.concatenate([np.full(len(e), r) for e, r in ends]) if ends else np.zeros(0, np.int64)
        return pa.table({"id_a": pa.array(u, pa.int64()), "id_b": pa.array(v, pa.int64())})

    return kernel


def hamming_links(prints: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None, hot_value: int = HOT_VALUE) -> DataFrame:
    """``(id_a, id_b)`` that connect all distinct fingerprints ``fp`` within ``max_bits``, chains included.

    Below ``hot_value`` fingerprints on a value every link is reported; values with
    more report a spanning forest of theirs. ``parts`` is estimated if not given.
    """
    sc = prints.sparkSession.sparkContext
    parts = parts or choose_parts(max(1, prints.count()), max_bits)
    groups = partition_bits(bit_correlation(prints), parts)
    counts = sc.broadcast(count_values(prints, groups))
    schema = "part int, value bigint, fp bigint"
    probes = prints.select("fp").mapInArrow(_probe_rows(groups, counts, max_bits), schema)
    own = prints.select("fp").mapInArrow(_own_rows(groups), schema)
    # at most parts * rows / hot_value values
    hot = F.broadcast(own.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_value).select("part", "value"))
    key = ["part", "value"]
    left, right = probes.join(hot, key, "left_anti").alias("l"), own.join(hot, key, "left_anti").alias("r")
    apart = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    cold = left.join(right, (F.col("l.part") == F.col("r.part")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.fp") != F.col("r.fp")) & (apart <= max_bits))
    links = cold.select(F.least("l.fp", "r.fp").alias("id_a"), F.greatest("l.fp", "r.fp").alias("id_b")).distinct()
    grouped = lambda df: df.join(hot, key, "left_semi").select(F.concat_ws(":", "part", "value").alias("g"), F.col("fp").alias("id"))
    dense = block_join(grouped(probes), grouped(own), _forest(max_bits), "id_a bigint, id_b bigint", True, BLOCK_ROWS)
    return links.unionByName(dense)


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, parts: int | None = None, hot_value: int = HOT_VALUE) -> DataFrame:
    """``(doc_id, row_key, fp, component, component_id)``, one row per input row.

    ``component`` names the group (its smallest fingerprint), ``component_id`` is its
    smallest id. Texts shorter than ``width`` words are one shingle; null, empty and
    blank texts have fingerprint 0, which links like any other. A null id is nobody's
    smallest unless all ids of the group are null; repeated ids and rows keep their
    rows; an empty table gives no rows; other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, width))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")))
    groups = connected_components(hamming_links(classes.select("fp"), max_bits, parts, hot_value)).select(F.col("id").alias("fp"), "component")
    named = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labels = checkpoint(named.select("fp", "n", "component").join(smallest, "component"))
    return join_lookup(prints, labels, "fp", max(1, prints.count() // MAX_HOT_KEYS), "n").select("doc_id", "row_key", "fp", "component", "component_id")
