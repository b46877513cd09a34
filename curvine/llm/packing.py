"""Best-fit packing of token sequences by bin completion.

Only lengths matter for packing, and a sequence of at most ``capacity`` tokens has one
of ``capacity`` lengths. So Spark counts the pieces per length, the search runs on that
table of at most ``capacity`` rows, and its plan (which ranks of which length go to
which place of which sequence) is applied to the pieces in parallel. The plan has as
many rows as fillings times lengths in a filling, which depends on the capacity only.

The search takes the largest piece left, enumerates the undominated fillings of the
room beside it, and repeats the filling for as many sequences as its lengths last.
Fillings are enumerated one after the other in order of waste, without a cut; a branch ends
when its waste can no longer beat the best packing found (the first is best fit
decreasing), and the search ends when the packing meets the lower bound or the step budget
is used up. The budget limits the search for a better packing, never the pieces packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvine.llm.common import text_of
from curvine.llm.tokenizing import encoder, public_path
from curvine.session import checkpoint

CAPACITY = 1024
END_ID = 2
STEPS = 4_000
# Stretch of an enumeration that counts as a step.
TICK = 64
# Pieces of one length are ranked inside buckets of about this many rows.
BUCKET_ROWS = 20_000

Filling = tuple[tuple[int, int], ...]


# --- the search over lengths -------------------------------------------------------


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Filling]]:
    """Best fit decreasing on a table of counts: ``(sequences, ((length, times), ...))``."""
    counts = counts.copy()
    plan: list[tuple[int, Filling]] = []
    while counts.any():
        room, filling = capacity, []
        while room:
            fits = np.flatnonzero(counts[: room + 1])
            taken = sum(t for s, t in filling if len(fits) and s == fits[-1])
            if not len(fits):
                break
            size = int(fits[-1])
            times = min(room // size, int(counts[size]) - taken)
            if times <= 0:
                break
            filling.append((size, times))
            counts[size] -= times
            room -= size * times
        repeat = 1 + min(int(counts[s]) // t for s, t in filling)
        for s, t in filling:
            counts[s] -= t * (repeat - 1)
        plan.append((repeat, tuple(filling)))
    return plan


def _reachable(sizes: list[int], room: int) -> int:
    """Bit n is set if lengths from ``sizes``, taken any number of times, add up to n."""
    bits, full = 1, (1 << (room + 1)) - 1
    for size in sizes:
        step = size
        while step <= room:
            bits |= (bits << step) & full
            step *= 2
    return bits


def _dominated(filling: list[int], left: list[int], room: int) -> bool:
    """Whether a free length could take the place of one shorter piece, or of several pieces, and still fit."""
    slack = room - sum(filling)
    free = 0
    for size, n in enumerate(left):
        if n > 0:
            free |= 1 << size
    single = several = 0
    for size in filling:
        several |= (several | single) << size
        single |= 1 << size
    above, spread = 0, several
    for _ in range(slack):
        above, spread = (above | single) << 1, spread | (spread << 1)
    return bool((above | spread) & free & ((1 << (room + 1)) - 1))


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """The undominated sets of lengths that fit into ``room``, one after the other, least waste first.

    A set is dominated if a length that is left can be exchanged for one of its shorter
    ones, or for several together, without leaving the room (Martello and Toth, 1990); sets
    of one sum come with the longest lengths first. None is a step without a set, so that a caller
    can count the work. Nothing is cut: whoever reads to the end has seen all.
    """
    left = [int(n) for n in counts[: room + 1]] if room > 0 else [0]
    sizes = [s for s in range(room, 0, -1) if left[s] > 0]
    if not sizes:
        yield ()
        return
    reached, found, ticks = _reachable(sizes, room), False, 0
    for goal in range(room, 0, -1):
        if not reached >> goal & 1:
            continue
        # a filling grows by lengths that do not increase; an entry of the stack is a place in ``sizes``
        chosen: list[int] = []
        rest, stack = goal, [0]
        while stack:
            ticks += 1
            if ticks % TICK == 0:
                yield None
            i = stack[-1]
            while i < len(sizes) and (sizes[i] > rest or left[sizes[i]] == 0 or not reached >> (rest - sizes[i]) & 1):
                i += 1
            if i == len(sizes):
                stack.pop()
                if chosen:
                    last = chosen.pop()
                    left[last] += 1
                    rest += last
                continue
            stack[-1] = i + 1
            size = sizes[i]
            if size == rest:
                left[size] -= 1
                chosen.append(size)
                if not _dominated(chosen, left, room):
                    found = True
                    yield tuple(chosen)
                chosen.pop()
                left[size] += 1
                continue
            chosen.append(size)
            left[size] -= 1
            rest -= size
            stack.append(i)
    if not found:
        yield ()


def _branches(left: np.ndarray, capacity: int, most: int) -> Iterator[tuple[int, Filling] | None]:
    """``(sequences, filling)`` around the largest piece left, of at most ``most`` waste: every filling as often as it lasts, then every filling once."""
    largest = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[largest] -= 1
    for once in (False, True):
        for filling in fillings(rest, capacity - largest):
            if filling is None:
                yield None
                continue
            if capacity - largest - sum(filling) > most:
                # all that follow waste as much
                break
            own: dict[int, int] = {}
            for s in (largest, *filling):
                own[s] = own.get(s, 0) + 1
            repeat = min(int(left[s]) // t for s, t in own.items())
            if not once or repeat > 1:
                yield 1 if once else repeat, tuple(own.items())


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[int, Filling]]:
    """The packing found: ``(sequences, ((length, times), ...))``; ``counts[n]`` pieces have length n.

    Only the waste bound and ``steps`` (branches taken, and stretches of the enumeration)
    limit the search; with steps enough the packing has the fewest sequences there are.
    """
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    lowest = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))
    incumbent = best_fit(counts, capacity)
    fewest = sum(m for m, _ in incumbent)
    if fewest <= lowest:
        return incumbent
    room = lambda: (fewest - 1) * capacity - total  # noqa: E731  the waste that a better packing may have
    # depth first; an entry holds what is left, the sequences and waste so far, and its branches
    stack = [(counts, 0, 0, _branches(counts, capacity, room()))]
    way: list[tuple[int, Filling]] = []
    while stack and fewest > lowest and steps > 0:
        steps -= 1
        left, used, waste, branches = stack[-1]
        taken = next(branches, ())
        if taken == ():
            stack.pop()
            if way:
                way.pop()
            continue
        if taken is None:
            continue
        repeat, filling = taken
        lost = waste + repeat * (capacity - sum(s * t for s, t in filling))
        if lost > room():
            continue
        after = left.copy()
        for s, t in filling:
            after[s] -= repeat * t
        if after.any():
            way.append((repeat, filling))
            stack.append((after, used + repeat, lost, _branches(after, capacity, room() - lost)))
        elif used + repeat < fewest:
            fewest, incumbent = used + repeat, [*way, (repeat, filling)]
    return incumbent


def _places(plan: list[tuple[int, Filling]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by first rank: times per sequence, first sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    upto = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for repeat, filling in plan:
        offset = 0
        for size, times in filling:
            rows.setdefault(size, []).append((int(upto[size]), times, sequence, offset))
            upto[size] += repeat * times
            offset += size * times
        sequence += repeat
    return {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}


# --- the pieces ----------------------------------------------------------------------


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the token ids of a text and ``end_id``, cut only beyond ``capacity``.

    All pieces of a cut text are full but the first, which takes what is over. The string
    of a special token in a text gives its special id.
    """
    path = path or public_path("byte_bpe_50k.tiktoken")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special=True)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(rows, (doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k, _ in zip(rows, kinds, names)], names=names)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, one row per piece.

    Sequences are numbered from 0 and hold at most ``capacity`` tokens without gaps. A
    null or empty text is the end mark alone; null and repeated ids and repeated rows
    are packed each for itself; an empty table gives no rows; other columns are not
    read. ``with_ids`` keeps the token ids of every piece.
    """
    pieces = checkpoint(cut_pieces(docs, capacity, path, end_id, with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    # at most ``capacity`` rows
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_bins(counts, capacity)
    if not np.array_equal(sum((m * np.bincount([s for s, t in f for _ in range(t)], minlength=capacity + 1) for m, f in plan), np.zeros(capacity + 1, np.int64)), counts):
        raise AssertionError("the plan does not hold every piece once")
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan, capacity))
    buckets = max(1, int(counts.sum()) // BUCKET_ROWS)
    # exact ranks inside a length: by row inside a bucket, plus the rows of the buckets before
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "bucket")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                first, times, start, base = table[int(size)]
                row = np.searchsorted(first, nth[at], side="right") - 1
                over, inside = np.divmod(nth[at] - first[row], times[row])
                sequence[at] = start[row] + over
                offset[at] = base[row] + size * inside
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.select(*columns, "nth").mapInArrow(place, schema)
