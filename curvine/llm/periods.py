"""Periodic runs: stretches of words that repeat with a period, by seeds on diagonals.

A run of period q and length L is a match of L - q words between the text and itself
shifted by the lag q. Runs are at least ``LEAST`` words and ``TIMES`` periods long, so
every run guarantees a match of max(LEAST - q, (TIMES - 1) * q) words at its own lag; the
least of these over all q is the length k of the seeds. The k-grams of a text are
indexed, and pairs of occurrences in the same text give diagonals. Only pairs that the
word before does not extend are enumerated, for these begin a match; pairs too far apart
for a run leave at once. A pair is extended at its lag, unless the table of the furthest
word covered at this lag, or a run whose period divides the lag, already holds it.

A match is a run of its lag unless a part of the lag is a period too: a period of a
stretch of at least two lags divides the lag (Fine and Wilf), so the prime divisors decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import text_of

LEAST, TIMES = 24, 3
# Pairs of occurrences held at once; words compared at once; extensions before a look at the whole diagonal.
PAIRS, STEP, FEW = 1 << 22, 1 << 16, 4
SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def seed_width(least: int = LEAST, times: int = TIMES) -> int:
    """The longest k-gram that every run has at its own lag."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Every run ``(start, length, period)`` of a sequence of word numbers, by start, then period."""
    if len(ids) < least:
        return []
    found: dict[int, list[tuple[int, int]]] = {}
    furthest: dict[int, int] = {}
    for lag, starts in _diagonals(ids, seed_width(least, times), least, times):
        # what lies in a run whose period divides the lag ends with it and is no run of this lag
        for q in [q for q in found if q < lag and lag % q == 0]:
            a, b = np.array(found[q]).T
            at = np.searchsorted(a, starts, side="right") - 1
            starts = starts[~((at >= 0) & (starts + lag < b[at]))]
        parts = [lag // f for f in _prime_factors(lag)] if len(starts) else []
        breaks = np.flatnonzero(ids[lag:] != ids[:-lag]) if len(starts) > FEW else None
        if breaks is not None:
            # one look at the whole diagonal in place of many extensions
            ends = np.append(breaks, len(ids) - lag)[np.searchsorted(breaks, starts)]
            starts = starts[ends + lag - starts >= max(least, times * lag)]
        for start in starts.tolist():
            if start < furthest.get(lag, 0):
                continue
            end = _extended(ids, start, lag)
            furthest[lag] = end - lag
            if end - start >= max(least, times * lag) and not any(_period(ids, start, lag, part) for part in parts):
                found.setdefault(lag, []).append((start, end))
    return sorted((a, b - a, q) for q, spans in found.items() for a, b in spans)


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """Equal grams have equal codes; what only collides does not survive the extension."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        code = np.zeros(len(ids) - width + 1, np.uint64)
        for i in range(width):
            code = code * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : len(ids) - width + 1 + i]
    return code


def _diagonals(ids: np.ndarray, width: int, least: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """Lags, ascending, with the starts of matches of ``width`` words that may be runs."""
    code = _codes(ids, width)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    before = np.concatenate([[-1], ids[: len(code) - 1]])[order]
    # a gram whose words before are all equal begins no match
    group = np.concatenate([[0], np.cumsum(~same)])
    begins = np.unique(group[1:][same & (before[1:] != before[:-1])])
    first, last = np.searchsorted(group, begins), np.searchsorted(group, begins, side="right")
    grams = [(order[a:b], *_by_word_before(order[a:b], before[a:b])) for a, b in zip(first, last)]
    most, places = len(ids) // times, sum(len(g[0]) for g in grams)
    # lags in bands, so that the pairs held at once stay bounded
    band = max(1, PAIRS // max(1, places))
    for low in range(1, most + 1 if grams else 0, band):
        lags, starts = _band(ids, grams, low, min(low + band, most + 1), least, times)
        at = np.flatnonzero(np.diff(lags, prepend=0))
        for a, b in zip(at, np.append(at[1:], len(lags))):
            yield int(lags[a]), np.unique(starts[a:b])


def _by_word_before(places: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each place, and whether it is the most frequent one."""
    words, named, counts = np.unique(before, return_inverse=True, return_counts=True)
    return before, named == np.argmax(counts)


def _band(ids: np.ndarray, grams: list, low: int, high: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with a lag in ``[low, high)`` that begin a match: lags and left places, by lag.

    Places with the most frequent word before them never pair with each other, so only
    the others are looked at, to the right among all and to the left among those.
    """
    found_i, found_j = [], []
    for places, before, common in grams:
        rare = np.flatnonzero(~common)
        row, other = _windows(places, places[rare] + low, places[rare] + high)
        i, j = rare[row], other
        differ = before[i] != before[j]
        found_i.append(places[i[differ]])
        found_j.append(places[j[differ]])
        most = places[common]
        row, other = _windows(most, places[rare] - high + 1, places[rare] - low + 1)
        found_i.append(most[other])
        found_j.append(places[rare][row])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    lag = j - i
    far = np.maximum(least - lag, (times - 1) * lag) - 1
    ok = j + far < len(ids)
    i, lag, far = i[ok], lag[ok], far[ok]
    # a run is there at its far end too
    for part in (1, 2):
        ok = ids[i + far // part] == ids[i + lag + far // part]
        i, lag, far = i[ok], lag[ok], far[ok]
    order = np.lexsort((i, lag))
    return lag[order], i[order]


def _windows(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, position)`` for every place in ``[low, high)`` of each row; places ascend."""
    a, b = np.searchsorted(places, low), np.searchsorted(places, high)
    n = b - a
    row = np.repeat(np.arange(len(low)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[row]


def _extended(ids: np.ndarray, start: int, lag: int) -> int:
    """The end of the stretch from ``start`` in which words ``lag`` apart are equal."""
    at, step = start + lag, 64
    while at < len(ids):
        other = np.flatnonzero(ids[at : at + step] != ids[at - lag : min(at + step, len(ids)) - lag])
        if len(other):
            return at + int(other[0])
        at, step = at + step, min(2 * step, STEP)
    return len(ids)


def _period(ids: np.ndarray, start: int, lag: int, part: int) -> bool:
    """Whether a stretch of period ``lag`` has the period ``part``, a divisor."""
    return bool((ids[start : start + lag] == ids[start + part : start + part + lag]).all())


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy() if words else np.zeros(0, np.int32)


def _measured(docs: DataFrame, schema: str, row: Callable[[list[bytes], list[tuple[int, int, int]]], tuple], least: int, times: int, change=None) -> DataFrame:
    """One row per document: ``doc_id`` and what ``row`` makes of its words and runs; ``change`` may rewrite the words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                words = change(doc_id, words) if change else words
                out.append((doc_id, *row(words, find_runs(numbers(words), least, times))))
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], names=names)

    fields = _arrow_fields(docs, schema)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def _arrow_fields(docs: DataFrame, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType([docs.schema["doc_id"], *StructType.fromDDL(schema).fields])))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start,length,period>>)``, one row per input row.

    A null, empty or blank text has no words and no runs; null and repeated ids and
    repeated rows each keep their row; other columns are not read; an empty table gives
    no rows. A text is one task's work, in memory that grows with its words.
    """
    made = lambda words, runs: (len(words), [dict(zip(("start", "length", "period"), r)) for r in runs])
    return _measured(docs, f"n_words bigint, runs {SPANS}", made, least, times)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with every run cut to its first period; columns, row numbers and nulls stay.

    A text with a run comes back as its kept words with one space between; any other
    text stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else _collapsed(t, least, times) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _collapsed(text: str, least: int, times: int) -> str:
    words = words_of(text)
    runs = find_runs(numbers(words), least, times)
    if not runs:
        return text
    return b" ".join(w for w, stays in zip(words, without_repeats(len(words), runs)) if stays).decode("utf-8", "surrogatepass")


def digests(docs: DataFrame, plant: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``, one row per input row.

    The run shown has the greatest length / period (ties: smallest start, then period);
    without a run these are null. ``plant`` rewrites the words of one document in ten as a
    repeated part of them, by the crc32 of its id; a null id is left alone. Other cases
    are as in ``periodic_runs``.
    """
    schema = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _measured(docs, schema, _digest, least, times, _planted if plant else None)


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best: tuple = (None, None, None)
    for start, length, period in runs:
        # runs come by start, then period, so only a greater quotient wins
        if best[0] is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for w, stays in zip(words, without_repeats(len(words), runs)) if stays) if runs else b" ".join(words)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Fixed rule of the digests' test cases."""
    import zlib

    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
