"""Quality rules on repetition inside a text, by suffix arrays.

The words of several texts form one sequence with an end mark of its own after each
text, so that no repeat crosses texts. The suffix array is built by prefix doubling
on the suffixes that still tie; the ranks of every doubling give the longest common
prefixes of neighbours. Runs of neighbours with a common prefix of at least
``min_repeat`` words are the LCP intervals of maximal repeats; the union of their
spans is the covered part of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curvine.llm.common import BLANKS, keep_rows, text_of

SYMBOLS = b"#*$%&|<>"
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
# Words worked on together: bounds the memory of a task, and a longer text goes alone.
BATCH_WORDS = 200_000

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, n_repeats bigint, covered_words bigint, longest_repeat bigint"
)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of a sequence, and for each doubling the ranks by the first 1, 2, 4 ... symbols.

    The last symbol, and the last of every text, must occur once only.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    ordered = symbols[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels = [rank.copy()]
    tied = order[~(new & np.append(new[1:], True))]
    step = 1
    while len(tied):
        key = rank[tied].astype(np.int64) * n + rank[tied + step]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        opens = np.append(True, old[1:] != old[:-1])
        slot = old + at - np.maximum.accumulate(np.where(opens, at, 0))
        new = np.append(True, key[1:] != key[:-1])
        rank[tied] = slot[np.maximum.accumulate(np.where(new, at, 0))]
        levels.append(rank.copy())
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array (0 for the first)."""
    lcp = np.zeros(len(sa), np.int64)
    pairs = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[pairs - 1], sa[pairs]
    length = np.zeros(len(pairs), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = levels[j][a + length] == levels[j][b + length]
        length[same] += 1 << j
    lcp[pairs] = length
    return lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def repeats(texts_words: list[list[bytes]], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Per text: words in repeated 3-word windows, maximal repeats, words they cover, longest repeat."""
    counts = np.array([len(w) for w in texts_words], np.int64)
    ends = np.cumsum(counts + 1)
    n = int(ends[-1])
    own: dict[bytes, int] = {}
    for words in texts_words:
        own.update(dict.fromkeys(words))
    own = dict(zip(own, range(len(own))))
    width = len(own) + 1
    symbols = np.empty(n, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    is_word = np.ones(n, bool)
    is_word[ends - 1] = False
    symbols[is_word] = np.fromiter((own[w] for words in texts_words for w in words), np.int64, n - len(counts))
    symbols[~is_word] = len(own)
    symbols += doc * width
    sa, levels = suffix_array(symbols)
    lcp = neighbour_lcp(sa, levels)
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    bounds = ends - counts - 1

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.int64), bounds)

    windows = np.flatnonzero(longest >= 3)
    spans = np.flatnonzero(longest >= min_repeat)
    deep = lcp >= min_repeat
    opens = np.flatnonzero(deep & ~np.append(False, deep[:-1]))
    return {
        "n_repeat_words": per_text(_covered(windows, np.full(len(windows), 3), n)),
        "n_repeats": np.bincount(doc[sa[opens]], minlength=len(counts)),
        "covered_words": per_text(_covered(spans, longest[spans], n)),
        "longest_repeat": np.maximum.reduceat(longest, bounds),
    }


def measure(texts: list[str], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> dict[str, list]:
    """The columns of ``quality_rules`` but the id, for a list of texts."""
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")[1:]}
    group: list[list[bytes]] = []

    def flush() -> None:
        found = repeats(group, min_repeat)
        for name, values in found.items():
            out[name] += values.tolist()
        group.clear()

    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - (len(data) - len(data.translate(None, BLANKS))))
        out["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        if group and size + len(words) > BATCH_WORDS:
            flush()
            size = 0
        group.append(words)
        size += len(words)
    if group:
        flush()
    for n, repeated, covered, longest in zip(out["n_words"], out["n_repeat_words"], out["covered_words"], out["longest_repeat"]):
        failed = n < 50 or 100 * repeated > 50 * n
        out["base_failed"].append(failed)
        out["kept"].append(not failed and covered <= max_covered * n and longest <= max_longest)
    return out


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per input row with word, symbol, line and repetition counts and the verdict ``kept``.

    A text is kept if it has 50 words or more, at most half of them in 3-word windows
    that occur twice, at most ``max_covered`` of them inside maximal repeats of
    ``min_repeat`` words or more, and no repeat of more than ``max_longest`` words.
    A null or empty text has no words and is not kept; null and repeated ids and
    repeated rows are measured each for itself; an empty table gives no rows; other
    columns are not read. Work is per text, so no group can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("text").to_pylist(), min_repeat, max_covered, max_longest)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in found.items()]], names=["doc_id", *found])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that pass ``quality_rules``, with their columns as they are, whatever their names.

    Null, empty and blank texts have too few words and go; null and repeated ids and
    repeated rows are judged row by row; an empty table gives no rows.
    """
    return keep_rows(docs, lambda texts: measure(texts, min_repeat, max_covered, max_longest)["kept"])
