"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification.

Spark weighs every term of every test item by BM25. An index holds the posting lists,
cut into blocks of items with the largest weight of each block. The different terms of
a whole document are one query, as the parts of an item may lie anywhere in the text.
Weights are divided by the score an item must at least reach when enough of it is in
the document, so the threshold is 1 for all items and nothing above it is missed. Sums
of list maxima skip documents, sums of block maxima skip blocks, and only what is left
is scored exactly. Every hit is verified on the shingles of question and answer.

A benchmark larger than ``MAX_POSTINGS`` is searched in slices, one pass over the
documents for each, so a task never holds more than one slice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import keep_rows, text_of

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
BLOCK_ITEMS = 8
MAX_POSTINGS = 1_000_000
CHUNK_WORDS = 60_000
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def plain_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation read as blanks."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def split_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: the answer is the last sentence or line, if there are several."""
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+|\n", text.rstrip())]
    at = cuts[-1] if cuts else len(text)
    return plain_words(text[:at]), plain_words(text[at:])


def shingles(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; a shorter sequence is one run."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(zip(*[words[i:] for i in range(width)]))


@dataclass
class Item:
    """One test item of a slice, ready to be verified."""

    item_id: int
    parts: dict[tuple[bytes, ...], bool]  # shingle -> whether it holds a word of the answer

    def found(self, there: set[tuple[bytes, ...]]) -> tuple[int, int]:
        hits = [answer for s, answer in self.parts.items() if s in there]
        return len(hits) - sum(hits), sum(hits)


def weighted_items(items: DataFrame) -> DataFrame:
    """``(key, item_id, text, terms array<struct<term, weight>>)``: BM25 weights over all test items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[w.hex() for w in plain_words(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(terms, pa.list_(pa.string()))], names=["key", "terms"])

    # rows with the same id and text are one item
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text")).distinct().withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text"), 256))
    terms = rows.select("key", "text").mapInArrow(run, "key string, terms array<string>").filter(F.size("terms") > 0)
    n, mean = terms.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).collect()[0]
    tf = terms.select("key", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    weighed = tf.join(df, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms"))
    return rows.join(weighed, "key")


class Index:
    """Posting lists with block maxima over one slice of test items."""

    def __init__(self, rows: list, shingle: int, overlap: float, block_items: int = BLOCK_ITEMS):
        entries = []
        for row in rows:
            question, answer = split_answer(row["text"])
            words = question + answer
            parts = {}
            for i, s in enumerate(shingles(words, shingle)):
                parts[s] = parts.get(s, False) or i + len(s) > len(question)
            weights = {bytes.fromhex(t["term"]): t["weight"] for t in row["terms"]}
            # an item counts when this share of its shingles is there; then no more words than this are missing
            needed = math.ceil(overlap * len(parts) - 1e-9)
            absent = max(0, len(words) - (needed + min(shingle, len(words)) - 1)) if len(parts) == len(words) - shingle + 1 else len(words) - shingle
            ordered = sorted(weights.values())
            least = max(sum(ordered[: max(1, len(ordered) - max(0, absent))]), ordered[0])
            entries.append((least, Item(row["item_id"], parts), weights))
        # items with like thresholds share a block, which keeps its maxima close
        entries.sort(key=lambda e: (e[0], e[1].item_id or 0))
        self.items = [e[1] for e in entries]
        self.overlap, self.shingle = overlap, shingle
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*[e[2] for e in entries]) if entries else set()))}
        postings = sorted((self.terms[t], i, w / least) for i, (least, _, weights) in enumerate(entries) for t, w in weights.items())
        term = np.array([p[0] for p in postings], np.int64)
        self.item = np.array([p[1] for p in postings], np.int64)
        self.weight = np.array([p[2] for p in postings])
        block = self.item // block_items
        opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.block = block[opens]
        self.block_from = np.append(opens, len(term))
        self.block_max = np.maximum.reduceat(self.weight, opens) if len(opens) else np.zeros(0)
        self.term_from = np.searchsorted(term[opens], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.term_from[:-1]) if len(opens) else np.zeros(0)
        self.blocks = -(-len(self.items) // block_items)

    def search(self, doc: np.ndarray, term: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """All (document, item) whose score reaches 1; input: one row per document and distinct term."""
        slack = 1 - 1e-9
        # sums of list maxima: documents that cannot reach the threshold leave
        may = np.bincount(doc, self.term_max[term], docs) >= slack
        keep = may[doc]
        doc, term = doc[keep], term[keep]
        at, row = _expand(self.term_from[term], self.term_from[term + 1])
        cell = doc[row] * self.blocks + self.block[at]
        # sums of block maxima: blocks that cannot hold an item above the threshold leave
        cells, inverse = np.unique(cell, return_inverse=True)
        high = np.bincount(inverse, self.block_max[at], len(cells)) >= slack
        keep = high[inverse]
        at, row = at[keep], row[keep]
        posting, own = _expand(self.block_from[at], self.block_from[at + 1])
        pair = doc[row[own]] * len(self.items) + self.item[posting]
        pairs, inverse = np.unique(pair, return_inverse=True)
        hits = pairs[np.bincount(inverse, self.weight[posting], len(pairs)) >= slack]
        return np.divmod(hits, max(1, len(self.items)))

    def contaminated(self, texts: list[str]) -> Iterator[tuple[int, Item, int, int]]:
        """(row, item, question shingles found, answer shingles found) of all verified hits."""
        group: list[tuple[int, list[bytes]]] = []
        size = 0
        for row, text in enumerate(texts):
            words = plain_words(text)
            if group and size + len(words) > CHUNK_WORDS:
                yield from self._verified(group)
                group, size = [], 0
            group.append((row, words))
            size += len(words)
        if group:
            yield from self._verified(group)

    def _verified(self, group: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, Item, int, int]]:
        if not self.terms:
            return
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for _, words in group for w in words), np.int64, sum(len(w) for _, w in group))
        doc = np.repeat(np.arange(len(group)), [len(w) for _, w in group])
        known = ids >= 0
        key = np.unique(doc[known] * len(self.terms) + ids[known])
        docs, item = self.search(*np.divmod(key, len(self.terms)), len(group))
        for d in np.unique(docs):
            row, words = group[d]
            there: dict[int, set[tuple[bytes, ...]]] = {}
            for i in item[docs == d]:
                one = self.items[i]
                width = len(next(iter(one.parts)))
                if width not in there:
                    there[width] = set(zip(*[words[k:] for k in range(width)]))
                q, a = one.found(there[width])
                if q + a >= self.overlap * len(one.parts) - 1e-9:
                    yield row, one, q, a


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range each belongs to."""
    counts = end - start
    own = np.repeat(np.arange(len(start)), counts)
    return np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + start[own], own


def _indexes(items: DataFrame, shingle: int, overlap: float, max_postings: int) -> Iterator:
    """A broadcast index for each slice of about ``max_postings`` postings."""
    weighed = weighted_items(items)
    total = weighed.agg(F.sum(F.size("terms"))).collect()[0][0] or 0
    slices = max(1, -(-total // max_postings))
    part = F.pmod(F.xxhash64("key"), F.lit(slices))
    for s in range(slices):
        yield items.sparkSession.sparkContext.broadcast(Index(weighed.filter(part == s).collect(), shingle, overlap))


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, overlap: float = OVERLAP, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """``(doc_id, item_id, shingles, found, question_found, answer_found)``, one row per document row and item it holds.

    An item is held when at least ``overlap`` of its distinct shingles are in the text; an
    item of fewer words counts as one shingle. Null and empty texts and items match
    nothing; null and repeated ids and repeated rows are each searched; equal items (id
    and text) count once; empty tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    found = None
    for index in _indexes(items, shingle, overlap, max_postings):
        one = rows.mapInArrow(_leak_rows(index), "doc_id bigint, item_id bigint, shingles int, found int, question_found int, answer_found int")
        found = one if found is None else found.unionByName(one)
    return found


def _leak_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], i.item_id, len(i.parts), q + a, q, a) for r, i, q, a in index.value.contaminated(batch.column("text").to_pylist())]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc_id", "item_id", "shingles", "found", "question_found", "answer_found"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, overlap: float = OVERLAP, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """The documents that hold no test item, with their columns as they are, whatever their names.

    Null and empty texts stay; null and repeated ids and repeated rows are judged row by
    row; items without a word, and an empty table of items, drop nothing; an empty table of
    documents gives no rows.
    """

    def without(index) -> DataFrame:
        def keep(texts: list[str]) -> list[bool]:
            bad = {row for row, *_ in index.value.contaminated(texts)}
            return [i not in bad for i in range(len(texts))]

        return keep_rows(docs, keep)

    for index in _indexes(items, shingle, overlap, max_postings):
        docs = without(index)
    return docs
