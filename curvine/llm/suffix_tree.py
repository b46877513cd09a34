"""Language-model scores by a probabilistic suffix tree over characters.

A text is read as the bytes of its lower-cased words, a blank before each and one end
byte after the last. The tree's nodes are contexts: the last 1 to ``DEPTH`` bytes. A
context is retained if its next-byte counts diverge from what its parent (the context
without its oldest byte) predicts: the log-likelihood ratio, that is count times
Kullback-Leibler divergence, must reach ``MIN_GAIN`` nats. The distribution of a retained
context is its counts smoothed with its parent's distribution, weighted by the number of
different next bytes times ``PARENT_WEIGHT``; a context that is not retained acts as its parent. So every byte is
predicted by its longest retained suffix.

A context and the next byte fit into one 64-bit number, so a task counts its texts by
sorting numbers, and Spark adds up the tasks. Texts are read as arrays of bytes: a task
holds no object per word. The tree is computed level by level with
joins; no task and no driver holds it. For scoring, documents are dealt into blocks; a
block asks for its own distinct contexts and words, gets their values by a join, and
adds them up per text. Counts, contexts and values all grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.llm.common import id_bucket, text_of
from curvine.session import shuffles_removed
from curvine.sources.sinks import scratch_folder

DEPTH = 5
MIN_GAIN = 2.0
# By trial on held-out texts: 4 and 8 do better than the usual 1.
PARENT_WEIGHT = 4.0
FOLDS, HELD_OUT = 10, 0
END = 10  # a word holds no line feed
END_WORD = b"\n"
# What a task reads at once, keeps before it merges and before it passes its counts on, and sends in one batch.
PIECE_BYTES, MERGE_BYTES, TALLY_BYTES, BATCH_ROWS = 1 << 19, 12 << 20, 24 << 20, 50_000
# A block's texts.
BLOCK_BYTES = 32 << 20
# Keys: the number of a gram and no word, or a word and a negative number made of it. Values travel as whole numbers of this unit.
NO_WORD, A_WORD, UNIT = b"", -1, 1e-11
UNIFORM = 1 / 256
# An odd number whose products spread over the upper bits.
MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(words: list[bytes]) -> bytes:
    """The bytes the model reads for a text, without the start."""
    return b"".join([b" " + w for w in words]) + END_WORD


class _Symbols:
    """The symbols of some texts side by side, ``DEPTH`` ends before each text as its start."""

    def __init__(self, texts: list[bytes]) -> None:
        start = END_WORD * DEPTH + b" "
        data = np.frombuffer(bytearray(b"".join([x for t in texts for x in (start, t, END_WORD)]).lower()), np.uint8)
        solid = (data != 32) & (data - np.uint8(9) >= 5)
        lead = np.zeros(len(data), bool)
        np.greater(solid[1:], solid[:-1], out=lead[:-1])
        data[lead] = 32
        keep = solid | lead
        ends = np.cumsum([len(t) + len(start) + 1 for t in texts])
        firsts = np.append(0, ends[:-1])
        marks = np.concatenate([ends - 1, *[firsts + i for i in range(DEPTH)]])
        keep[marks] = True
        self.data = data[keep]
        #: how many symbols each text has, and where its start begins
        self.lengths = np.add.reduceat(keep, firsts, dtype=np.int64) - DEPTH
        self.firsts = np.cumsum(self.lengths + DEPTH) - self.lengths - DEPTH

    def grams(self) -> np.ndarray:
        """For every symbol of the texts the number of its context and itself."""
        whole = np.append(self.data, np.zeros(8, np.uint8))
        at_every_byte = np.ndarray(len(self.data), ">i8", whole, strides=(1,))
        keep = np.ones(len(self.data), bool)
        for back in range(1, DEPTH + 1):
            keep[self.firsts + DEPTH + self.lengths - back] = False
        return (at_every_byte.astype(np.uint64) >> np.uint64(8 * (7 - DEPTH)))[keep].view(np.int64)

    def words(self) -> tuple[pa.Array, np.ndarray]:
        """The words of the texts, each text's followed by its end, and how many each text has."""
        data, ends = self.data, self.firsts + DEPTH + self.lengths - 1
        lead = data == 32
        lead[ends] = True
        at = np.flatnonzero(lead)
        last = data[at] != 32
        sizes = np.diff(at, append=len(data)) - 1
        sizes[last] = 1
        inside = data != 32
        for back in range(DEPTH):
            inside[self.firsts + back] = False
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        return words, np.diff(np.flatnonzero(last), prepend=-1)


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of bytes; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, a bounded number of bytes at a time, and the row at which each part begins."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)).tolist() + [len(texts)]
    for first, last in zip(edges, edges[1:]):
        yield first, texts.slice(first, last - first).cast(pa.binary()).to_pylist()


def _counted_grams(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams in order, and how often each comes; the input is sorted in place."""
    gram.sort()
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    return gram[at], np.diff(at, append=len(gram))


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of two sorted lists of counts."""
    (gram, n), (more, m) = one, other
    if not len(gram):
        return other
    place = np.searchsorted(gram, more)
    known = gram[np.minimum(place, len(gram) - 1)] == more
    n = n.copy()
    n[place[known]] += m[known]
    new = ~known
    at = place[new] + np.arange(np.count_nonzero(new))
    old = np.ones(len(gram) + len(at), bool)
    old[at] = False
    both = np.empty(len(old), np.int64), np.empty(len(old), np.int64)
    for out, here, there in zip(both, (gram, n), (more[new], m[new])):
        out[old], out[at] = here, there
    return both


class _Tally:
    """Counts of grams and words of the training texts; texts held out only name theirs, with a count of 0.

    Grams are sorted numbers and words lie in Arrow buffers, so a worker holds 16 bytes
    a gram and a word's bytes and 12. They are passed on as soon as they take
    ``TALLY_BYTES``; merging holds them twice, with what came since the last merge.
    """

    def __init__(self, block: int | None = None) -> None:
        self.block = block
        self.clear()

    def clear(self) -> None:
        self.grams = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # not yet merged: of training texts and of others
        self.new: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.words: list[pa.Table] = []

    def add(self, texts: pa.Array, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, some in _parts(texts, MERGE_BYTES):
            held_some = held[at : at + len(some)]
            for first, last in _pieces(some, PIECE_BYTES):
                for kind in (False, True):
                    own = [some[i] for i in range(first, last) if held_some[i] == kind]
                    if not own:
                        continue
                    read = _Symbols(own)
                    gram, found = read.grams(), read.words()[0].value_counts()
                    self.new[kind].append(gram)
                    self.words.append(_counted(found.field(0), pc.multiply(found.field(1), int(not kind))))
                if sum(g.nbytes for new in self.new for g in new) > MERGE_BYTES:
                    self.merge_grams()
                # hashing words is dear, so they wait until they are as many as those merged before
                if sum(w.nbytes for w in self.words[1:]) > max(MERGE_BYTES // 4, self.words[0].nbytes):
                    self.merge_words()
                if sum(x.nbytes for x in (*self.grams, self.words[0])) > TALLY_BYTES:
                    yield from self.flush()

    def merge_grams(self) -> None:
        for kind, new in enumerate(self.new):
            if new:
                gram, n = _counted_grams(np.concatenate(new))
                new.clear()
                self.grams = _added(self.grams, (gram, n * (not kind)))

    def merge_words(self) -> None:
        words = pa.concat_tables(self.words)
        found = words.column("word").combine_chunks().dictionary_encode()
        n = np.bincount(found.indices.to_numpy(), words.column("n").to_numpy(), len(found.dictionary))
        self.words = [_counted(found.dictionary, pa.array(n.astype(np.int64)))]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        self.merge_grams()
        self.merge_words()
        (gram, n), words = self.grams, self.words[0]
        for at in range(0, len(gram), BATCH_ROWS):
            some = pa.array(gram[at : at + BATCH_ROWS])
            yield self._batch(some, pa.repeat(pa.scalar(NO_WORD, pa.binary()), len(some)), pa.array(n[at : at + BATCH_ROWS], pa.int64()))
        for some in words.to_batches(max_chunksize=BATCH_ROWS):
            yield self._batch(pa.repeat(pa.scalar(A_WORD, pa.int64()), len(some)), some.column("word"), some.column("n"))
        self.clear()
        # what the buffers took goes back, as this process is used again
        pa.default_memory_pool().release_unused()

    def _batch(self, gram: pa.Array, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
        if self.block is None:
            return pa.RecordBatch.from_arrays([gram, word, n], names=["gram", "word", "n"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), self.block), pa.int64()), gram, word], names=["block", "gram", "word"])


def _counted(words: pa.Array, n: pa.Array) -> pa.Table:
    return pa.table({"word": words, "n": pc.cast(n, pa.int64())})


def _numbered(rows: DataFrame) -> DataFrame:
    """Words get a negative number made of their bytes, which sorts them faster than the bytes do; it is short, as it cannot be compressed."""
    return rows.withColumn("gram", F.when(F.col("gram") < 0, F.lit(A_WORD) - F.pmod(F.xxhash64("word"), F.lit(1 << 22))).otherwise(F.col("gram")))


def count_corpus(rows: DataFrame) -> DataFrame:
    """``(gram, word, n)``: training counts of all grams and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            yield from tally.add(batch.column("text"), batch.column("held_out").to_numpy(zero_copy_only=False))
        yield from tally.flush()

    return _numbered(rows.mapInArrow(run, "gram bigint, word binary, n bigint")).groupBy("gram", "word").agg(F.sum("n").alias("n"))


def tree_probabilities(grams: DataFrame, depth: int = DEPTH, min_gain: float = MIN_GAIN) -> DataFrame:
    """``(gram, p)``: the probability of a gram's last byte after its longest retained suffix.

    ``grams`` has ``(gram, n)`` for contexts of ``depth`` bytes. A context has at most 256
    next bytes, so no window holds more rows.
    """
    levels = [grams.select("gram", "n")]
    for k in range(depth, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n")))
    below = None
    for k, level in enumerate(reversed(levels)):
        own = level.withColumn("context", F.shiftright("gram", 8))
        w = Window.partitionBy("context")
        if below is None:
            joined = own.withColumn("q", F.lit(UNIFORM))
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
            joined = own.withColumn("suffix", shorter).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        seen = joined.withColumns({"total": F.sum("n").over(w), "kinds": F.sum((F.col("n") > 0).cast("bigint")).over(w)})
        ratio = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).otherwise(0.0)
        tested = seen.withColumn("gain", F.sum(ratio).over(w))
        weight = PARENT_WEIGHT * F.col("kinds")
        smooth = (F.col("n") + weight * F.col("q")) / (F.col("total") + weight)
        kept = (F.col("total") > 0) & (F.lit(k == 0) | (F.col("gain") >= min_gain))
        below = tested.select("gram", F.when(kept, smooth).otherwise(F.col("q")).alias("p"))
    return below


def _written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder; the shuffle that made them is removed."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def score(docs: DataFrame, held_out: Column | None = None, min_gain: float = MIN_GAIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Learns from the rows where ``held_out`` is false (default: crc32 of the id as text,
    modulo 10, is not 0) and scores all rows. A null text is empty and is its end alone;
    a null id counts as empty text; repeated ids and rows are counted and scored each;
    without a training row every byte has probability 1/256; an empty table gives no
    rows; other columns are not read.
    """
    held_out = (id_bucket(FOLDS) == HELD_OUT) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = _written(count_corpus(rows))
    is_word = F.col("gram") < 0
    total, kinds = counts.filter(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).collect()[0]
    tree = tree_probabilities(counts.filter(~is_word).select("gram", "n"), DEPTH, min_gain)
    values = counts.filter(is_word).select("gram", "word", F.col("n").alias("value")).unionByName(
        tree.select("gram", F.lit(NO_WORD).alias("word"), F.round(F.log10("p") / UNIT).cast("bigint").alias("value"))
    )
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks))).repartition("block").sortWithinPartitions("block")
    wanted = _numbered(dealt.mapInArrow(_wanted_rows, "block bigint, gram bigint, word binary"))
    answers = wanted.join(values, ["gram", "word"]).select("block", F.greatest("gram", F.lit(A_WORD)).alias("gram"), "word", "value")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(int(total), int(kinds)), schema)


def _wanted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams and words of each block; the rows come block by block."""
    tally = None
    for batch in batches:
        block, texts = batch.column("block").to_numpy(), batch.column("text")
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(0, np.int64)
        for first, last in zip(edges, edges[1:]):
            if tally is None or tally.block != block[first]:
                if tally:
                    yield from tally.flush()
                tally = _Tally(int(block[first]))
            yield from tally.add(texts.slice(first, last - first), np.ones(last - first, bool))
    if tally:
        yield from tally.flush()


class _Places:
    """Where each of some different 64-bit numbers stands, by buckets of their upper bits once mixed."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.shift = np.uint64(63 - len(numbers).bit_length())
        bucket = self._bucket(numbers)
        self.order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket)
        self.start = np.append(0, np.cumsum(sizes)).astype(np.int32)
        self.longest = int(sizes.max(initial=0))
        self.numbers = np.append(numbers[self.order], np.zeros(1, numbers.dtype))

    def _bucket(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * MIX) >> self.shift).view(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        bucket = np.minimum(self._bucket(asked), len(self.start) - 1)
        at = self.start[bucket]
        left = np.flatnonzero(self.numbers[at] != asked)
        for _ in range(self.longest):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, len(self.numbers) - 1)
            left = left[self.numbers[at[left]] != asked[left]]
        if len(left) or (len(at) and at.max() >= len(self.order)):
            raise LookupError("a context or word of this block has no value")
        return self.order[at]


def _word_numbers(words: pa.Array, factor: np.uint64) -> np.ndarray:
    """A 64-bit number made of each word's bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(ends)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    powers = np.multiply.accumulate(np.full(int(sizes.max()), factor))
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], ends[:-1] - ends[0])


class _Words:
    """Where each of some different words stands; only these are ever asked for.

    As many numbers as words prove that the numbers tell them apart; else other numbers are tried.
    """

    def __init__(self, words: pa.Array) -> None:
        self.factor = MIX
        while True:
            numbers = np.concatenate([_word_numbers(words.slice(at, BATCH_ROWS), self.factor) for at in range(0, max(1, len(words)), BATCH_ROWS)])
            in_order = np.sort(numbers)
            if (in_order[1:] != in_order[:-1]).all():
                break
            self.factor = self.factor * self.factor + np.uint64(2)
        self.places = _Places(numbers)

    def of(self, words: pa.Array) -> np.ndarray:
        return self.places.of(_word_numbers(words, self.factor))


def _scorer(total: int, kinds: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        is_word = pc.less(answers.column("gram"), 0)
        words = answers.select(["word", "value"]).filter(is_word)
        named, count = words.column("word").combine_chunks(), words.column("value").to_numpy()
        answers = answers.select(["gram", "value"]).filter(pc.invert(is_word))
        value = answers.column("value").to_numpy() * UNIT
        grams = _Places(answers.column("gram").to_numpy())
        del answers, words
        named = _Words(named)
        base, known = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1))), count > 0
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for chunk in docs.column("text").chunks:
            for _, texts in _parts(chunk, MERGE_BYTES):
                for first, last in _pieces(texts, PIECE_BYTES):
                    read = _Symbols(texts[first:last])
                    starts = np.cumsum(read.lengths) - read.lengths
                    out["score"] += np.add.reduceat(value[grams.of(read.grams())], starts).tolist()
                    words, tokens = read.words()
                    place, starts = named.of(words), np.cumsum(tokens) - tokens
                    out["n_tokens"] += tokens.tolist()
                    out["n_known"] += np.add.reduceat(known[place].astype(np.int64), starts).tolist()
                    out["base_score"] += [float(base[place[a : a + n]].sum()) for a, n in zip(starts, tokens)]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
                "train_tokens": pa.array([total] * docs.num_rows, pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
            }
        )

    return run
