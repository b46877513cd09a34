"""Quoted CSV whose values hold line breaks, read by byte ranges.

A line break inside quotes is part of a value, so a reader that begins in the middle of a
file cannot tell where a record ends, and Spark's reader takes such a file as one task. But
quotes tell: a record ends at a line break before which the file has an even number of them
(a doubled quote inside a value counts twice). So the file is read as lines in splits, a
first pass counts the quotes of every split, a running total over the splits gives the
parity at which each begins, and a second pass cuts all splits into records at once. Only
the pieces of records that lie across a border of splits are moved and put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvine.plans.bounded import MAX_BROADCAST_BYTES, TooLarge
from curvine.plans.ranking import running_totals
from curvine.session import checkpoint

WHOLE, GOES_ON, BEGINS = 0, 1, 2
PIECES = "file string, block bigint, kind int, first boolean, text string"
# File name, place and parity of a split.
SPLIT_BYTES = 200


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block)``: lines in the order of the file inside each split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _begin_inside(lines: DataFrame, quote: str) -> DataFrame:
    """``(file, block, inside)``: whether a split begins inside quotes; a row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    totals = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    upto = running_totals(totals, [F.col("block")], {"upto": F.col("quotes")}, ["file"], settle=True)
    return upto.select("file", "block", ((F.col("upto") - F.col("quotes")) % 2 == 1).alias("inside"))


class _Cutter:
    """Records of one split from its lines, batch after batch."""

    def __init__(self, file: str, block: int, inside: bool, quote: str) -> None:
        self.file, self.block, self.inside, self.quote = file, block, inside, quote
        self.held: list[str] = []
        # lines before the first start belong to a record of an earlier split
        self.started = not inside
        self.first = block == 0

    def add(self, lines: pa.Array) -> Iterator[tuple]:
        after = (np.cumsum(pc.count_substring(lines, self.quote).to_numpy(zero_copy_only=False)) + self.inside) % 2 == 1
        for line, inside in zip(lines.to_pylist(), after):
            if not self.held and not self.inside and line.rstrip("\r") == "":
                continue
            self.held.append(line)
            if not inside:
                yield self._out(WHOLE if self.started else GOES_ON)
                self.started = True
            self.inside = bool(inside)

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self._out(BEGINS if self.started else GOES_ON)

    def _out(self, kind: int) -> tuple:
        row = (self.file, self.block, kind, self.first, "\n".join(self.held))
        self.held, self.first = [], False
        return row


def _cut(quote: str):
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks, inside = (batch.column(c).to_pylist() for c in ("file", "block", "inside"))
            edges = [0, *[i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])], len(files)]
            for a, b in zip(edges, edges[1:]):
                rows: list[tuple] = []
                if cutter is None or (cutter.file, cutter.block) != (files[a], blocks[a]):
                    rows += cutter.end() if cutter else []
                    cutter = _Cutter(files[a], blocks[a], inside[a], quote)
                rows += cutter.add(batch.column("value").slice(a, b - a))
                if rows:
                    yield table(rows)
        if cutter and (rows := list(cutter.end())):
            yield table(rows)

    return run


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, first, record)``: the records of CSV files as text; ``first`` marks the first one of a file.

    Blank lines outside quotes are no records. A file that ends inside quotes gives what
    it holds as its last record.
    """
    lines = _lines(spark, path)
    splits = checkpoint(_begin_inside(lines, quote))
    if splits.count() * SPLIT_BYTES > MAX_BROADCAST_BYTES:
        raise TooLarge("too many splits; raise spark.sql.files.maxPartitionBytes")
    # the join must not move the lines, as their order inside a split is the file's
    pieces = lines.join(F.broadcast(splits), ["file", "block"]).select("value", "file", "block", "inside").mapInArrow(_cut(quote), PIECES)
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", F.col("text").alias("record"))
    # at most two pieces a split; one that begins opens a record, those that go on follow it
    parts = checkpoint(pieces.filter(F.col("kind") != WHOLE))
    named = running_totals(parts, [F.col("block"), F.col("kind")], {"nth": (F.col("kind") == BEGINS).cast("bigint")}, ["file"])
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    joined = named.groupBy("file", "nth").agg(F.max("first").alias("first"), F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("record"))
    return whole.unionByName(joined.select("file", "first", "record"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """CSV files as columns, each file read by as many tasks as it has splits; a doubled quote stands for one."""
    rows = read_records(spark, path, quote)
    if header:
        rows = rows.filter(~F.col("first"))
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}
    return rows.select(F.from_csv(F.regexp_replace("record", "\r$", ""), schema, options).alias("r")).select("r.*")
