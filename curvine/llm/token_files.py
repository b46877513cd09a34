"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but ids of a fixed width, one end-of-document id after each
document. Files are cut into blocks at fixed places, wherever documents lie. Each block
is searched for the end id in one vectorised pass and reports the places it found. A
prefix scan over the blocks of a file, of the number of ends before a block and of the
last place among them, stitches the documents that cross blocks. Tokens are read once
and never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvine.llm.common import text_of
from curvine.llm.tokenizing import encoder, public_path
from curvine.session import checkpoint
from curvine.sources.embeddings import open_uri
from curvine.sources.sinks import scratch_folder

BLOCK_TOKENS = 2 * 1024 * 1024
VOCABULARY, END_ID = "byte_bpe_multi_50k.tiktoken", 50256
DTYPE = "<u2"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """Write one flat token file per task; ``(path, length, doc_ids)`` of each, in the order of its documents.

    A rerun task writes a file with a new name, and only the names in the result count.
    A null or empty text is its end alone; null and repeated ids and repeated rows each have
    their place; an empty table may give files without a document; other columns are not read.
    """
    path = path or public_path(VOCABULARY)
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_uri(folder)
        system.create_dir(base, recursive=True)
        encode, ids, size, name = encoder(path), [], 0, f"tokens-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                ids += batch.column("doc_id").to_pylist()
                for text in batch.column("text").to_pylist():
                    size += out.write(encode(text).astype(dtype).tobytes() + end)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["path", "length", "doc_ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return checkpoint(rows.mapInArrow(run, "path string, length bigint, doc_ids array<bigint>"))


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def scan_token_files(files: DataFrame, end_id: int = END_ID, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(path, nth, start, n_tokens, ended)``: one row per document of every file in ``(path, length)``.

    ``nth`` counts documents from 0 inside the file, ``start`` is the first token's place,
    ``n_tokens`` leaves the end id out. Two end ids in a row hold an empty document
    between them. Tokens after the last end id are a document that has not ended; an
    empty file has no document; a length that is no multiple of the id width fails.
    """
    width = np.dtype(dtype).itemsize
    checked = F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" ends inside an id"))).cast("bigint"))
    tokens = F.expr(f"tokens div {block_tokens}")
    blocks = (
        files.select("path", (checked / width).cast("bigint").alias("tokens"))
        .select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), tokens)).alias("block"))
        .repartition("path", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, block in zip(*[batch.column(c).to_pylist() for c in ("path", "tokens", "block")]):
                system, name = open_uri(path)
                first = block * block_tokens
                count = min(block_tokens, total - first)
                with system.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(count * width, first * width), dtype)
                if len(ids) != count:
                    raise OSError(f"{path} is shorter than {total} ids")
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total], pa.int64()), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "tokens", "block", "ends"])

    found = checkpoint(blocks.mapInArrow(run, "path string, tokens bigint, block bigint, ends array<bigint>"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    count, last = F.size("ends").cast("bigint"), F.try_element_at("ends", F.lit(-1))
    # the scan runs over one short row per block; the places stay behind in ``found``
    scan = found.select("path", "block", count.alias("n"), last.alias("last")).select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before")
    )
    spans = F.transform("ends", lambda end, i: F.struct(i.cast("bigint").alias("i"), end.alias("end"), F.when(i > 0, F.get("ends", i - 1)).alias("previous")))
    each = found.join(scan, ["path", "block"]).select("path", "docs_before", "end_before", F.explode(spans).alias("s"))
    start = F.coalesce("s.previous", "end_before") + 1
    ended = each.select("path", (F.col("docs_before") + F.col("s.i")).alias("nth"), start.alias("start"), (F.col("s.end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = found.groupBy("path").agg(F.max("tokens").alias("tokens"), F.sum(count).alias("nth"), (F.coalesce(F.max(last), F.lit(-1)) + 1).alias("start"))
    open_ended = tails.filter("tokens > start").select("path", "nth", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_ended)


def count_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, n_tokens)`` by writing token files to the shared folder and scanning them.

    A null or empty text has 0 tokens; null and repeated ids and repeated rows are
    counted each for itself; an empty table gives no rows; other columns are not read.
    """
    written = write_token_files(docs, scratch_folder(docs.sparkSession), path, end_id)
    counted = scan_token_files(written.select("path", "length"), end_id)
    names = written.select("path", F.posexplode("doc_ids").alias("nth", "doc_id")).withColumn("nth", F.col("nth").cast("bigint"))
    return names.join(counted, ["path", "nth"]).select("doc_id", "n_tokens")
