"""Columns, splits and word rules that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are [^\x20\x09-\x0D]+: on bytes, split() without an argument cuts at exactly these.
BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_bucket(buckets: int, name: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``buckets``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(buckets))


def lower_words(text: str) -> list[bytes]:
    """The words of a text with A-Z lower-cased; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def unused_name(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what Python makes of the texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose text ``keep`` accepts, with all their columns and without a shuffle; a null text is passed as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep([t or "" for t in batch.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
