"""Labelled text readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvine.sources.quoted import read_quoted_csv


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order, so that a rerun reads the same rows."""
    return df.orderBy(*order).limit(n)


@dataclass(frozen=True)
class TextTask:
    """Where a task's file keeps its texts and label; columns count from 0, -1 is the last."""

    text_a: int | str | tuple
    label: int | str
    text_b: int | str | None = None
    sep: str = "\t"
    header: bool = True
    quote: str = ""
    labels: tuple[str, ...] = ()
    label_rule: str = ""


REST = "rest"  # every column but the label's, joined by commas

# The column layout of each task's files.
TASKS = {
    "cola": TextTask(3, 1, header=False),
    "sst-2": TextTask(0, 1),
    "mrpc": TextTask(3, 0, text_b=4),
    "mnli": TextTask(8, -1, text_b=9),
    "sts-b": TextTask(7, -1, text_b=8),
    "qqp": TextTask(3, 5, text_b=4),
    "qnli": TextTask(1, -1, text_b=2),
    "rte": TextTask(1, -1, text_b=2),
    "wnli": TextTask(1, -1, text_b=2),
    "ag_news": TextTask("text", "label", sep=",", quote='"'),
    "dbpedia": TextTask(REST, 0, sep=",", header=False, quote='"'),
    "imdb": TextTask(REST, -1, sep=",", quote='"'),
    "twitterppdb": TextTask(0, 2, text_b=1, header=False, label_rule="votes"),
    "pubmed": TextTask(0, 1, header=False),
    "nli": TextTask(0, 2, text_b=1),
    "sentiment": TextTask(1, 0, labels=("Negative", "Positive")),
}

# A paraphrase with fewer votes than this is class 0, exactly this many votes is dropped.
VOTES = 3


def _pick(df: DataFrame, spec: int | str, label: int | str) -> Column:
    names = df.columns
    if spec == REST:
        drop = names[label] if isinstance(label, int) else label
        return F.concat_ws(",", *[F.col(f"`{c}`") for c in names if c != drop])
    return F.col(f"`{names[spec] if isinstance(spec, int) else spec}`")


def read_text_task(spark: SparkSession, path: str, task: str, *, labels: tuple[str, ...] = ()) -> DataFrame:
    """``(text_a, text_b, label)`` of a task's file; rows without text or label are dropped."""
    spec = TASKS[task]
    if spec.quote:
        # the names come from the head of a file; the records from all splits of all files
        names = spark.read.csv(path, sep=spec.sep, header=spec.header, quote=spec.quote, escape=spec.quote, multiLine=True).columns
        df = read_quoted_csv(spark, path, ", ".join(f"`{n}` string" for n in names), sep=spec.sep, header=spec.header, quote=spec.quote)
    else:
        df = spark.read.csv(path, sep=spec.sep, header=spec.header, quote=spec.quote, mode="PERMISSIVE")
    text_b = _pick(df, spec.text_b, spec.label) if spec.text_b is not None else F.lit(None).cast("string")
    rows = df.select(_pick(df, spec.text_a, spec.label).alias("text_a"), text_b.alias("text_b"), _pick(df, spec.label, spec.label).alias("label"))
    rows = rows.filter(F.col("text_a").isNotNull() & F.col("label").isNotNull())
    if spec.text_b is not None:
        rows = rows.filter(F.col("text_b").isNotNull())
    if spec.label_rule == "votes":
        votes = F.regexp_extract("label", r"(\d)", 1).try_cast("int")
        rows = rows.withColumn("label", votes).filter((F.col("label") != VOTES) & (F.trim("text_a") != "") & (F.trim("text_b") != ""))
        rows = rows.withColumn("label", F.when(F.col("label") < VOTES, "0").otherwise("1"))
    allowed = labels or spec.labels
    return rows.filter(F.col("label").isin(*allowed)) if allowed else rows


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """ISO-8859-1 lines ``CLASS:detail word word ...``: the class, and the words after the first field."""
    lines = spark.read.csv(path, sep="\u0001", quote="", encoding="ISO-8859-1", schema="line string")
    first = F.split("line", " ")
    return lines.filter(F.col("line").isNotNull()).select(
        F.regexp_replace("line", r"^\S+ ", "").alias("text_a"), F.lit(None).cast("string").alias("text_b"), F.split(first[0], ":")[0].alias("label")
    )


def read_jsonl(spark: SparkSession, folder: str, split: str, schema: str = "sentence string, label string") -> DataFrame:
    """``<folder>/<split>.jsonl``, one object per line."""
    return spark.read.schema(schema).json(f"{folder}/{split}.jsonl")


def read_xy_json(spark: SparkSession, path: str, *, per_line: bool = False) -> DataFrame:
    """Files holding ``[[texts], [labels]]``: ``(position, text, label)``.

    Such an array is one value of one file and is read by one task; ``per_line``
    reads files with one array per line, which split.
    """
    whole = spark.read.text(path, wholetext=not per_line)
    parts = F.from_json("value", "array<array<string>>")
    zipped = whole.select(parts.alias("p")).select(F.posexplode(F.arrays_zip(F.col("p")[0].alias("text"), F.col("p")[1].alias("label"))).alias("position", "r"))
    return zipped.select("position", F.col("r.text").alias("text"), F.col("r.label").alias("label"))


def read_libsvm(spark: SparkSession, path: str, *, signed: bool, dim: int | None = None) -> DataFrame:
    """Dense vectors ``(label, features)``; labels -1/1 become 0/1, labels from 1 start at 0."""
    reader = spark.read.format("libsvm")
    df = (reader.option("numFeatures", dim) if dim else reader).load(path)
    label = F.when(F.col("label") == -1, 0).otherwise(F.col("label").cast("int")) if signed else F.col("label").cast("int") - 1
    return df.select(label.alias("label"), vector_to_array("features").alias("features"))
