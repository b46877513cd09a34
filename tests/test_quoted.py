"""Quoted CSV by byte ranges, against Python's reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from curvine.sources import quoted

SCHEMA = "a string, b string, c string"


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)


def odd_rows(seed, n):
    rng = random.Random(seed)
    parts = ["x", "word ", '"', '""', "\n", "\n\n", ",", "é😀", "\r", "a\nb", ' "quoted, text" ', "\n\"\n"]
    return [[str(i), "".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) + "e", "z" * rng.randint(1, 5)] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_record_of_files_cut_anywhere(spark, tmp_path, small_splits, end):
    want = []
    for k in range(3):
        rows = odd_rows(k, 60)
        write(tmp_path / f"{k}.csv", [["a", "b", "c"], *rows], end)
        want += rows
    lines = quoted._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 30
    got = quoted.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in got.collect()) == sorted(map(tuple, want))


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = 'line "one"\n' * 400
    rows = [["0", "short", "s"], ["1", long, "l"], ["2", "x\n" * 200 + "e", "m"], ["3", "end", "e"]]
    write(tmp_path / "one.csv", rows)
    got = quoted.read_quoted_csv(spark, str(tmp_path), SCHEMA, header=False)
    assert sorted(tuple(r) for r in got.collect()) == sorted(map(tuple, rows))


def test_blank_lines_and_open_ends(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a"\n\n"b\n\nc"\n\n\n"d\nopen', encoding="utf-8")
    got = quoted.read_records(spark, str(tmp_path))
    assert sorted(r.record for r in got.collect()) == ['"a"', '"b\n\nc"', '"d\nopen']
    assert [r.record for r in got.filter("first").collect()] == ['"a"']


def test_no_rows(spark, tmp_path):
    write(tmp_path / "x.csv", [["a", "b", "c"]])
    assert quoted.read_quoted_csv(spark, str(tmp_path), SCHEMA).count() == 0
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "empty.csv").write_text("")
    assert quoted.read_quoted_csv(spark, str(tmp_path / "y"), SCHEMA).count() == 0


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    write(tmp_path / "one.csv", odd_rows(9, 200))
    tasks = quoted._lines(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 10
