"""Streams with state: several micro-batches, restarts, late rows, state that is cleared."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.functions.hashing import sign_matrix
from curvine.sources.sinks import scratch_folder
from curvine.streaming import stateful

START = 1_700_000_000
PLANES = sign_matrix(2, 6, 3)


def arrive(spark, rows, schema, folder, run, steps):
    """Write each step's rows, then run the job to its end; every run after the first is a restart."""
    for part in steps:
        spark.createDataFrame([rows[i] for i in part], schema).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(schema).parquet(f"{folder}/in")).awaitTermination()


@pytest.fixture(scope="module")
def moving():
    """Groups of near copies at different times, one of them with half of the rows."""
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 6))
    rows = []
    for i in range(160):
        c = centers[0] if i % 2 else centers[rng.integers(1, 6)]
        v = c + 0.05 * rng.standard_normal(6)
        v /= np.sqrt((v * v).sum())
        rows.append((i, dt.datetime.fromtimestamp(START + 10 * i, dt.timezone.utc), v.tolist()))
    return rows


def brute(rows, min_sim, keep_s):
    codes = [tuple((PLANES @ np.array(v)) >= 0) for *_, v in rows]
    kept = []
    for (i, t, v), code in zip(rows, codes):
        if not any(c == code and (t - s).total_seconds() < keep_s and np.dot(u, v) > min_sim for _, s, u, c in kept):
            kept.append((i, t, v, code))
    return [i for i, *_ in kept]


@pytest.mark.parametrize("keep_s", [100_000, 400])
def test_filter_over_batches_and_restarts_equals_one_pass(spark, moving, keep_s):
    folder = scratch_folder(spark)
    run = lambda arrivals: stateful.near_duplicate_stream(arrivals, PLANES, 2, 0.9, f"{folder}/out", f"{folder}/c", keep=f"{keep_s} seconds", once=True)
    arrive(spark, moving, "vec_id bigint, ts timestamp, embedding array<double>", folder, run, [range(0, 60), range(60, 61), range(61, 130), range(130, 160)])
    got = spark.read.parquet(f"{folder}/out")
    want = brute(moving, 0.9, keep_s)
    assert sorted(r.id for r in got.collect()) == want
    assert len(want) < 60
    first = got.orderBy("us").first()
    assert first.us == START * 1_000_000 and list(first.vec) == moving[0][2]


def test_copies_do_not_grow_the_state(spark):
    rows = [(i, dt.datetime.fromtimestamp(START + i, dt.timezone.utc), [1.0] * 6) for i in range(300)]
    folder = scratch_folder(spark)
    run = lambda arrivals: stateful.near_duplicate_stream(arrivals, PLANES, 2, 0.5, f"{folder}/out", f"{folder}/c", keep="1 day", once=True)
    arrive(spark, rows, "vec_id bigint, ts timestamp, embedding array<double>", folder, run, [range(0, 200), range(200, 300)])
    assert [r.id for r in spark.read.parquet(f"{folder}/out").collect()] == [0]


def test_old_survivors_leave_the_state(spark, moving):
    """The watermark passes most survivors, so their timers fire between the steps."""
    folder = scratch_folder(spark)
    run = lambda arrivals: stateful.near_duplicate_stream(arrivals, PLANES, 2, 0.9, f"{folder}/out", f"{folder}/c", keep="200 seconds", late="10 seconds", once=True)
    arrive(spark, moving, "vec_id bigint, ts timestamp, embedding array<double>", folder, run, [range(0, 60), range(60, 110), range(110, 160)])
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == brute(moving, 0.9, 200)


STREAMS = ("stream_assign", "stream_ood_score", "stream_anchor_vote", "stream_near_duplicates")


@pytest.mark.parametrize("name", STREAMS)
def test_a_table_may_be_one_file_or_a_folder_of_files(spark, tmp_path, name):
    """Rows a second apart that reach far beyond what the filter keeps and the delay of its watermark."""
    from curvine.queries import QUERIES

    rng = np.random.default_rng(9)
    x = rng.standard_normal((240, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(40 * i, x[i].tolist(), int(rng.integers(0, 10))) for i in range(240)]
    # the first centres are the rows with the smallest ids
    rows += [(i, x[i].tolist(), 0) for i in range(1, 10)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = []
    for kind, parts in (("one", 1), ("many", 5)):
        folder = f"{tmp_path}/{kind}"
        frame.repartition(parts).write.parquet(f"{folder}/embeddings.parquet")
        if kind == "one":
            whole = next((tmp_path / kind / "embeddings.parquet").glob("*.parquet"))
            (tmp_path / "file").mkdir()
            (tmp_path / "file" / "embeddings.parquet").write_bytes(whole.read_bytes())
            folder = f"{tmp_path}/file"
        found.append(sorted(tuple(r) for r in QUERIES[name](spark, folder).collect()))
    assert found[0] and found[0] == found[1]


def test_the_state_store_setting_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    with stateful.rocksdb(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKSDB
    assert spark.conf.get(stateful.PROVIDER, None) == before


def events(n=400):
    rng = np.random.default_rng(7)
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), "ab"[i % 2], round(float(rng.uniform(0, 60)), 2) if i % 13 else None) for i in range(n)]


EVENT = "event_id bigint, ts timestamp, kind string, value double"


def plain(rows, upto=None):
    """Statistics by day and kind of the days that end at ``upto`` or before."""
    out = {}
    for _, t, kind, v in rows:
        out.setdefault((t.date(), kind), []).append(v)
    found = {}
    for (day, kind), values in out.items():
        if upto is None or dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) <= upto:
            x = np.array([v for v in values if v is not None])
            found[str(day), kind] = (len(x), int((x > 30).sum()), round(float(x.mean()), 6), round(float(x.std()), 6), round(float((x > 30).mean()), 6))
    return found


def as_dict(frame):
    return {(str(r.window_start.date()), r.kind): (r.n, r.n_flagged, round(r["mean"], 6), round(r["std"], 6), round(r.flagged_share, 6)) for r in frame.collect()}


def test_windows_come_out_once_and_late_rows_stay_out(spark):
    rows = events()
    folder = scratch_folder(spark)
    run = lambda arrivals: stateful.window_stats_stream(arrivals, F.col("value") > 30, f"{folder}/out", f"{folder}/c", late="6 hours", by=("kind",), once=True)
    # the first rows come once more at the end, days behind the watermark
    arrive(spark, rows, EVENT, folder, run, [range(0, 150), range(150, 300), [*range(300, 400), *range(0, 20)]])
    out = spark.read.parquet(f"{folder}/out")
    assert as_dict(out) == plain(rows, rows[-1][1] - dt.timedelta(hours=6))
    assert out.count() == out.dropDuplicates(["window_start", "kind"]).count()


def test_rows_within_the_delay_count(spark):
    rows = events(200)
    folder = scratch_folder(spark)
    run = lambda arrivals: stateful.window_stats_stream(arrivals, F.col("value") > 30, f"{folder}/out", f"{folder}/c", late="3 days", by=("kind",), once=True)
    # every fifth row comes a step later, within the delay
    steps = [[i for i in range(200) if min(2, i // 67 + (i % 5 == 0)) == s] for s in range(3)]
    arrive(spark, rows, EVENT, folder, run, steps)
    assert as_dict(spark.read.parquet(f"{folder}/out")) == plain(rows, rows[-1][1] - dt.timedelta(days=3))


def test_a_table_gives_all_windows_and_drift_compares_them(spark):
    rows = events(300)
    table = spark.createDataFrame(rows, EVENT)
    stats = stateful.window_stats(table, F.col("value") > 30, by=("kind",))
    assert as_dict(stats) == plain(rows)
    past = spark.createDataFrame([("a", 20.0, 5.0), ("b", 40.0, 0.0)], "kind string, mean double, std double")
    moved = {(r.kind, str(r.window_start)): (r["mean"], r["shift"]) for r in stateful.drift(stats, past, ("kind",)).collect()}
    assert all(abs(s - (m - 20.0) / 5.0) < 1e-9 if k == "a" else s is None for (k, _), (m, s) in moved.items())


def test_no_rows(spark):
    empty = spark.createDataFrame([], EVENT)
    assert stateful.window_stats(empty, F.col("value") > 30).count() == 0
