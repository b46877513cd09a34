import json
import math
import os
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.functions import text as T
from curvine.operators import evaluation as ev
from curvine.sources import embeddings as E
from curvine.sources import sinks, texts
from curvine.operators import knn, prompting
from curvine.streaming import jobs


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 40)) for _ in range(2))
        assert ev.lcs_length(a, b) == lcs(a, b)


def sentences(seed, n):
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choices(["a", "b", "c", "D", "e"], k=rng.randint(0, 9)))
    return [(i, make(), make(), [make() for _ in range(rng.randint(1, 3))]) for i in range(n)]


@pytest.fixture(scope="module")
def triples(spark):
    rows = sentences(4, 60) + [(900, "", "", [""]), (901, "a b c d", "", ["a b c d e"])]
    return spark.createDataFrame(rows, "doc_id bigint, source string, prediction string, references array<string>"), rows


def grams(text, n):
    w = text.lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def share(part, whole):
    return sum(part.values()) / sum(whole.values()) if whole else 0


def plain_sari(src, pred, refs):
    total = 0.0
    for n in range(1, 5):
        s, p = grams(src, n), grams(pred, n)
        for ref in refs:
            r = grams(ref, n)
            kp, kr = share((s & p) & r, s & p), share((s & p) & r, s & r)
            keep = 2 * kp * kr / (kp + kr) if kp + kr else 0
            total += (keep + share((p - s) & (r - s), p - s) + share((s - p) & (s - r), s - p)) / len(refs)
    return total / 4 / 3 * 100


def test_sari_against_counters(triples):
    df, rows = triples
    got = {r["doc_id"]: r["sari"] for r in ev.sari(df, id_col="doc_id").collect()}
    for i, s, p, refs in rows:
        assert math.isclose(got[i], plain_sari(s, p, refs), abs_tol=1e-9), i


def test_rouge_l_against_the_table(triples):
    df, rows = triples
    got = {r["doc_id"]: r["rouge_l"] for r in ev.rouge_l(df, id_col="doc_id").collect()}
    for i, _, p, refs in rows:
        best = 0.0
        for ref in refs:
            a, b = p.lower().split(), ref.lower().split()
            n = lcs(a, b)
            best = max(best, 200 * n / (len(a) + len(b)) if n else 0.0)
        assert math.isclose(got[i], best, abs_tol=1e-9)


def test_bleu_of_equal_texts_is_100(spark):
    df = spark.createDataFrame([(0, "a b c d e f", ["a b c d e f", "z"])], "doc_id bigint, prediction string, references array<string>")
    assert math.isclose(ev.bleu(df, id_col="doc_id").collect()[0]["bleu"], 100.0)


def test_bleu_counts_by_plain_counting(spark):
    """Nulls, blanks, repeated and null ids, any number of references; n-grams never leave their task."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join(rng.choice(list("abcde"), rng.integers(0, 9)))
    rows = [(int(i) if i % 7 else None, text() if i % 11 else " ", [text() for _ in range(rng.integers(0, 4))]) for i in np.repeat(np.arange(30), 2)]
    rows += [(50, "a\tb  c\n", ["a b c", None]), (51, "a b", None), (52, "a b c", ["a", "a b c d e"])]
    grams = lambda t, n: Counter(tuple(w[i : i + n]) for w in [(t or "").split()] for i in range(len(w) - n + 1))
    groups = {}
    for i, p, refs in rows:
        if refs is not None:
            groups.setdefault((i, len(refs)), []).append([p, *refs])
    logs = 0.0
    for n in range(1, 5):
        hit = total = 0
        for members in groups.values():
            sides = [sum((grams(t, n) for t in side), Counter()) for side in zip(*members)]
            best = {g: max((s[g] for s in sides[1:]), default=0) for g in sides[0]}
            hit, total = hit + sum(min(k, best[g]) for g, k in sides[0].items()), total + sum(sides[0].values())
        logs += math.log(hit / total) / 4
    hyp = sum(len(p.split()) for _, p, _ in rows)
    ref = sum(min((abs(len(r.split()) - len(p.split())), len(r.split())) for r in refs)[1] for _, p, refs in rows if refs and None not in refs)
    frame = spark.createDataFrame(rows, "doc_id bigint, prediction string, references array<string>")
    found = ev.bleu(frame, id_col="doc_id")
    got = found.collect()[0]
    assert (got.hyp_len, got.ref_len) == (hyp, ref)
    assert math.isclose(got.bleu, 100 * math.exp(logs) * min(1.0, math.exp(1 - ref / hyp)))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert ev.bleu(frame.limit(0), id_col="doc_id").collect()[0].hyp_len is None


def test_ngrams_are_not_shuffled(triples):
    df, _ = triples
    plan = ev._gram_counts(df, "doc_id", {ev.PREDICTION: F.col("prediction")}, "references", True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_mask_texts_equals_mask_tokens(spark, monkeypatch):
    monkeypatch.setattr(T, "MASK_ROWS", 3)
    monkeypatch.setattr(T, "MASK_TOKENS", 50)
    rows = [(1, "plain words " * 20), (2, None), (3, ""), (None, "no id here"), (-4, "below zero 😀 ünï" * 9), (2**33, "a large id " * 5), (1, "twice"), (1, "twice"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    ids = docs.select("doc_id", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("ids"))
    inputs, labels = T.mask_tokens("doc_id", "ids", mask_id=103, vocab=1000, special=[32], rate=0.3, seed=2)
    got = T.mask_texts(docs, "doc_id", "text", mask_id=103, vocab=1000, special=[32], rate=0.3, seed=2)
    assert sorted(map(str, got.collect())) == sorted(map(str, ids.select("doc_id", inputs.alias("input_ids"), labels.alias("labels")).collect()))


def test_mask_tokens_shares_and_repeat(spark):
    df = spark.createDataFrame([(i, [7] * 500) for i in range(20)], "id bigint, ids array<int>")
    inputs, labels = T.mask_tokens("id", "ids", mask_id=1, vocab=1000, seed=3)
    rows = df.select(inputs.alias("x"), labels.alias("y")).collect()
    chosen = sum(y != -100 for r in rows for y in r["y"])
    masked = sum(x == 1 for r in rows for x in r["x"])
    kept = sum(x == 7 and y == 7 for r in rows for x, y in zip(r["x"], r["y"]))
    assert abs(chosen / 10000 - 0.15) < 0.015 and abs(masked / chosen - 0.8) < 0.05 and abs(kept / chosen - 0.1) < 0.04
    assert rows == df.select(inputs.alias("x"), labels.alias("y")).collect()
    special, _ = T.mask_tokens("id", "ids", mask_id=1, vocab=1000, special=[7])
    assert all(set(r["x"]) == {7} for r in df.select(special.alias("x")).collect())


def test_detect_pair_and_templates(spark):
    assert T.detect_pair(["id", "Complex", "Simple"]) == ("Complex", "Simple")
    assert T.detect_pair(["x", "y"]) == ("x", "y")
    df = spark.createDataFrame([("p", "h", "no")], "p string, h string, l string")
    fields = {"sentence_1": "p", "sentence_2": "h", "label": "l"}
    assert df.select(T.prompt("rte", fields)).collect()[0][0] == "premise: p\nhypothesis: h\nprediction:"
    assert df.select(T.prompt("rte", fields, "train")).collect()[0][0] == "premise: p\nhypothesis: h\nprediction: no\n"


def test_npy_and_raw_matrices(spark):
    x = np.arange(120, dtype="<f4").reshape(30, 4)
    path = folder()
    np.save(f"{path}/a.npy", x[:11])
    np.save(f"{path}/b.npy", x[11:].astype("<f8"))
    df = E.read_matrix(spark, path, rowsPerTask=4)
    assert df.rdd.getNumPartitions() == 8
    assert [r["embedding"] for r in df.orderBy("vec_id").collect()] == x.tolist()
    raw = f"{folder()}/m.dat"
    x.tofile(raw)
    assert [r["embedding"] for r in E.read_matrix(spark, raw, dim=4, rowsPerTask=7).orderBy("vec_id").collect()] == x.tolist()


def test_wrong_dimension_fails(spark):
    path = folder()
    spark.createDataFrame([(0, [1.0, 2.0])], "vec_id bigint, embedding array<float>").write.mode("overwrite").parquet(path)
    assert E.load_embeddings(spark, path, dim=3).select("vec_id").count() == 1
    with pytest.raises(Exception, match="expected 3 dimensions"):
        E.load_embeddings(spark, path, dim=3).collect()


def write(name, text, encoding="utf-8"):
    path = os.path.join(folder(), name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def rows_of(df):
    return sorted((r["text_a"], r["text_b"], r["label"]) for r in df.collect())


def test_text_tasks(spark):
    qqp = write("q.tsv", 'id\tq1\tq2\ta\tb\tl\n1\t1\t2\tx "quoted\ty\t1\n2\t1\n3\t1\t2\tu\tv\t0\n')
    assert rows_of(texts.read_text_task(spark, qqp, "qqp")) == [("u", "v", "0"), ('x "quoted', "y", "1")]
    cola = write("c.tsv", "s\t1\t\tFine text.\ns\t0\t*\tBad text.\n")
    assert rows_of(texts.read_text_task(spark, cola, "cola")) == [("Bad text.", None, "0"), ("Fine text.", None, "1")]
    sst = write("s.tsv", "sentence\tlabel\nfirst\t1\nsecond\t0\n")
    assert rows_of(texts.read_text_task(spark, sst, "sst-2")) == [("first", None, "1"), ("second", None, "0")]
    imdb = write("i.csv", 'review,more,label\n"a, b",c,pos\n')
    assert rows_of(texts.read_text_task(spark, imdb, "imdb")) == [("a, b,c", None, "pos")]
    ppdb = write("p.tsv", "a\tb\t(1, 6)\na\tc\t(3, 6)\nd\te\t(5, 6)\n \te\t(5, 6)\n")
    assert rows_of(texts.read_text_task(spark, ppdb, "twitterppdb")) == [("a", "b", "0"), ("d", "e", "1")]
    mood = write("m.tsv", "Sentiment\tText\nPositive\tgood\nother\tx\n")
    assert rows_of(texts.read_text_task(spark, mood, "sentiment")) == [("good", None, "Positive")]
    trec = write("t.txt", "DESC:manner How café works ?\nHUM:ind Who ?\n", "latin-1")
    assert rows_of(texts.read_question_lines(spark, trec)) == [("How café works ?", None, "DESC"), ("Who ?", None, "HUM")]


def test_json_and_libsvm(spark):
    xy = write("d.json", json.dumps([["one", "two"], [1, 0]]))
    assert [tuple(r) for r in texts.read_xy_json(spark, xy).collect()] == [(0, "one", "1"), (1, "two", "0")]
    base = folder()
    with open(f"{base}/dev.jsonl", "w") as f:
        f.write('{"sentence": "s", "label": "1"}\n')
    assert texts.read_jsonl(spark, base, "dev").collect()[0]["sentence"] == "s"
    svm = write("x.svm", "-1 1:0.5 3:2\n1 2:1\n")
    assert sorted((r["label"], r["features"]) for r in texts.read_libsvm(spark, svm, signed=True, dim=3).collect()) == [(0, [0.5, 0.0, 2.0]), (1, [0.0, 1.0, 0.0])]


def test_rounds_are_replaced_not_repeated(spark):
    path = folder()
    for rows in ([(1,)], [(2,), (3,)]):
        sinks.write_round(spark.createDataFrame(rows, "id bigint"), path, "round", 1)
    sinks.write_round(spark.createDataFrame([(9,)], "id bigint"), path, "round", 2)
    assert sorted((r["round"], r["id"]) for r in spark.read.parquet(path).collect()) == [(1, 2), (1, 3), (2, 9)]


def test_run_summary_and_pass_rate(spark):
    runs = spark.createDataFrame([(0, 0.5, 2.0), (2, 0.8, 1.0), (1, 0.9, 3.0)], "iteration int, acc double, time double")
    assert tuple(ev.run_summary(runs).collect()[0]) == (2, 0.8, 6.0)


def test_task_metrics_cover_every_task(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (1, 1)], "pred int, label int")
    for task in ev.TASK_METRICS:
        assert ev.task_metrics(df, task).count() == 1
    assert math.isclose(ev.task_metrics(df, "mrpc").collect()[0]["f1"], 2 / 3)


def test_anchor_stream_in_several_batches_uses_what_arrived(spark):
    source, work = folder(), folder()
    batches = [
        [(0, 0, [1.0, 0.0]), (1, None, [0.9, 0.1])],
        [(2, 1, [0.0, 1.0]), (3, None, [0.1, 0.9]), (4, None, [0.8, 0.2])],
    ]
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "id bigint, y int, p array<double>").coalesce(1)
        part.write.mode("append").parquet(source)
        arrivals = jobs.read_arrivals(spark, source, "*.parquet", "id bigint, y int, p array<double>")
        jobs.anchor_stream(arrivals, f"{work}/a", f"{work}/o", f"{work}/c", 1, id_col="id", label_col="y", prob_col="p", once=True).awaitTermination()
    got = {r["query_id"]: r["pred"] for r in spark.read.parquet(f"{work}/o").collect()}
    assert got == {1: 0, 3: 1, 4: 0}


def test_compacted_anchor_store_gives_the_same_votes(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([1.0] * 4, 70)
    rows = [(i, int(i % 3) if i % 4 else None, p[i].tolist()) for i in range(70)]
    want = {}
    for every in (1000, 2):
        source, work = folder(), folder()
        for part in range(7):
            spark.createDataFrame(rows[10 * part : 10 * part + 10], "id bigint, y int, p array<double>").coalesce(1).write.mode("append").parquet(source)
            arrivals = jobs.read_arrivals(spark, source, "*.parquet", "id bigint, y int, p array<double>")
            jobs.anchor_stream(arrivals, f"{work}/a", f"{work}/o", f"{work}/c", 3, id_col="id", label_col="y", prob_col="p", once=True, compact_every=every).awaitTermination()
        got = {r["query_id"]: r["pred"] for r in spark.read.parquet(f"{work}/o").collect()}
        want = want or got
        assert got == want and len(got) == 18
        if every == 2:
            # three tables of all anchors so far, each marked
            marks = spark.read.parquet(f"{work}/a/marks")
            assert sorted(r.upto for r in marks.select("upto").distinct().collect()) == [1, 3, 5]
            held = spark.read.parquet(f"{work}/a/compact/upto=5")
            assert sorted(r.id for r in held.collect()) == [i for i in range(60) if i % 4]
    # the last batch votes among all anchors
    stored = [(i, y, q) for i, y, q in rows if y is not None]
    for i in (60, 64, 68):
        kl = sorted((sum(a * (np.log(a + 1e-10) - np.log(b + 1e-10)) for a, b in zip(q, p[i])), j, y) for j, y, q in stored)
        votes = [y for *_, y in kl[:3]]
        assert want[i] == min(set(votes), key=lambda y: (-votes.count(y), y))


def test_stored_anchors_vote_like_the_kernels(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.5] * 6, 80)
    df = spark.createDataFrame([(i, i % 5, p[i].tolist()) for i in range(80)], "id bigint, y int, p array<double>")
    names = {"id_col": "id", "label_col": "y"}
    for metric in ("kl", "cross"):
        near = knn.knn_join(df, df, 4, metric, id_col="id", vec_col="p", exclude_self=True)
        plain = {tuple(r) for r in prompting.vote(near, df, **names).collect()}
        assert {tuple(r) for r in prompting.knn_vote(df, df, 4, metric=metric, vec_col="p", exclude_self=True, **names).collect()} == plain


def test_tfidf_groups_no_more_texts_a_task_in_a_larger_table(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20))) for i in range(200)] + [(300, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = {(r.doc_id, r.term): r.weight for r in T.tfidf(frame, id_col="doc_id", text_col="text", stop_words=[]).collect()}
    monkeypatch.setattr(T, "TERM_BYTES", 500)
    found = T.tfidf(frame, id_col="doc_id", text_col="text", stop_words=[])
    size = sum(len(t or "") for _, t in rows)
    assert "hashpartitioning(doc_id#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {-(-size // 500)}), REPARTITION_BY_NUM" in plan
    got = {(r.doc_id, r.term): r.weight for r in found.collect()}
    assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k]) for k in got)
