"""Circulant MinHash against the similarity of all pairs."""

import numpy as np
import pytest

from curvine.llm import circulant, set_links
from tests.llm.conftest import make, sentence


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_rows(rows):
    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                own[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        component = min(ids, default=None)
        out.append((doc_id, len(sets[i]), component if sets[i] else doc_id, doc_id == (component if sets[i] else doc_id)))
    return sorted(out, key=repr)


def edited(text, n):
    words = text.split()
    for k in range(n):
        words[(2 * k + 1) * len(words) // (2 * n)] = f"edit{k}"
    return " ".join(words)


def crowd():
    """A chain with distant ends, pairs on both sides of the threshold, families around one text, exact copies."""
    base = sentence(8000, 100)
    chain = [" ".join(base.split()[: 100 - 5 * k]) for k in range(8)]
    tails = [base + " " + sentence(8100 + k, 12 + k) for k in range(12)]
    family = [edited(sentence(8200, 120), 1 + k % 4) + f" row{k}" for k in range(30)]
    far = [edited(sentence(8300, 60), k) for k in range(1, 9)]
    rows = [(100 + i, t) for i, t in enumerate(chain + tails + family + far + family[:5])]
    for seed in range(30):
        text = sentence(8400 + seed, 150)
        rows += [(1000 + 10 * seed + n, edited(text, n) if n else text) for n in (0, 1, 3, 4, 5)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"small_bucket": 2, "block_rows": 3}, {"small_bucket": 10**6}])
def test_groups_equal_all_pairs(spark, odd_rows, limits):
    rows = crowd() + odd_rows
    got = [tuple(r) for r in circulant.near_duplicates(make(spark, rows), **limits).collect()]
    assert sorted(got, key=repr) == brute_rows(rows)


def test_loose_bands_still_confirm_links(spark):
    """Buckets of one coordinate propose many wrong pairs, and none passes; also with crowded buckets in blocks."""
    rows = crowd()[:60]
    got = circulant.near_duplicates(make(spark, rows), bands=40, rows=1, small_bucket=8, block_rows=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rows(rows)


def test_signature_is_a_shifted_permutation():
    parts = circulant.shingle_set(sentence(5, 3000))
    got = circulant.signature(parts, 8)
    mixed = circulant._initial(parts.view(np.uint64))
    for k in range(8):
        # coordinate k is the second permutation after a circular shift by k
        assert got[k] == circulant._shifted(mixed - np.uint64(k), np.zeros(1, np.uint64)).min()
    numbers = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(circulant._initial(numbers))) == len(np.unique(circulant._shifted(numbers, np.zeros(1, np.uint64)))) == 1 << 16


def test_coordinates_agree_as_often_as_the_similarity():
    agree, want = [], []
    for seed in range(60):
        a, b = sentence(9500 + seed, 200), edited(sentence(9500 + seed, 200), 6)
        agree.append((circulant.signature(circulant.shingle_set(a)) == circulant.signature(circulant.shingle_set(b))).mean())
        want.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02


def test_recall_of_the_bands():
    found = total = 0
    for seed in range(300):
        text = sentence(9000 + seed, 190)
        other = edited(text, 5)
        a, b = shingles(text), shingles(other)
        if 100 * len(a & b) >= 85 * len(a | b):
            total += 1
            found += any(x == y for x, y in zip(*[circulant.buckets(circulant.shingle_set(t)) for t in (text, other)]))
    assert total > 200 and found == total


@pytest.mark.parametrize("batch", [10_000, 1, 2])
def test_only_shared_buckets_stay(spark, batch):
    rows = [(i, 10, [i % 7, 100 + i // 2, 1000 + i]) for i in range(40)]
    classes = spark.createDataFrame(rows, "set_id bigint, size bigint, buckets array<bigint>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.bucket, r.id) for r in set_links.shared_buckets(classes).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(b, i) for i, _, buckets in rows for b in buckets[:2]}
    assert len(got) == len(set(got)) and want <= set(got)
    # at most the two ends of each task besides
    assert len(set(got) - want) <= 2 * 8


def test_crowds_choose_the_fewer_comparisons(spark):
    """Buckets with much in common are one group, buckets that touch in one set stay apart."""
    dense = [(b, i, 0 if i < 5 else i) for b in range(3) for i in range(10)]
    loose = [(10 + b, 100 + 9 * b + i, 100 + 9 * b + i) for b in range(6) for i in range(10)]
    large = spark.createDataFrame(dense + loose, "bucket bigint, id bigint, component bigint")
    mixed = spark.createDataFrame([(b, 10, 0, 5) for b in range(3)] + [(10 + b, 10, 100 + 9 * b, 1) for b in range(6)], "bucket bigint, rows bigint, main bigint, n_main bigint")
    got = set_links._crowds(large, mixed).collect()
    assert {r.g for r in got} == {"c:0", *[f"b:{10 + b}" for b in range(6)]}
    assert {r.id: r.outside for r in got if r.g == "c:0"} == {i: i >= 5 for i in range(10)}
    assert sum(r.g != "c:0" for r in got) == 60 and sum(not r.outside for r in got if r.g != "c:0") == 6


def test_empty_tables_and_columns(spark, empty):
    out = circulant.near_duplicates(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    blank = circulant.near_duplicates(make(spark, [(1, None), (2, ""), (None, " ")]))
    assert sorted((tuple(r) for r in blank.collect()), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
