"""Periodic runs against a search of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from curvine.llm import periods
from curvine.llm.common import text_of
from tests.llm.conftest import make, sentence


def brute_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, stretch = j + q - i, words[i : j + q]
            if length >= max(least, times * q) and not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 140)
        yield [rng.randint(0, 1) for _ in range(n)]
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
        torn = (unit * 150)[:n]
        for _ in range(rng.randint(0, 3)):
            if n:
                torn[rng.randrange(n)] = rng.randint(0, 3)
        yield torn
        blocks = []
        while len(blocks) < n:
            blocks += [0] * rng.randint(16, 20) + [1]
        yield blocks
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        yield b[:n]
        unit = [rng.randint(0, 5) for _ in range(rng.randint(1, 30))]
        yield [rng.randint(0, 1000) for _ in range(n)] + unit * rng.randint(2, 6) + [7, 8] + unit * 4


@pytest.mark.parametrize("pairs", [1 << 22, 64])
def test_runs_equal_a_search_of_every_lag(pairs, monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    for words in sequences():
        assert periods.find_runs(np.array(words, np.int32)) == brute_runs(words)


@pytest.mark.parametrize("least,times", [(6, 2), (9, 4), (2, 2)])
def test_other_bounds(least, times):
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.randint(0, 1) for _ in range(rng.randint(0, 60))]
        assert periods.find_runs(np.array(words, np.int32), least, times) == brute_runs(words, least, times)


def test_seeds_are_the_guaranteed_overlap():
    assert periods.seed_width() == 16


def test_long_texts_of_few_words():
    long = np.zeros(60_000, np.int32)
    assert periods.find_runs(long) == [(0, 60_000, 1)]
    rows = np.array(([0] * 100 + [1]) * 100, np.int32)
    assert periods.find_runs(rows) == brute_runs(rows.tolist())


def test_rows(spark, odd_rows):
    unit = sentence(70, 11)
    rows = odd_rows + [(200 + i, " ".join([sentence(i, 30), *[unit] * (i % 7), sentence(i + 1, 20)])) for i in range(40)]
    docs = make(spark, rows)
    got = [tuple(r) for r in periods.digests(docs, plant=True).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(i, t) for i, t in rows), key=repr)
    assert any(r[1] for r in got if zlib.crc32(str(r[0]).encode()) % 10 == 0)
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.periodic_runs(docs).collect() if r.doc_id is not None and r.doc_id >= 200}
    assert found == {i: brute_runs(t.split()) for i, t in rows if i is not None and i >= 200}


def test_collapsed_documents(spark, odd, odd_rows, empty):
    unit = "one two three four five six seven eight"
    docs = make(spark, [*odd_rows, (300, f"start\n{unit} {unit} {unit} {unit} end")])
    cut = periods.collapse(docs)
    assert cut.columns == docs.columns and cut.count() == len(odd_rows) + 1
    assert cut.filter("doc_id = 300").first().text == f"start {unit} end"
    assert cut.filter("doc_id = 2").first().text is None
    same = cut.filter("doc_id <> 300").select("doc_id", text_of().alias("t"))
    before = odd.select("doc_id", text_of().alias("t"))
    assert before.exceptAll(same).filter("doc_id NOT IN (8)").count() == 0
    for out in (periods.collapse(empty), periods.digests(empty), periods.periodic_runs(empty)):
        assert out.count() == 0
