"""Spelling variants against all pairs, and against a plain reading of the rules."""

import random
import re
import zlib
from collections import Counter

import pytest

from curvine.llm import variants
from tests.llm.conftest import make, sentence


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def brute_rows(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, form[w], root, len(near[w]), counts.get(form[w])))
    return out


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def random_words(seed, letters, n, low=7, high=12):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        words.add("".join(rng.choice(letters) for _ in range(rng.randint(low, high))))
    return sorted(words)


@pytest.mark.parametrize("state_words", [1 << 16, 30])
@pytest.mark.parametrize("letters,low,high", [("abé", 7, 10), ("ab", 7, 13), ("abcdefghij", 1, 3)])
def test_pairs_equal_all_pairs(spark, state_words, letters, low, high):
    words = random_words(5, letters, 500, low, high)
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    rows = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n bigint")
    got = variants.near_pairs(rows, state_words).collect()
    place = {w: i + 1 for i, w in enumerate(words)}
    assert sorted(tuple(sorted((r.word_a, r.word_b))) for r in got) == want and want
    assert all(r.n_a == place[r.word_a] and r.n_b == place[r.word_b] for r in got)


def test_repeated_letters_and_edges_of_words(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "aaabaaaa", "aaaaaab", "xaaaaaaa", "ünïcöde", "unïcöde", "nïcöde"]
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = sorted(tuple(sorted((r.word_a, r.word_b))) for r in variants.near_pairs(rows).collect())
    assert got == sorted((min(a, b), max(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def test_forms_roots_and_ties(spark):
    counts = {"lantern": 5000, "lanterm": 500, "lantexm": 50, "lantexmm": 5, "harbour": 100, "harbor": 9, "harbors": 11, "harbora": 100, "charbour": 100, "meadows": 3}
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {tuple(r) for r in variants.group_variants(rows).collect()}
    assert got == brute_rows(counts)
    assert ("lantexmm", 5, "lantexm", "lantern", 1, 50) in got


def test_documents_equal_the_plain_rules(spark, odd_rows):
    rows = odd_rows + [(100 + i, sentence(i, 60) + " " + w) for i in range(60) for w in ["Lanterns harbours Meadow", "lantern lanterns harbour COPPERS xcoppers", "crème-brulées çcoppers"][i % 3 : i % 3 + 1]]
    got = {tuple(r) for r in variants.spelling_variants(make(spark, rows)).collect()}
    assert got == brute_rows(brute_words(rows)) and any(r[2] for r in got)


def test_no_words(spark, empty):
    assert variants.spelling_variants(empty).count() == 0
    assert variants.spelling_variants(make(spark, [(1, None), (2, ""), (None, " \n"), (3, "short words only")])).count() == 0
    assert variants.spelling_variants(empty).columns == ["word", "n", "form", "root", "n_near", "form_n"]
