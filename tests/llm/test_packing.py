import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from curvine.llm import packing, tokenizing


def check_plan(counts, plan, capacity):
    held = Counter()
    for times, filling in plan:
        assert times > 0 and sum(s * t for s, t in filling) <= capacity
        for s, t in filling:
            held[s] += times * t
    assert all(held[s] == counts[s] for s in range(capacity + 1))
    return sum(m for m, _ in plan)


def fewest(sizes, capacity):
    """The optimum by trying every assignment."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in sorted(set(rooms)):
            if j >= sizes[i]:
                rest = list(rooms)
                rest.remove(j)
                put(i + 1, rest + [j - sizes[i]])
        put(i + 1, rooms + [capacity - sizes[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_are_optimal(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 31, 9).tolist(), reverse=True)
    counts = np.bincount(sizes, minlength=31)
    assert check_plan(counts, packing.plan_bins(counts, 30), 30) == fewest(sizes, 30)


def plain_fillings(counts, room):
    """Every set that fits, without those in which a free length can replace one shorter piece or several."""
    items = [s for s in range(1, room + 1) for _ in range(int(counts[s]))]
    sets = {c for k in range(1, len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}
    out = set()
    for c in sets:
        free = Counter(items) - Counter(c)
        parts = {p for k in range(1, len(c) + 1) for p in itertools.combinations(c, k)}
        if not any(sum(p) <= y <= sum(p) + room - sum(c) and (len(p) > 1 or y > p[0]) for p in parts for y in free):
            out.add(tuple(sorted(c, reverse=True)))
    return out or {()}


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_all_undominated_sets_by_waste(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(0, 25))
    counts = np.bincount(rng.integers(1, 20, int(rng.integers(0, 10))), minlength=26)
    got = [f for f in packing.fillings(counts, room) if f is not None]
    assert len(got) == len(set(got)) and set(got) == plain_fillings(counts, room)
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_triples_that_fill_the_room():
    """Best fit decreasing needs more sequences than there are; the search finds the fewest."""
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(12):
        a = int(rng.integers(300, 400))
        b = int(rng.integers(280, 774 - a))
        sizes += [a, b, 1024 - a - b]
    counts = np.bincount(sizes, minlength=1025)
    assert check_plan(counts, packing.plan_bins(counts), 1024) == 12 < sum(m for m, _ in packing.best_fit(counts, 1024))


@pytest.mark.parametrize("low,high,n", [(1, 1025, 5000), (1, 40, 3000), (500, 1025, 900), (1024, 1025, 10), (1, 2, 5000)])
def test_plans_hold_every_piece(low, high, n):
    counts = np.bincount(np.random.default_rng(0).integers(low, high, n), minlength=1025)
    assert check_plan(counts, packing.plan_bins(counts, steps=300), 1024) <= sum(m for m, _ in packing.best_fit(counts, 1024))


def test_ranks_ids_match_the_tokenizers_file():
    for special in (False, True):
        ranks, plain = (tokenizing.encoder(tokenizing.public_path(f"byte_bpe_50k.{kind}"), special) for kind in ("tiktoken", "json"))
        for text in ["", " a  b\n\n c\t", "don't DON'T 12,345", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b<|endoftext", "né 😀 ſ　word", "x" * 3000, "\r\n \x0b"]:
            assert ranks(text).tolist() == plain(text).tolist()


def test_special_strings_are_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizing.public_path("byte_bpe_50k.json"))
    text = "first<|endoftext|> second"
    ids = [*loaded.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert 50256 in ids
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), with_ids=True).first()
    assert list(row.ids) == ids and row.length == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_and_places(spark, odd, odd_rows):
    rows = packing.pack(odd, capacity=64, with_ids=True).toPandas()
    encode = tokenizing.encoder(tokenizing.public_path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in odd_rows:
        ids = [*encode(text or "").tolist(), 2]
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 64
    assert all(len(i) == n and zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, n, c in zip(rows.ids, rows.length, rows.ids_crc32))


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0
