"""Operators that compare texts with each other or with a corpus, against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from curvine.llm import decontam, shards, simhash, suffix_tree
from tests.llm.conftest import make, sentence


# --- SimHash ------------------------------------------------------------------------------


def brute_groups(prints, max_bits):
    own = sorted(set(prints))
    parent = {x: x for x in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(own):
        for y in own[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= max_bits:
                parent[find(x)] = find(y)
    return {x: find(x) for x in own}


def partition(pairs):
    """The groups of (item, name) as a set of sets."""
    groups = {}
    for item, name in pairs:
        groups.setdefault(name, set()).add(item)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("parts,hot,max_bits", [(1, 4096, 1), (2, 4096, 3), (3, 4096, 3), (4, 4096, 3), (4, 5, 3), (None, 4096, 2)])
def test_links_are_complete(spark, parts, hot, max_bits):
    rng = np.random.default_rng(7)
    centres = rng.integers(-(2**63), 2**63, 12)
    prints = set(rng.integers(-(2**63), 2**63, 150).tolist()) | {0, 7, -1}
    for c in centres.tolist():
        for _ in range(15):
            flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            prints.add(int(np.int64(np.uint64((c ^ flips) & (2**64 - 1)))) if (c ^ flips) < 2**63 else c)
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fp bigint")
    got = [(r.id_a, r.id_b) for r in simhash.hamming_links(df, max_bits, parts, hot).collect()]
    want = brute_groups(prints, max_bits)
    own = {x: x for x in prints}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in got:
        own[find(a)] = find(b)
    assert partition((x, find(x)) for x in prints) == partition(want.items())
    if hot > 1000:
        exact = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits}
        assert {(a, b) for a, b in got} == exact


def test_thresholds_add_up_and_avoid_crowds():
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63, 500)
    prints[:200] &= ~np.int64(0xFFFF)
    groups = [list(range(16 * p, 16 * p + 16)) for p in range(4)]
    counts = np.stack([np.bincount(simhash._values(prints, g), minlength=1 << 16) for g in groups])
    chosen = simhash.thresholds(prints, groups, counts, 3)
    assert (chosen.sum(axis=1) == 0).all()
    assert (chosen[:200, 0] == -1).mean() > 0.9 and (chosen[200:] == 0).all()


def test_near_duplicates(spark, odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    prints = [simhash.fingerprint(t or "") for _, t in odd_rows]
    groups = brute_groups(prints, 3)
    smallest = {}
    for (doc, _), p in zip(odd_rows, prints):
        g = groups[p]
        smallest[g] = min((x for x in (smallest.get(g), doc) if x is not None), default=None)
    want = Counter((doc, p, smallest[groups[p]]) for (doc, _), p in zip(odd_rows, prints))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


# --- shards ----------------------------------------------------------------------------------


def check_shards(rows, got, n):
    assert len(got) == len(rows)
    sizes = got.shard.value_counts().reindex(range(n), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and set(got.law) == {"rows"}
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((None if d != d else int(d), s, c) for d, s, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == want


def test_shards_of_odd_rows(odd, odd_rows, empty):
    check_shards(odd_rows, shards.shard_documents(odd, 3).toPandas(), 3)
    assert shards.shard_documents(empty).count() == 0


def test_copies_stay_together_and_a_hot_text_is_split(spark):
    rows = [(i, sentence(i + 1, 8)) for i in range(600)]
    rows += [(1000 + i, sentence(5000 + i // 3, 8)) for i in range(300)]
    rows += [(2000 + i, "hot") for i in range(450)]
    got = shards.shard_documents(make(spark, rows), 6).toPandas()
    check_shards(rows, got, 6)
    spread = got[got.copies == 3].groupby("text_crc32").shard.nunique()
    assert (spread == 1).all()
    assert got[got.copies == 450].shard.nunique() <= 4


@pytest.mark.parametrize("total,copies", [(480, [20, 20, 10, 10, 10]), (150, [6, 5, 3, 3, 2, 2])])
def test_groups_that_fit_a_shard_stay_whole(spark, total, copies):
    rows = [(1000 * g + i, f"group {g}") for g, n in enumerate(copies) for i in range(n)]
    rows += [(100_000 + i, sentence(i + 1, 8)) for i in range(total - len(rows))]
    got = shards.shard_documents(make(spark, rows)).toPandas()
    check_shards(rows, got, 24)
    assert (got[got.copies > 1].groupby("text_crc32").shard.nunique() == 1).all()


def fewest_cut(groups, quota):
    """The least pairs of one group in two shards, by trying every split of every group."""
    best = [float("inf")]

    def splits(n, room):
        if not room:
            yield () if not n else None
            return
        for k in range(min(n, room[0]), -1, -1):
            for rest in splits(n - k, room[1:]):
                if rest is not None:
                    yield (k, *rest)

    def put(i, room, cut):
        if cut >= best[0]:
            return
        if i == len(groups):
            best[0] = cut
            return
        for parts in splits(groups[i], room):
            if parts is not None:
                n = groups[i]
                put(i + 1, [r - k for r, k in zip(room, parts)], cut + (n * n - sum(k * k for k in parts)) // 2)

    put(0, list(quota), 0)
    return best[0]


@pytest.mark.parametrize("groups,total,n", [([6, 5, 4, 3], 24, 3), ([9, 2, 2], 18, 3), ([4, 4, 4], 12, 3), ([7, 3, 3, 2], 16, 4), ([2] * 6, 12, 4)])
def test_cut_edges_against_the_fewest(spark, groups, total, n):
    rows = [(100 * g + i, f"group {g}") for g, size in enumerate(groups) for i in range(size)]
    rows += [(10_000 + i, sentence(i + 1, 8)) for i in range(total - len(rows))]
    got = shards.shard_documents(make(spark, rows), n).toPandas()
    check_shards(rows, got, n)
    own = got[got.copies > 1].groupby(["text_crc32", "shard"]).size()
    cut = sum((k.sum() ** 2 - (k**2).sum()) // 2 for _, k in own.groupby(level=0))
    # hash labels cut about (n - 1) / n of all pairs
    every = sum(k * (k - 1) // 2 for k in groups)
    least = fewest_cut(groups, [total // n + (s < total % n) for s in range(n)])
    assert least <= cut <= least + 0.25 * every


def test_propagation_never_cuts_more(spark):
    rng = np.random.default_rng(6)
    rows = [(f"t{g}", int(s), int(k)) for g in range(60) for s, k in enumerate(rng.integers(0, 5, 6)) if k]
    parcels = spark.createDataFrame(rows, "same string, label int, n bigint")
    load = [sum(k for _, s, k in rows if s == t) for t in range(6)]
    quota = [max(load) + 3] * 6
    before = shards.cut_edges(parcels).first()
    after, room = shards.propagate(parcels, quota)
    end = shards.cut_edges(after).first()
    assert end.edges == before.edges and end.cut < 0.1 * before.cut and min(room) >= 0
    assert {r.same: r["sum(n)"] for r in after.groupBy("same").sum("n").collect()} == {r.same: r["sum(n)"] for r in parcels.groupBy("same").sum("n").collect()}
    assert sum(quota) - sum(room) == sum(load)


def test_few_parcels_are_moved_by_one_task(spark):
    rows = [(f"t{t}", s, 1 + (t * 7 + s * 5) % 11) for t in range(60) for s in range(5) if (t + s) % 3]
    parcels = spark.createDataFrame(rows, "same string, label int, n bigint")
    total = sum(r[2] for r in rows)
    quota = [total // 5 + 40 + (s < total % 5) for s in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, room = shards.propagate(parcels, quota)
        spread, room_too = shards.propagate(parcels, quota, task_parcels=0)
        assert one.rdd.getNumPartitions() == 1 < spread.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(one.collect()) == sorted(spread.collect()) and room == room_too
    assert room == [q - sum(r.n for r in one.collect() if r.label == s) for s, q in enumerate(quota)]


def test_grants_keep_the_quotas():
    rng = np.random.default_rng(1)
    for exchange in (True, False):
        for _ in range(200):
            n = int(rng.integers(2, 6))
            asked, room = rng.integers(0, 20, (n, n)).tolist(), rng.integers(0, 15, n).tolist()
            out = np.array(shards.grant(asked, room, exchange))
            assert (out >= 0).all() and (out <= asked).all() and not np.diag(out).any()
            assert (out.sum(axis=0) - out.sum(axis=1) <= room).all()


def test_only_copies(spark):
    rows = [(i, f"text {i // 2}") for i in range(100)]
    check_shards(rows, shards.shard_documents(make(spark, rows), 7).toPandas(), 7)


# --- decontamination -------------------------------------------------------------------------------


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, terms string")


def brute_leaks(docs, items):
    out = Counter()
    for doc, text in docs:
        words = decontam.plain_words(text or "")
        for item, question in set(items):
            own = decontam.plain_words(question or "")
            width = min(5, len(own))
            if not own:
                continue
            parts = set(zip(*[own[i:] for i in range(width)]))
            found = len(parts & set(zip(*[words[i:] for i in range(width)])))
            if found >= 0.8 * len(parts) - 1e-9:
                out[(doc, item, len(parts), found)] += 1
    return out


@pytest.mark.parametrize("max_postings", [1_000_000, 60])
def test_leaks(spark, odd_rows, max_postings):
    items = [(i, sentence(100 + i, 20 + i) + ". " + sentence(200 + i, 6) + ".") for i in range(12)]
    items += [(50, None), (51, ""), (52, "quiet"), (53, "two lanterns"), (1, items[1][1]), (60, "a b c d e a b c d e a b c d e"), (None, sentence(400, 30))]
    docs = list(odd_rows)
    for i, (_, text) in enumerate(items[:12]):
        words = (text or "").split()
        docs.append((100 + i, sentence(300 + i, 57 * i) + " " + text.upper().replace(" ", ", ") + " " + sentence(500 + i, 40)))
        docs.append((200 + i, sentence(600 + i, 30) + " " + " ".join(words[: int(len(words) * (0.7 + 0.03 * i))]) + " other end"))
    docs += [(300, "so QUIET, here"), (301, "a b c d e a b c d e a b c d e"), (302, sentence(400, 30)), (302, sentence(400, 30))]
    frame, bench = make(spark, docs), items_of(spark, items)
    got = Counter((r.doc_id, r.item_id, r.shingles, r.found) for r in decontam.find_leaks(frame, bench, max_postings=max_postings).collect())
    assert got == brute_leaks(docs, items) and sum(got.values()) > 14
    bad = {d for d, *_ in got}
    kept = decontam.drop_contaminated(frame, bench, max_postings=max_postings)
    assert kept.columns == frame.columns
    want = Counter(d for d, t in docs if not brute_leaks([(d, t)], items))
    assert Counter(r.doc_id for r in kept.collect()) == want and bad


@pytest.mark.parametrize("max_postings", [1_000_000, 60])
def test_leaks_of_items_in_pieces(spark, max_postings):
    items = [(i, sentence(3000 + i, 38)) for i in range(6)] + [(10, "alpha beta"), (11, sentence(3100, 60))]
    docs = []
    for i, (_, text) in enumerate(items):
        words = text.split()
        for gap in (0, 50, 200, 3000):
            for cuts in ([len(words) // 2], [len(words) // 3, 2 * len(words) // 3]):
                pieces = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
                # the last piece first, as an exam may print its answers
                docs.append((len(docs), f" {sentence(4000 + len(docs), gap)} ".join(reversed(pieces))))
    got = Counter((r.doc_id, r.item_id, r.shingles, r.found) for r in decontam.find_leaks(make(spark, docs), items_of(spark, items), max_postings=max_postings).collect())
    assert got == brute_leaks(docs, items) and sum(got.values()) > 24
    kept = decontam.drop_contaminated(make(spark, docs), items_of(spark, items), max_postings=max_postings)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in got}


def test_leaks_of_empty_tables(spark, odd, odd_rows, empty):
    none = items_of(spark, [])
    assert decontam.find_leaks(odd, none).count() == 0
    assert decontam.drop_contaminated(odd, none).count() == len(odd_rows)
    assert decontam.find_leaks(empty, items_of(spark, [(1, "a b c d e f")])).count() == 0


# --- suffix tree -----------------------------------------------------------------------------------------


def brute_scores(rows, held):
    """Counts and the tree by dictionaries, one level after the other."""
    depth = suffix_tree.DEPTH
    texts = [suffix_tree.symbols((t or "").encode().lower().split()) for _, t in rows]
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    known = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, kinds = sum(known.values()), len(known)
    counts = [Counter() for _ in range(depth + 1)]
    for text, h in zip(texts, held):
        if not h:
            padded = b"\n" * depth + text
            for i in range(depth, len(padded)):
                for k in range(depth + 1):
                    counts[k][(padded[i - k : i], padded[i])] += 1
    sums = [Counter() for _ in counts]
    for k, c in enumerate(counts):
        for (context, _), n in c.items():
            sums[k].setdefault(context, []) if False else None
    nexts = [{} for _ in counts]
    for k, c in enumerate(counts):
        for (context, x), n in c.items():
            nexts[k].setdefault(context, {})[x] = n
    cache = {}

    def p(context, x):
        if (context, x) in cache:
            return cache[context, x]
        k = len(context)
        q = 1 / 256 if k == 0 else p(context[1:], x)
        own = nexts[k].get(context)
        if own:
            n = sum(own.values())
            gain = sum(m * math.log(m / n / (1 / 256 if k == 0 else p(context[1:], y))) for y, m in own.items())
            if k == 0 or gain >= suffix_tree.MIN_GAIN:
                w = suffix_tree.PARENT_WEIGHT * len(own)
                q = (own.get(x, 0) + w * q) / (n + w)
        cache[context, x] = q
        return q

    out = []
    for text, ws in zip(texts, words):
        padded = b"\n" * depth + text
        score = sum(math.log10(p(padded[i - depth : i], padded[i])) for i in range(depth, len(padded)))
        base = sum(math.log10((known[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        out.append((len(ws), sum(known[w] > 0 for w in ws), total, base, score))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_suffix_tree(spark, odd_rows, block_bytes):
    rows = [r for r in odd_rows if r[0] != 9] + [(100 + i, sentence(i + 1, 40)) for i in range(60)]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    got = suffix_tree.score(make(spark, rows), block_bytes=block_bytes).collect()
    fixed = lambda d, h, a, b, c, x, y: (d, h, a, b, c, round(x, 5), round(y, 5))
    want = Counter(fixed(d, h, *s) for (d, _), h, s in zip(rows, held, brute_scores(rows, held)))
    assert Counter(fixed(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == want


def test_probabilities_add_up(spark):
    rows = [(i, sentence(i + 1, 20)) for i in range(30)]
    from pyspark.sql import functions as F

    # every next byte after one context, asked for by texts that are held out
    asked = [(1000 + b, "the " + chr(b)) for b in range(33, 127) if not 65 <= b <= 90]
    got = suffix_tree.score(make(spark, rows + asked), F.col("doc_id") >= 1000).filter("held_out").collect()
    assert sum(10 ** r.score for r in got) < 1.0


def test_suffix_tree_of_few_rows(spark, empty):
    from pyspark.sql import functions as F

    assert suffix_tree.score(empty).count() == 0
    only = suffix_tree.score(make(spark, [(1, "ab")]), F.lit(True)).collect()[0]
    assert only.train_tokens == 0 and abs(only.score - 4 * math.log10(1 / 256)) < 1e-9


def test_suffix_tree_scores_long_texts_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = [b"w%d" % i for i in range(2000)]
    texts = pa.array([b" ".join((kinds[i:] + kinds[:i]) * 10).decode() for i in range(100)])
    known = suffix_tree._Tally()
    held = np.zeros(len(texts), bool)
    counts = pa.Table.from_batches([*known.add(texts, held), *known.flush()]).rename_columns({"n": "value"})
    docs = pa.table({"doc_id": range(100), "held_out": held, "text": texts})
    tracemalloc.start()
    try:
        got = suffix_tree._scorer(1, 1)(docs, counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.column("n_tokens").to_pylist() == [20_001] * 100 and pc.all(pc.equal(got.column("n_known"), 20_001)).as_py()
    # two million words as objects of their own take over 100 MB
    assert peak < 80 << 20


def test_suffix_tree_reads_all_blanks_and_letters():
    import numpy as np

    texts = [b"", b" ", b"A\tB\x0bc\x0c \r\nd", "Ä É 　x\x1c".encode(), b"\n\n\n", b"end", b"\x00 \x85"]
    read = suffix_tree._Symbols(texts)
    want = [t.lower().split() for t in texts]
    words, tokens = read.words()
    assert words.to_pylist() == [w for ws in want for w in [*ws, b"\n"]] and tokens.tolist() == [len(ws) + 1 for ws in want]
    grams = []
    for t in want:
        padded = b"\n" * suffix_tree.DEPTH + suffix_tree.symbols(t)
        grams += [int.from_bytes(padded[i : i + suffix_tree.DEPTH + 1]) for i in range(len(padded) - suffix_tree.DEPTH)]
    assert read.grams().tolist() == grams and read.lengths.tolist() == [len(suffix_tree.symbols(t)) for t in want]
    places = suffix_tree._Places(np.array(sorted(set(grams))))
    assert places.of(np.array(grams)).tolist() == np.searchsorted(sorted(set(grams)), grams).tolist()
    with pytest.raises(LookupError):
        places.of(np.array([1 << 47]))
