"""Spelling variants: words one edit apart, by composing finite-state machines.

The vocabulary is an acceptor A, minimised, and one edit is a transducer E. The accepted
pairs of ``A . E . A`` are the words that differ by one inserted, deleted or replaced code
point. The composition is cut by initial states. An edit lies behind the first half of a
word or before it, so every pair is accepted either from the state that the first half
reaches, or, in the machine of the reversed words, from the state that the last half
reaches. Each partition holds the words that go through its initial states, builds the
minimal acceptor of what they have left, composes, trims the states that lead to no
accepted pair, and enumerates the rest.

Two words differ in length by at most one, so an initial state belongs to a length c: it
pairs words of length c with each other and with those of length c + 1, and its half is
that of c. A word goes to two lengths in either direction, four rows. An initial state
with more words than a task may hold is cut into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvine.llm.common import text_of
from curvine.plans.blocks import self_block_join
from curvine.session import checkpoint

LEAST_CHARS, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
# Words that a task composes at once; initial states with more are cut into blocks of half as many.
STATE_WORDS = 1 << 16
RUN = "[A-Za-zÀ-ÿ]"
PAIRS = "word_a string, n_a bigint, word_b string, n_b bigint"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """``(word, n)``: the lower-cased letter runs with at least so many code points and occurrences.

    ``slip`` plants misspellings: a run whose crc32 with the id is a multiple of it loses
    one code point (0: none does). A null text has no run, a null id counts as empty text.
    """
    # a maximal run that is shorter matches nowhere, and no shorter run can become long enough
    runs = F.regexp_extract_all(F.translate(text_of(), _UPPER, _LOWER), F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("w"))
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "i", "w")))
        at = F.pmod(F.col("h"), F.length("w")).cast("int")
        cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
        rows = rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("w")).alias("w")).filter(F.length("w") >= least_chars)
    return rows.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# --- the machines of one partition ---------------------------------------------------------


class _Acceptor:
    """Sorted distinct strings as a trie whose nodes carry the state of the minimal acceptor.

    ``states`` are the roots, one for each value of ``start``; ``kind`` is 1 where a string
    of the shorter length ends, 2 for the longer one.
    """

    def __init__(self, start: np.ndarray, text: np.ndarray, kind: np.ndarray) -> None:
        chars = text.astype(f"U{max(1, int(np.char.str_len(text).max(initial=1)))}").view(np.uint32).reshape(len(text), -1)
        self.labels, coded = np.unique(chars, return_inverse=True)
        chars, lens = coded.reshape(chars.shape), np.char.str_len(text)
        new = np.ones(len(text), bool)
        new[1:] = start[1:] != start[:-1]
        node_of = np.cumsum(new) - 1
        parent, label, depth, end, word = [np.full(new.sum(), -1)], [np.full(new.sum(), -1)], [np.zeros(new.sum(), int)], [np.zeros(new.sum(), int)], [np.full(new.sum(), -1)]
        total = int(new.sum())
        for d in range(chars.shape[1]):
            has = lens > d
            if not has.any():
                break
            new[1:] |= chars[1:, d] != chars[:-1, d]
            # a string that is through starts a branch for the next one
            new[1:] |= ~has[:-1]
            first = new & has
            above, node_of = node_of, np.cumsum(first) - 1 + total
            parent.append(above[first])
            label.append(chars[first, d])
            ends = has & (lens == d + 1)
            k, w = np.zeros(first.sum(), int), np.full(first.sum(), -1)
            k[node_of[ends] - total], w[node_of[ends] - total] = kind[ends], np.flatnonzero(ends)
            end.append(k)
            word.append(w)
            depth.append(np.full(first.sum(), d + 1))
            total += int(first.sum())
        self.parent, self.label, self.depth, self.end, self.word = (np.concatenate(x) for x in (parent, label, depth, end, word))
        self.size = len(self.labels) + 1
        self._minimise()
        # arcs of the trie, by node and label
        child = np.flatnonzero(self.parent >= 0)
        key = self.parent[child] * self.size + self.label[child]
        order = np.argsort(key, kind="stable")
        self.arc_key, self.arc_to = key[order], child[order]
        # arcs of the acceptor, by state and label
        key = self.state[self.parent[child]] * self.size + self.label[child]
        self.state_key, at = np.unique(key, return_index=True)
        self.state_to = self.state[child[at]]

    def _minimise(self) -> None:
        """Nodes with the same language behind them are one state; 64 bits name a language."""
        with np.errstate(over="ignore"):
            code = self.end.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for d in range(int(self.depth.max()), 0, -1):
                here = np.flatnonzero(self.depth == d)
                np.add.at(code, self.parent[here], _mixed(_mixed(code[here]) + self.label[here].astype(np.uint64)))
        _, first, self.state = np.unique(code, return_index=True, return_inverse=True)
        self.state_end = self.end[first]
        self.states = len(first)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _arcs_between(keys: np.ndarray, size: int, first: np.ndarray, last: np.ndarray):
    """All arcs of the nodes ``first``, and the arcs of ``last`` with the same label: positions ``(item, arc, arc)``."""
    low, high = np.searchsorted(keys, first * size), np.searchsorted(keys, (first + 1) * size)
    n = high - low
    item = np.repeat(np.arange(len(first)), n)
    arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[item]
    wanted = last[item] * size + keys[arc] % size
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    hit = keys[at] == wanted if len(keys) else np.zeros(0, bool)
    return item[hit], arc[hit], at[hit]


def _siblings(keys: np.ndarray, size: int):
    """Every two arcs of one node, the smaller label first: positions ``(arc, arc)``."""
    node = keys // size
    last = np.searchsorted(node, node, side="right")
    n = last - np.arange(len(keys)) - 1
    a = np.repeat(np.arange(len(keys)), n)
    return a, a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _starts(keys: np.ndarray, to: np.ndarray, size: int):
    """Right after the edit: pairs ``(kind, x, y)`` of nodes; kind 1 replaces, kind 2 inserts into y.

    An insertion counts at its last possible place, so the next label of x differs from
    the inserted one. Where x ends instead, the pair is ``(-, x, y)`` itself, kind 3.
    """
    a, b = _siblings(keys, size)
    yield 1, to[a], to[b]
    node = keys // size
    yield 3, node, to
    # x goes on from the node by c, y by the inserted label and then c
    item, one, two = _arcs_between(keys, size, node, to)
    differ = keys[one] % size != keys[item] % size
    yield 2, to[one[differ]], to[two[differ]]


def _productive(m: _Acceptor) -> dict[int, np.ndarray]:
    """Trimmed composition: the pairs of states, as ``x * states + y``, from which both words end, by kind.

    Kind 1 ends where two strings of the shorter length end, kind 2 where the shorter one
    and the longer one do.
    """
    out = {}
    for kind, x, y in _starts(m.state_key, m.state_to, m.size):
        if kind == 3:
            continue
        levels, links = [np.unique(x * m.states + y)], []
        known = levels[0]
        while len(levels[-1]):
            at = levels[-1]
            item, one, two = _arcs_between(m.state_key, m.size, at // m.states, at % m.states)
            to = m.state_to[one] * m.states + m.state_to[two]
            links.append((at[item], to))
            fresh = np.setdiff1d(to, known)
            known = np.union1d(known, fresh)
            levels.append(fresh)
        ends = (m.state_end[known // m.states] == 1) & (m.state_end[known % m.states] == kind)
        source, target = (np.searchsorted(known, np.concatenate([link[i] for link in links] or [known])) for i in range(2))
        while True:
            more = np.zeros_like(ends)
            more[source[ends[target]]] = True
            if not (more & ~ends).any():
                break
            ends |= more
        out[kind] = known[ends]
    return out


def _accepted(m: _Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``(x, y)`` of all accepted pairs, each once; an inserted word is y."""
    good = _productive(m)
    xs, ys = [], []
    for kind, x, y in _starts(m.arc_key, m.arc_to, m.size):
        if kind == 3:
            both = (m.end[x] == 1) & (m.end[y] == 2)
            xs.append(m.word[x[both]])
            ys.append(m.word[y[both]])
            continue
        while len(x):
            pair = m.state[x] * m.states + m.state[y]
            at = np.searchsorted(good[kind], pair)
            at[at == len(good[kind])] = 0
            alive = good[kind][at] == pair if len(good[kind]) else np.zeros(len(pair), bool)
            x, y = x[alive], y[alive]
            both = (m.end[x] == 1) & (m.end[y] == kind)
            xs.append(m.word[x[both]])
            ys.append(m.word[y[both]])
            _, one, two = _arcs_between(m.arc_key, m.size, x, y)
            x, y = m.arc_to[one], m.arc_to[two]
    return np.concatenate(xs), np.concatenate(ys)


def _compose(start: np.ndarray, rows: pa.Table, apart: np.ndarray | None = None) -> pa.Table:
    """Accepted pairs of the rows ``(rest, long, skip, word, times)``; ``apart`` wants pairs across its two values only.

    ``skip`` is the half that forward machines pair by: a backward pair that shares it is
    theirs. It is null in rows of forward machines.
    """
    rest = np.array(rows.column("rest").to_pylist(), dtype=str)
    long = rows.column("long").to_numpy(zero_copy_only=False)
    # by initial state, then text in code points; equal rests of one state are one word, except for the kinds
    order = np.lexsort((rest, start))
    x, y = _accepted(_Acceptor(start[order], rest[order], np.where(long[order], 2, 1)))
    x, y = order[x], order[y]
    skip, forward = rows.column("skip").to_numpy(zero_copy_only=False), rows.column("skip").is_null().to_numpy(zero_copy_only=False)
    keep = forward[x] | (skip[x] != skip[y])
    if apart is not None:
        keep &= apart[x] != apart[y]
    x, y = x[keep], y[keep]
    word, n = rows.column("word").combine_chunks(), rows.column("times").combine_chunks()
    return pa.table({"word_a": word.take(pa.array(x)), "n_a": n.take(pa.array(x)), "word_b": word.take(pa.array(y)), "n_b": n.take(pa.array(y))})


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """Rows sorted by ``g``, in tables of about so many words that no group crosses."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= words:
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy(zero_copy_only=False)
            cut = int(np.argmax(g == g[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _by_state(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, words):
            if table.num_rows:
                g = table.column("g").to_numpy(zero_copy_only=False)
                yield from _compose(np.concatenate([[0], np.cumsum(g[1:] != g[:-1])]), table).to_batches()

    return run


def _block_pair(_, first: pa.Table, second: pa.Table | None) -> pa.Table:
    both = first if second is None else pa.concat_tables([first, second])
    apart = None if second is None else np.arange(both.num_rows) < first.num_rows
    return _compose(np.zeros(both.num_rows, int), both, apart)


# --- pairs, forms, roots ---------------------------------------------------------------------


def _initial_states(words: DataFrame) -> DataFrame:
    """``(g, rest, long, skip, word, times)``: four rows for a word of ``(word, n)``, at the initial states it goes through."""
    length = F.length("word")
    rows = words.select("word", F.col("n").alias("times"), F.explode(F.array(length, length - 1)).alias("c"), length.alias("chars")).filter(F.col("c") >= 1)
    rows = rows.withColumn("half", F.floor(F.col("c") / 2).cast("int"))
    rows = rows.withColumn("tail", F.col("c") - F.col("half"))
    part = lambda start, n: F.substring(F.col("word"), start, n)
    head = part(F.lit(1), F.col("half"))
    end = part(F.col("chars") - F.col("tail") + 1, F.col("tail"))
    name = lambda way, state: F.concat_ws(":", F.lit(way), F.col("c").cast("string"), state)
    ways = F.array(
        F.struct(name("f", head).alias("g"), part(F.col("half") + 1, F.col("chars")).alias("rest"), F.lit(None).cast("string").alias("skip")),
        F.struct(name("b", end).alias("g"), F.reverse(part(F.lit(1), F.col("chars") - F.col("tail"))).alias("rest"), head.alias("skip")),
    )
    return rows.select("word", "times", (F.col("chars") > F.col("c")).alias("long"), F.explode(ways).alias("w")).select("w.g", "w.rest", "long", "w.skip", "word", "times")


def near_pairs(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """``(word_a, n_a, word_b, n_b)``: every two distinct words of ``(word, n)`` one edit apart, each pair once.

    Words are distinct and not null; an empty table gives no rows.
    """
    rows = _initial_states(words.select("word", "n"))
    # at most 4 * words / state_words initial states
    hot = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > state_words).select("g")
    hot = checkpoint(hot)
    cold = rows.join(F.broadcast(hot), "g", "left_anti").repartition("g").sortWithinPartitions("g")
    pairs = cold.mapInArrow(_by_state(state_words), PAIRS)
    crowded = rows.join(F.broadcast(hot), "g", "left_semi").withColumn("id", F.xxhash64("word"))
    return pairs.unionByName(self_block_join(crowded, _block_pair, PAIRS, True, state_words // 2))


def group_variants(words: DataFrame, ratio: int = RATIO, state_words: int = STATE_WORDS) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` for every word of ``(word, n)``.

    ``form`` is the near word of largest n, of several the smallest in code-point order, if
    its n is at least ``ratio`` times the word's; else null. ``root`` follows forms to the
    last, the word itself if it has none; n grows by the factor ``ratio`` at every step, so
    a few joins reach it. An empty table gives no rows.
    """
    words = checkpoint(words.select("word", F.col("n").cast("bigint").alias("n")))
    pairs = near_pairs(words, state_words)
    other = lambda a, b: F.struct(F.col(f"word_{a}").alias("word"), (-F.col(f"n_{b}")).alias("less"), F.col(f"word_{b}").alias("near"))
    sides = pairs.select(F.explode(F.array(other("a", "b"), other("b", "a"))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    found = checkpoint(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "form", "root", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """``(word, root)``: each word's last form, doubling the steps a join takes."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = checkpoint(steps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")))
        steps = moved.select("word", "root")
        if moved.filter("went").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """``group_variants`` over the ``vocabulary`` of the documents.

    Null, empty and blank texts have no words; a null id counts as empty text where
    misspellings are planted; repeated rows count again; other columns are not read; an
    empty table gives no rows.
    """
    return group_variants(vocabulary(docs, slip=slip))
