"""Coreset selection and pruning."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions import vectors as V
from curvine.functions.hashing import MODULUS, id_hash
from curvine.operators import knn
from curvine.operators.cluster import group_means
from curvine.plans.blocks import BLOCK_ROWS, block_join, self_block_join
from curvine.plans.bounded import MAX_BROADCAST_BYTES, TooLarge, collect_bounded
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.plans.ranking import half_even, rank_rows, running_totals
from curvine.session import checkpoint

# --- easy and hard rows of every cluster ------------------------------------------


def per_cluster_quota(n: Column, ratio: float, clusters: int) -> Column:
    """max(1, int(N * ratio / K))."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(ratio) / F.lit(clusters))).cast("bigint")


def deft_select(
    assigned: DataFrame, distance: Column, quota: Column | int, *, easy: float = 0.5, hard: float = 0.5, id_col="vec_id", cid_col="cid"
) -> DataFrame:
    """Nearest and farthest rows of each cluster, as ``(id, cid, dist, kind)``.

    ``int(easy * quota)`` nearest rows, then as many farthest ones as
    ``int(hard * quota)`` and the cluster allow. One ranking serves both ends.
    """
    rows = assigned.select(id_col, cid_col, distance.alias("dist"))
    ranked = rank_rows(rows, [F.col("dist"), F.col(id_col)], [cid_col], totals_too=True, settle=True)
    quota = F.lit(quota) if isinstance(quota, int) else quota
    n_easy = F.least(F.floor(F.lit(easy) * quota), F.col("rank_total"))
    n_hard = F.least(F.floor(F.lit(hard) * quota), F.col("rank_total") - n_easy)
    kind = F.when(F.col("rank") <= n_easy, "easy").when(F.col("rank") > F.col("rank_total") - n_hard, "hard")
    return ranked.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(id_col, cid_col, "dist", "kind")


# --- pruning small clusters and outliers ---------------------------------------------


def round_half_even(share: float, n: int) -> int:
    """Python's rounding of share * n, with the product taken in decimal."""
    return round(Decimal(str(share)) * n)


def scip_prune(
    assigned: DataFrame, distance: Column, *, p: float = 0.2, alpha: float = 0.8, id_col="vec_id", cid_col="cid"
) -> DataFrame:
    """Prune a share ``p`` of the rows: first from the smallest clusters, then the farthest of the rest.

    Returns every row as ``(id, cid, dist, cluster_size, kept, reason)``. Running totals
    over the table of cluster sizes decide which clusters go whole, so three numbers
    reach the driver; only rows of the clusters at the cut, and the rows that stay,
    are ranked.
    """
    rows = checkpoint(assigned.select(id_col, cid_col, distance.alias("dist")))
    sizes = checkpoint(rows.groupBy(cid_col).agg(F.count(F.lit(1)).alias("cluster_size")))
    n = sizes.agg(F.sum("cluster_size")).collect()[0][0] or 0
    total = round_half_even(p, n)
    size_quota = round_half_even(alpha, total)
    per_size = sizes.groupBy("cluster_size").agg((F.col("cluster_size") * F.count(F.lit(1))).alias("rows"))
    upto = checkpoint(running_totals(per_size, [F.col("cluster_size")], {"upto": F.col("rows")}))
    inside = F.col("upto") <= size_quota
    largest, spent, at_cut_size = upto.agg(F.max(F.when(inside, F.col("cluster_size"))), F.max(F.when(inside, F.col("upto"))), F.min(F.when(~inside, F.col("cluster_size")))).collect()[0]
    left = size_quota - (spent or 0)
    cut = left > 0 and at_cut_size is not None
    fate = sizes.withColumns({"whole": F.col("cluster_size") <= (largest or 0), "cut": F.col("cluster_size") == (at_cut_size if cut else -1)})
    marked = join_lookup(rows, fate, cid_col, max(1, n // MAX_HOT_KEYS), "cluster_size")
    pruned = marked.filter("whole").withColumn("reason", F.lit("size"))
    rest = marked.filter("NOT whole")
    if cut:
        at_cut = rank_rows(rest.filter("cut"), [F.col(id_col)])
        first = at_cut.filter(F.col("rank") <= left).drop("rank")
        pruned = pruned.unionByName(first.withColumn("reason", F.lit("size")))
        rest = rest.filter("NOT cut").unionByName(at_cut.filter(F.col("rank") > left).drop("rank"))
    far = rank_rows(rest, [F.col("dist").desc(), F.col(id_col)])
    reason = F.when(F.col("rank") <= total - size_quota, F.lit("distance"))
    out = pruned.unionByName(far.withColumn("reason", reason).drop("rank"))
    return out.select(id_col, cid_col, "dist", "cluster_size", F.col("reason").isNull().alias("kept"), "reason")


def prune_stats(pruned: DataFrame, cid_col="cid") -> DataFrame:
    return pruned.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("pruned"),
        F.round(F.avg((~F.col("kept")).cast("double")), 6).alias("prune_ratio"),
        F.count_distinct(cid_col).alias("clusters"),
        F.round(F.count(F.lit(1)) / F.count_distinct(cid_col), 6).alias("mean_cluster_size"),
        F.round(F.avg(F.when(F.col("kept"), F.col("dist"))), 6).alias("kept_mean_dist"),
        F.round(F.avg(F.when(~F.col("kept"), F.col("dist"))), 6).alias("pruned_mean_dist"),
    )


def prune_ratio_by_cluster(pruned: DataFrame, cid_col="cid") -> DataFrame:
    return pruned.groupBy(cid_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("pruned"),
        F.round(F.avg((~F.col("kept")).cast("double")), 6).alias("prune_ratio"),
    )


# --- facility location ---------------------------------------------------------------

PULL = 64
# A class holds so many times PULL rows on the driver before its rows are scored by blocks.
HOLD = 4
KEEP_EVERY = 32
FIXED = 1e9


def _similarity_parts(metric: str, q: np.ndarray, b: np.ndarray, span: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of a few rows of q at a time to all rows of b, in bounded memory."""
    if metric not in ("cosine", "euclidean", "l1"):
        raise ValueError(f"unknown metric {metric!r}")
    for rows, dist in kernels.near_parts("sq_l2" if metric == "euclidean" else metric, q, b):
        if metric == "cosine":
            yield rows, 1.0 - dist
        else:
            yield rows, span - (np.sqrt(np.maximum(dist, 0.0)) if metric == "euclidean" else dist)


def _similarity(metric: str, q: np.ndarray, b: np.ndarray, span: float) -> np.ndarray:
    out = np.empty((len(q), len(b)))
    for rows, sim in _similarity_parts(metric, q, b, span):
        out[rows] = sim
    return out


def _span_kernel(group, left, right, *, metric):
    parts = kernels.near_parts("l1" if metric == "l1" else "sq_l2", kernels.matrix(left.column("vec")), kernels.matrix(right.column("vec")))
    top = max((float(dist.max()) for _, dist in parts if dist.size), default=0.0)
    return pa.table({"g": pa.array([group], pa.int64()), "span": pa.array([top if metric == "l1" else max(top, 0.0) ** 0.5])})


def class_spans(rows: DataFrame, metric: str, block_rows: int = BLOCK_ROWS) -> dict[int, float]:
    """Largest distance inside each class; a task reports one number."""
    if metric == "cosine":
        return {r["g"]: 0.0 for r in collect_bounded(rows.select("g").distinct())}
    found = block_join(rows, rows, lambda g, a, b: _span_kernel(g, a, b, metric=metric), "g bigint, span double", True, block_rows)
    return {r["g"]: r["span"] for r in collect_bounded(found.groupBy("g").agg(F.max("span").alias("span")))}


def class_similarity(df: DataFrame, metric: str, min_sim: float, *, class_col="label", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Similar pairs inside each class: cosine, or the class's largest distance minus the distance.

    Returns ``(id_a, id_b, sim)`` above ``min_sim``; the full square is never laid out.
    """
    if metric == "cosine":
        return knn.similar_pairs(df, min_sim, within=class_col, metric="cosine", id_col=id_col, vec_col=vec_col)
    rows = _class_rows(df, class_col, id_col, vec_col)
    spans = class_spans(rows, metric)

    def kernel(group, first, second):
        other = first if second is None else second
        a, b = kernels.matrix(first.column("vec")), kernels.matrix(other.column("vec"))
        ia, ib = first.column("id").to_numpy(), other.column("id").to_numpy()
        limit = spans[group] - min_sim
        how = "l1" if metric == "l1" else "sq_l2"
        for i, j, d in kernels.pairs_below_parts(how, a, b, limit if how == "l1" else max(limit, 0.0) ** 2):
            once = ia[i] < ib[j] if second is None else np.ones(len(i), bool)
            left, right, d = ia[i][once], ib[j][once], d[once]
            sim = spans[group] - (d if how == "l1" else np.sqrt(d))
            yield pa.table({"id_a": np.minimum(left, right), "id_b": np.maximum(left, right), "sim": sim})

    return self_block_join(rows, kernel, "id_a bigint, id_b bigint, sim double", grouped=True)


def _class_rows(df, class_col, id_col, vec_col) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull()).select(
        F.col(class_col).cast("bigint").alias("g"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")
    )


def _gain_sums(metric: str, cands: np.ndarray, points: np.ndarray, cover: np.ndarray, span: float) -> np.ndarray:
    """What each candidate adds to the cover of the points, in whole multiples of 1 / ``FIXED``."""
    gain = np.zeros(len(cands), np.int64)
    if not len(points):
        return gain
    base = kernels.fixed_point(np.maximum(cover, 0.0), FIXED)
    # whole numbers whose sum a double still holds
    plain = FIXED * len(points) * max(1.0, span, float(cover.max())) < 2**52
    floor, held = base.astype(np.float64), int(base.sum())
    for part, sim in _similarity_parts(metric, cands, points, span):
        if plain:
            sim *= FIXED
            sim += 0.5
            np.floor(sim, out=sim)
            np.maximum(sim, floor, out=sim)
            gain[part] = sim.sum(axis=1).astype(np.int64) - held
        else:
            gain[part] = (np.maximum(kernels.fixed_point(sim, FIXED), base) - base).sum(axis=1)
    return gain


def _block_gains(cands: DataFrame, points: DataFrame, metric: str, spans: dict, block_rows: int) -> DataFrame:
    """``(g, id, bound)``: the gain of every candidate of a class, added up over blocks of its points."""

    def kernel(group, some, beside):
        cover = beside.column("cover").to_numpy()
        gain = _gain_sums(metric, kernels.matrix(some.column("vec")), kernels.matrix(beside.column("vec")), cover, spans[group])
        return pa.table({"g": pa.array(np.full(len(gain), group), pa.int64()), "id": some.column("id"), "bound": pa.array(gain, pa.int64())})

    parts = block_join(cands, points, kernel, "g bigint, id bigint, bound bigint", True, block_rows)
    return parts.groupBy("g", "id").agg(F.sum("bound").alias("bound"))


def _raise_cover(metric, spans, cover, vec, groups, chosen):
    """Each point's similarity to its best chosen row so far."""
    cover = cover.copy()
    for g in np.unique(groups):
        if len(chosen.get(int(g), ())):
            at = np.nonzero(groups == g)[0]
            cover[at] = np.maximum(cover[at], _similarity(metric, vec[at], np.array(chosen[int(g)]), spans[int(g)]).max(axis=1))
    return cover


def _gain_pass(points: DataFrame, metric: str, spans: dict, chosen: dict, asked: dict) -> dict:
    """Marginal gains of a few asked rows per class, in one pass over the points without a shuffle of them."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups, vec = batch.column(0).to_numpy(), kernels.matrix(batch.column(2))
            cover = _raise_cover(metric, spans, batch.column(3).to_numpy(zero_copy_only=False), vec, groups, chosen)
            for g in np.unique(groups):
                want = asked.get(int(g))
                if not want:
                    continue
                at = np.nonzero(groups == g)[0]
                sim = _similarity(metric, np.array([v for _, v in want]), vec[at], spans[int(g)])
                base = kernels.fixed_point(cover[at], FIXED)
                gain = (np.maximum(kernels.fixed_point(sim, FIXED), base) - base).sum(axis=1)
                for (i, _), x in zip(want, gain):
                    sums[(int(g), i)] = sums.get((int(g), i), 0) + int(x)
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.int64())],
                names=["g", "id", "gain"],
            )

    found = points.mapInArrow(run, "g bigint, id bigint, gain bigint").groupBy("g", "id").agg(F.sum("gain").alias("gain"))
    return {(r["g"], r["id"]): r["gain"] for r in collect_bounded(found)}


def _settle_cover(points: DataFrame, metric: str, spans: dict, chosen: dict) -> DataFrame:
    """Write down the cover so that later passes start from it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cover = _raise_cover(
                metric, spans, batch.column(3).to_numpy(zero_copy_only=False), kernels.matrix(batch.column(2)), batch.column(0).to_numpy(), chosen
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cover)], names=batch.schema.names)

    return checkpoint(points.mapInArrow(run, points.schema))


class _Frontier:
    """Rows of one class ordered by an upper bound on their gain, fetched a few at a time."""

    def __init__(self, order: DataFrame, step: int):
        self.order = order
        self.bound: dict[int, int] = {}
        self.vec: dict[int, np.ndarray] = {}
        self.fetched = 0
        self.step = step
        self.next_bound: int | None = None


def facility_select(
    df: DataFrame, budget: dict[int, int], *, metric: str = "cosine", class_col="label", id_col="vec_id", vec_col="embedding",
    block_rows: int = BLOCK_ROWS, pull: int = PULL,
) -> DataFrame:
    """Greedy facility location per class: ``(class, step, id, gain)``.

    A pick adds the most to the total similarity of the points to their best pick,
    ties to the smaller id. Gains only shrink as picks are made, so old gains bound
    new ones: a round scores again just the rows whose bound could still win, and
    makes the same picks as scoring all. A few rows at a time come to the driver and
    are scored in passes that move no vectors; where more than ``HOLD * pull`` rows of
    a class could still win, all of these are scored again by blocks instead, so the
    driver holds a bounded number of rows of each class. All classes advance together.
    The first gains need each class against itself once. Every pick is at least one
    pass: meant for small budgets, where the exact picks of plain greedy matter;
    ``greedi`` takes a number of jobs that no budget changes.
    """
    rows = _class_rows(df, class_col, id_col, vec_col)
    spans = class_spans(rows, metric, block_rows)
    points = rows.withColumn("cover", F.lit(0.0))
    by_bound = [F.col("bound").desc(), F.col("id")]
    # a row without an id is a point, but none that can be picked
    order = checkpoint(rank_rows(_block_gains(points, points, metric, spans, block_rows).filter("id IS NOT NULL"), by_bound, ["g"]))
    fronts = {g: _Frontier(order, pull) for g in budget}
    chosen: dict[int, list] = {}
    taken: dict[int, list] = {g: [] for g in budget}
    picks: list[tuple] = []
    first = rows.select(F.size("vec").alias("d")).limit(1).collect()
    # what the driver holds is bounded by bytes too
    room = MAX_BROADCAST_BYTES // (8 * max(1, first[0]["d"] if first else 1) * max(1, len(budget)))
    hold = max(1, min(HOLD * pull, room))
    for front in fronts.values():
        front.step = max(1, min(pull, room))

    def fetch(classes: list[int]):
        for source in {id(fronts[g].order): fronts[g].order for g in classes}.values():
            spec = [(g, fronts[g].fetched, fronts[g].fetched + fronts[g].step) for g in classes if fronts[g].order is source]
            want = source.sparkSession.createDataFrame(spec, "g bigint, lo bigint, hi bigint")
            # one row past the slice tells the bound on all that is not fetched yet
            got = source.join(F.broadcast(want), "g").filter("rank > lo AND rank <= hi + 1").select("g", "id", "bound", "rank", "hi")
            for g, _, hi in spec:
                fronts[g].fetched, fronts[g].next_bound = hi, None
            for r in got.join(rows, ["g", "id"]).collect():
                front, i = fronts[r["g"]], r["id"]
                if r["rank"] > r["hi"]:
                    front.next_bound = r["bound"]
                else:
                    # of a repeated id one row is looked at
                    vec = min(r["vec"], front.vec[i].tolist()) if i in front.vec else r["vec"]
                    front.bound[i], front.vec[i] = r["bound"], np.array(vec, np.float64)
                    front.step = max(1, min(2 * pull if front.fetched <= pull else 8 * pull, room))

    def score_again(least: dict[int, int]):
        """New orders for classes of which too many rows could still win: all rows whose bound reaches ``least`` get their gain."""
        nonlocal points, chosen
        if chosen:
            points, chosen = _settle_cover(points, metric, spans, chosen), {}
        spark = df.sparkSession
        limits = spark.createDataFrame(list(least.items()), "g bigint, least bigint")
        gone = spark.createDataFrame([(g, i) for g in least for i in taken[g]], "g bigint, id bigint")
        for source in {id(fronts[g].order): fronts[g].order for g in least}.values():
            mine = [g for g in least if fronts[g].order is source]
            left = source.filter(F.col("g").isin(mine)).select("g", "id", "bound").join(F.broadcast(gone), ["g", "id"], "left_anti").join(F.broadcast(limits), "g")
            open_rows = rows.join(left.filter("bound >= least").select("g", "id"), ["g", "id"])
            cands = open_rows.groupBy("g", "id").agg(F.min("vec").alias("vec")).withColumn("cover", F.lit(0.0))
            gains = _block_gains(cands, points.filter(F.col("g").isin(mine)), metric, spans, block_rows)
            ranked = checkpoint(rank_rows(gains.unionByName(left.filter("bound < least").select("g", "id", "bound")), by_bound, ["g"], settle=True))
            for g in mine:
                fronts[g] = _Frontier(ranked, max(1, min(pull, room)))
        fetch(list(least))

    fetch([g for g in budget if budget[g] > 0])
    for step in range(max(budget.values(), default=0)):
        live = [g for g in budget if budget[g] > step and fronts[g].bound]
        if not live:
            break
        # the first gains are exact, and the highest come first
        fresh: dict[int, dict[int, int]] = {g: {} if step else dict(fronts[g].bound) for g in live}
        open_ = set(live) if step else set()
        while open_:
            asked, more, wide = {}, [], {}
            for g in sorted(open_):
                front = fronts[g]
                best = max(fresh[g].values(), default=-1)
                stale = sorted((i for i in front.bound if i not in fresh[g] and front.bound[i] >= best), key=lambda i: (-front.bound[i], i))
                beyond = front.next_bound is not None and front.next_bound >= best
                if stale:
                    asked[g] = [(i, front.vec[i]) for i in stale[: front.step]]
                elif beyond and front.fetched >= hold:
                    wide[g] = best
                elif beyond:
                    more.append(g)
                else:
                    open_.discard(g)
            if wide:
                score_again(wide)
                for g, best in wide.items():
                    # the highest of these come first in the new order, ties by id
                    fresh[g] = {i: b for i, b in fronts[g].bound.items() if b >= best}
                    open_.discard(g)
            if more:
                fetch(more)
            if asked:
                for (g, i), gain in _gain_pass(points, metric, spans, chosen, asked).items():
                    fronts[g].bound[i] = fresh[g][i] = gain
        for g in live:
            best = max(fresh[g], key=lambda i: (fresh[g][i], -i))
            picks.append((g, step, best, fresh[g][best] / FIXED))
            chosen.setdefault(g, []).append(fronts[g].vec[best])
            taken[g].append(best)
            del fronts[g].bound[best]
        held = sum(len(v) * len(v[0]) * 8 for v in chosen.values() if v)
        if (step + 1) % KEEP_EVERY == 0 or held > MAX_BROADCAST_BYTES // 2:
            points = _settle_cover(points, metric, spans, chosen)
            chosen = {}
    return df.sparkSession.createDataFrame(picks, f"{class_col} bigint, step bigint, {id_col} bigint, gain double")


def draw_limit(budget: int, eps: float) -> int:
    """Rows whose hash lies below it are the candidates of a step: n / budget * ln(1 / eps) of n rows on average."""
    return int(min(1.0, math.log(1 / eps) / max(1, budget)) * MODULUS)


def _drawn(rows: DataFrame, limits: dict[int, int], steps: range, seed: int, room: int) -> Iterator[tuple[range, dict]]:
    """Candidates ``{class: {id: (vec, steps it is drawn for)}}`` of as many steps as a pass may bring, then of the next ones."""
    sizes = {r["g"]: (r["n"], r["d"]) for r in collect_bounded(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")))}
    most = sum(8 * sizes[g][0] * sizes[g][1] * limits[g] / MODULUS for g in limits if g in sizes)
    each = max(1, min(len(steps), int(room / max(1.0, most)))) if len(steps) else 1
    limit_of = F.element_at(F.create_map(*[F.lit(x) for g, n in limits.items() for x in (g, n)]), F.col("g"))
    for first in range(steps.start, steps.stop, each):
        part = range(first, min(first + each, steps.stop))
        hit = F.array_compact(F.array(*[F.when(id_hash("id", seed + t) < limit_of, F.lit(t)) for t in part]))
        found: dict = {g: {} for g in limits}
        for r in rows.filter(F.col("g").isin(list(limits))).withColumn("steps", hit).filter(F.size("steps") > 0).toLocalIterator():
            found[r["g"]][r["id"]] = (r["vec"], set(r["steps"]))
        yield part, found


def facility_stochastic(
    df: DataFrame, budget: dict[int, int], *, eps: float = 0.1, seed: int = 0, metric: str = "cosine", class_col="label", id_col="vec_id",
    vec_col="embedding", block_rows: int = BLOCK_ROWS, pull: int = PULL,
) -> DataFrame:
    """Stochastic greedy facility location per class (Mirzasoleiman et al., 2015): ``(class, step, id, gain)``.

    Every step looks at a random part of the class only, drawn by the hash of id and step,
    n / budget * ln(1 / eps) rows on average, and picks the one that adds most (ties to
    the smaller id); the expected value is within eps of plain greedy's bound. No class
    meets itself: the candidates of several steps come in one pass and get their gains
    in another, and as gains only shrink, a step scores again just those that could still
    win. A step that draws no new row takes the unpicked row of smallest hash. Candidates
    of one step must fit into the driver's bounded room, which ``eps`` and the budget set.
    """
    rows = checkpoint(_class_rows(df, class_col, id_col, vec_col))
    spans = class_spans(rows, metric, block_rows)
    points = rows.withColumn("cover", F.lit(0.0))
    limits = {g: draw_limit(b, eps) for g, b in budget.items() if b > 0}
    chosen: dict[int, list] = {}
    taken: dict[int, set] = {g: set() for g in limits}
    picks: list[tuple] = []
    for part, drawn in _drawn(rows, limits, range(max(budget.values(), default=0)), seed, MAX_BROADCAST_BYTES // 2):
        bound = _gain_pass(points, metric, spans, chosen, {g: [(i, v) for i, (v, _) in c.items() if i not in taken[g]] for g, c in drawn.items()})
        for step in part:
            live = {g: {i: v for i, (v, at) in drawn[g].items() if step in at and i not in taken[g]} for g in limits if budget[g] > step}
            for g in [g for g, c in live.items() if not c]:
                rest = rows.filter(F.col("g") == g).join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in taken[g]], "id bigint")), "id", "left_anti")
                live[g] = {r["id"]: r["vec"] for r in rest.orderBy(id_hash("id", seed + step), "id").limit(1).collect()}
            live = {g: c for g, c in live.items() if c}
            fresh: dict[int, dict[int, int]] = {g: {} for g in live}
            open_ = set(live)
            while open_:
                asked = {}
                for g in sorted(open_):
                    best = max(fresh[g].values(), default=-1)
                    stale = sorted((i for i in live[g] if i not in fresh[g] and bound.get((g, i), best + 1) >= best), key=lambda i: (-bound.get((g, i), 0), i))
                    if stale:
                        asked[g] = [(i, live[g][i]) for i in stale[:pull]]
                    else:
                        open_.discard(g)
                if asked:
                    for key, gain in _gain_pass(points, metric, spans, chosen, asked).items():
                        bound[key] = fresh[key[0]][key[1]] = gain
            for g in live:
                best = max(fresh[g], key=lambda i: (fresh[g][i], -i))
                picks.append((g, step, best, fresh[g][best] / FIXED))
                chosen.setdefault(g, []).append(live[g][best])
                taken[g].add(best)
            held = sum(len(v) * len(v[0]) * 8 for v in chosen.values() if v)
            if (step + 1) % KEEP_EVERY == 0 or held > MAX_BROADCAST_BYTES // 2:
                points = _settle_cover(points, metric, spans, chosen)
                chosen = {}
    return df.sparkSession.createDataFrame(picks, f"{class_col} bigint, step bigint, {id_col} bigint, gain double")


def residual_candidates(
    df: DataFrame, k: int, *, selected: dict[int, list] | None = None, class_col="label", id_col="vec_id", vec_col="embedding"
) -> DataFrame:
    """The k rows of each class nearest to what its selection still leaves of the summed vectors."""
    selected = selected or {}
    residual = {
        int(r[class_col]): (r[class_col], np.array(r["mean"]) * r["n"] - sum((np.array(v) for v in selected.get(int(r[class_col]), [])), np.zeros(len(r["mean"]))))
        for r in collect_bounded(group_means(df, [class_col], vec_col))
    }
    near = knn.nearest_to_few(residual, df, k, class_col=class_col, id_col=id_col, vec_col=vec_col)
    return near.withColumnRenamed("query_id", class_col)


def residual_select(
    df: DataFrame, budget: dict[int, int], *, candidates: int = 20, batch: int = 5, metric: str = "cosine", class_col="label", id_col="vec_id",
    vec_col="embedding",
) -> DataFrame:
    """Pick in batches among the rows nearest to the residual: ``(class, step, id, gain)``.

    The residual is what the picks leave of a class's summed vectors; each batch looks at
    the ``candidates`` rows nearest to it. Picks are settled into the cover of the points
    like those of ``facility_select``, so no pass grows with the picks before it.
    """
    rows = _class_rows(df, class_col, id_col, vec_col)
    spans = class_spans(rows, metric)
    points = rows.withColumn("cover", F.lit(0.0))
    totals = {int(r["g"]): np.array(r["mean"]) * r["n"] for r in collect_bounded(group_means(rows, ["g"], "vec"))}
    chosen: dict[int, list] = {}
    taken: dict[int, list] = {g: [] for g in budget}
    picks: list[tuple] = []
    while True:
        live = [g for g in budget if g in totals and len(taken[g]) < budget[g]]
        if not live:
            break
        used = df.sparkSession.createDataFrame([(i,) for g in taken for i in taken[g]], "id bigint")
        free = rows.join(F.broadcast(used), "id", "left_anti")
        near = knn.nearest_to_few({g: (g, totals[g]) for g in live}, free, candidates, class_col="g", id_col="id", vec_col="vec")
        pool: dict[int, dict] = {}
        # a few ids per class, sent to the vectors
        for r in rows.select(F.col("id").alias("neighbor_id"), "vec").join(F.broadcast(near.select("query_id", "neighbor_id")), "neighbor_id").collect():
            pool.setdefault(r["query_id"], {})[r["neighbor_id"]] = r["vec"]
        if not pool:
            break
        for _ in range(batch):
            asked = {g: sorted(pool[g].items()) for g in live if pool.get(g) and len(taken[g]) < budget[g]}
            if not asked:
                break
            gains = _gain_pass(points, metric, spans, chosen, asked)
            for g in asked:
                best = max(pool[g], key=lambda i: (gains.get((g, i), 0), -i))
                vec = pool[g].pop(best)
                picks.append((g, len(taken[g]), best, gains.get((g, best), 0) / FIXED))
                taken[g].append(best)
                chosen.setdefault(g, []).append(vec)
                totals[g] = totals[g] - np.array(vec)  # only the newest pick changes the residual
        if sum(map(len, chosen.values())) >= KEEP_EVERY:
            points = _settle_cover(points, metric, spans, chosen)
            chosen = {}
    return df.sparkSession.createDataFrame(picks, f"{class_col} bigint, step bigint, {id_col} bigint, gain double")


def medoid_weights(
    df: DataFrame, selected: DataFrame, *, metric: str = "cosine", weight_col: str | None = None, class_col="label", id_col="vec_id", vec_col="embedding"
) -> DataFrame:
    """Number (or weight) of the points whose most similar pick each pick is: ``(class, id, weight)``."""
    picked = selected.select(F.col(id_col).alias("_id"), F.col("step"))
    with_vec = df.join(F.broadcast(picked), df[id_col] == F.col("_id")).select(class_col, "_id", "step", vec_col)
    chosen: dict[int, list] = {}
    for r in collect_bounded(with_vec.orderBy("step", "_id")):
        chosen.setdefault(int(r[class_col]), []).append((r["_id"], r[vec_col]))
    how = {"euclidean": "sq_l2", "l1": "l1", "cosine": "cosine"}[metric]
    rows = df.select(F.col(class_col).cast("bigint").alias("g"), F.col(vec_col).alias("vec"), (F.col(weight_col) if weight_col else F.lit(1)).cast("double").alias("w"))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups, vec, w = batch.column(0).to_numpy(), kernels.matrix(batch.column(1)), batch.column(2).to_numpy()
            for g in np.unique(groups):
                if int(g) not in chosen:
                    continue
                at = np.nonzero(groups == g)[0]
                _, bi, _ = kernels.top_k(how, vec[at], np.array([v for _, v in chosen[int(g)]]), 1)
                ids = np.array([i for i, _ in chosen[int(g)]])
                total = np.bincount(bi, weights=w[at], minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), g), pa.int64()), pa.array(ids, pa.int64()), pa.array(total)], names=["g", "id", "w"]
                )

    parts = rows.mapInArrow(run, "g bigint, id bigint, w double")
    return parts.groupBy(F.col("g").alias(class_col), F.col("id").alias(id_col)).agg(F.sum("w").alias("weight"))


def class_quota(counts: DataFrame, budget: int, *, equal: bool, redistribute: str = "even", class_col="label", n_col="n") -> DataFrame:
    """How many rows each class may give; one row per class in and out.

    Equal quotas are ceil(B / C); what small classes cannot fill goes to the others,
    split by the number of those (``even``) or of the small ones (``minority``).
    Otherwise a class gives ceil(n / N * B).
    """
    all_ = counts.agg(F.count(F.lit(1)).alias("c"), F.sum(n_col).alias("total"))
    with_all = counts.withColumn("_j", F.lit(1)).join(F.broadcast(all_.withColumn("_j", F.lit(1))), "_j").drop("_j")
    if not equal:
        return with_all.select(class_col, n_col, F.ceil(F.col(n_col).cast("double") / F.col("total") * F.lit(budget)).cast("bigint").alias("quota"))
    share = F.ceil(F.lit(float(budget)) / F.col("c"))
    marked = with_all.withColumn("share", share).withColumn("small", F.col(n_col) < F.col("share"))
    short = marked.agg(
        F.sum(F.when(F.col("small"), F.col("share") - F.col(n_col)).otherwise(0)).alias("extra"),
        F.count_if(F.col("small") if redistribute == "minority" else ~F.col("small")).alias("among"),
    )
    joined = marked.withColumn("_j", F.lit(1)).join(F.broadcast(short.withColumn("_j", F.lit(1))), "_j")
    bonus = F.coalesce(F.ceil(F.try_divide(F.col("extra").cast("double"), F.col("among"))), F.lit(0))
    return joined.select(class_col, n_col, (F.col("share") + F.when(F.col("small"), 0).otherwise(bonus)).cast("bigint").alias("quota"))


def class_interleave(selected: DataFrame, proportions: DataFrame, *, class_col="label", step_col="step") -> DataFrame:
    """Mix the classes into one order: blocks of ``prop`` rows per class in turn.

    ``proportions`` has one row ``(class, prop)`` per class. Adds ``block`` and ``position``.
    """
    blocks = selected.join(F.broadcast(proportions), class_col).withColumn("block", F.floor(F.col(step_col) / F.col("prop")).cast("bigint"))
    return rank_rows(blocks, [F.col("block"), F.col(class_col), F.col(step_col)], rank="position").drop("prop")


def class_proportions(counts: DataFrame, class_col="label", n_col="n") -> DataFrame:
    """Class sizes in units of the smallest class, rounded half to even."""
    smallest = counts.agg(F.min(n_col).alias("low")).withColumn("_j", F.lit(1))
    joined = counts.withColumn("_j", F.lit(1)).join(F.broadcast(smallest), "_j")
    return joined.select(class_col, half_even(F.col(n_col).cast("double") / F.col("low")).alias("prop"))


# Doubles of one part, and rows of one merge: what a task may hold.
PART_BYTES = 256 * 1024 * 1024
MERGE_ROWS = 20_000


def _greedy_in_task(metric: str, budget: dict[int, int]):
    """A kernel ``(g, id, vec, w)`` -> picks with their vectors: plain greedy over the rows of one group.

    Old gains bound new ones, so a round looks again only at rows that could still
    win. A pick's weight adds up the weights of the rows most similar to it.
    """
    how = {"euclidean": "sq_l2", "l1": "l1", "cosine": "cosine"}[metric]

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by("id")
        ids, vec, w = table.column("id").to_numpy(), kernels.matrix(table.column("vec")), table.column("w").to_numpy()
        if vec.nbytes > PART_BYTES:
            raise TooLarge(f"a part of {len(ids)} rows takes {vec.nbytes} bytes; use more parts")
        step = max(1, kernels.CHUNK_CELLS // max(1, len(ids)))
        chunks = [slice(at, at + step) for at in range(0, len(ids), step)]
        span = 0.0
        if metric != "cosine":
            near = kernels.near_to(how, vec)
            top = max(float(near(vec[c]).max()) for c in chunks)
            span = top if metric == "l1" else max(top, 0.0) ** 0.5
        first = np.concatenate([kernels.fixed_point(np.maximum(_similarity(metric, vec[c], vec, span), 0.0), FIXED).sum(axis=1) for c in chunks])
        waiting = [(-int(gain), i) for i, gain in enumerate(first)]
        heapq.heapify(waiting)
        cover = np.zeros(len(ids))
        picks, gains = [], []
        while waiting and len(picks) < budget.get(group, 0):
            bound, i = heapq.heappop(waiting)
            if picks:
                base = kernels.fixed_point(cover, FIXED)
                sim = kernels.fixed_point(_similarity(metric, vec[i : i + 1], vec, span)[0], FIXED)
                bound = -int((np.maximum(sim, base) - base).sum())
            if waiting and (bound, i) > waiting[0]:
                heapq.heappush(waiting, (bound, i))
                continue
            picks.append(i)
            gains.append(-bound / FIXED)
            cover = np.maximum(cover, _similarity(metric, vec, vec[i : i + 1], span)[:, 0])
        weight = np.zeros(len(picks))
        if picks:
            _, best, _ = kernels.top_k(how, vec, vec[picks], 1)
            weight = np.bincount(best, weights=w, minlength=len(picks))
        return pa.table(
            {
                "g": pa.array(np.full(len(picks), group), pa.int64()), "step": pa.array(np.arange(len(picks)), pa.int64()), "id": pa.array(ids[picks], pa.int64()),
                "gain": pa.array(gains, pa.float64()), "w": pa.array(weight, pa.float64()), "vec": kernels.list_column(vec[picks], pa.float64()),
            }
        )

    return kernel


def greedi(
    df: DataFrame, budget: dict[int, int], parts: int, *, first_share: float = 1.0, metric: str = "cosine", seed: int = 0, class_col="label", id_col="vec_id",
    vec_col="embedding",
) -> DataFrame:
    """Greedy in rounds of bounded tasks: inside random parts of each class, then among the union of those picks.

    A part gives ``first_share`` of its class's budget (1/2 for the half-budget merge),
    the last round the whole. A union of more than ``MERGE_ROWS`` picks is merged in
    several rounds. Every round is one job, whatever the budget; a part that does not
    fit into a task fails with the advice to use more parts. Returns ``(class, step,
    id, gain, weight)``; weights add up the rows a final pick stands for.
    """
    first = {c: max(1, int(b * first_share)) if b > 0 else 0 for c, b in budget.items()}
    rows = _class_rows(df, class_col, id_col, vec_col).select(
        (F.col("g") * parts + F.pmod(id_hash("id", seed), F.lit(parts))).alias("g"), "id", V.doubles("vec").alias("vec"), F.lit(1.0).alias("w")
    )
    fan_in = max(2, MERGE_ROWS // max(1, max(first.values(), default=1)))
    schema = "g bigint, step bigint, id bigint, gain double, w double, vec array<double>"
    while True:
        each = {c * parts + i: b for c, b in first.items() for i in range(parts)}
        picked = rows.groupBy("g").applyInArrow(_greedy_in_task(metric, each), schema)
        group, i = F.floor(F.col("g") / parts).cast("bigint"), F.pmod("g", F.lit(parts))
        parts = -(-parts // fan_in)
        rows = picked.select((group * parts + F.floor(i / fan_in)).cast("bigint").alias("g"), "id", "vec", "w")
        if parts == 1:
            break
    final = rows.groupBy("g").applyInArrow(_greedy_in_task(metric, budget), schema)
    return final.select(F.col("g").alias(class_col), "step", F.col("id").alias(id_col), "gain", F.col("w").alias("weight"))


def log_objective(picks: DataFrame, ceilings: DataFrame, *, alpha: float = 1.0, class_col="label") -> DataFrame:
    """Add ``log_value`` and ``log_gain``: the log-normalised objective after each pick and what the pick adds.

    ``ceilings`` is ``(class, ceiling)``: the sum of gains if every row were picked. The
    value is ln(1 + alpha * gains / ceiling) / ln(1 + alpha), so picking all gives 1.
    """
    sofar = Window.partitionBy(class_col).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.ln(1 + F.lit(alpha) * F.try_divide(F.sum("gain").over(sofar), F.col("ceiling"))) / F.ln(F.lit(1.0 + alpha))
    valued = picks.join(ceilings, class_col).withColumn("log_value", value)
    before = F.lag("log_value", 1, 0.0).over(Window.partitionBy(class_col).orderBy("step"))
    return valued.withColumn("log_gain", F.col("log_value") - before).drop("ceiling")


def objective_ceilings(df: DataFrame, metric: str = "cosine", *, class_col="label", id_col="vec_id", vec_col="embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(class, ceiling)``: every row's similarity to itself, summed; 1 each for cosine (0 for a zero row), else the class's span."""
    rows = _class_rows(df, class_col, id_col, vec_col)
    if metric == "cosine":
        own = (F.aggregate(V.doubles("vec"), F.lit(0.0), lambda a, x: a + x * x) > 0).cast("double")
        return rows.groupBy(F.col("g").alias(class_col)).agg(F.sum(own).alias("ceiling"))
    spans = class_spans(rows, metric, block_rows)
    table = df.sparkSession.createDataFrame(list(spans.items()), f"{class_col} bigint, span double")
    return rows.groupBy(F.col("g").alias(class_col)).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), class_col).select(class_col, (F.col("n") * F.col("span")).alias("ceiling"))


# --- baselines and checks ------------------------------------------------------------------


def weighted_random_subset(df: DataFrame, ratio: float, *, seed: int = 0, id_col="vec_id") -> DataFrame:
    """int(ratio * N) random rows, each with weight 1 / ratio, and the weights scaled to sum to their number.

    The rank in hash order is exact at any size, with no row limit on one task.
    """
    ranked = rank_rows(df.select(id_col), [id_hash(id_col, seed), F.col(id_col)], totals_too=True)
    picked = ranked.filter(F.col("rank") <= F.floor(F.lit(ratio) * F.col("rank_total")))
    n = F.floor(F.lit(ratio) * F.col("rank_total"))
    weight = F.lit(1.0 / ratio)
    return picked.select(id_col, weight.alias("weight"), (weight / (weight * n) * n).alias("scaled_weight"))


def gradient_difference(gradients: DataFrame, weights: DataFrame, *, id_col="vec_id", grad_col="grad") -> DataFrame:
    """Norm of the full gradient, and of its difference from the weighted gradient of a subset."""
    key = F.lit(0).alias("_one")
    full = group_means(gradients.select(key, grad_col), ["_one"], grad_col).select("_one", V.scale("mean", F.col("n")).alias("full"))
    part = gradients.join(weights.select(id_col, "weight"), id_col).select(key, V.scale(grad_col, F.col("weight")).alias(grad_col))
    sub = group_means(part, ["_one"], grad_col).select("_one", V.scale("mean", F.col("n")).alias("sub"))
    return full.join(sub, "_one").select(F.round(V.l2("full", "sub"), 6).alias("diff"), F.round(V.l2_norm("full"), 6).alias("full_norm"))


def selection_coverage(all_rows: DataFrame, selections: DataFrame, *, id_col="vec_id") -> DataFrame:
    """How often each row was selected over the rounds, as a histogram with the share of rows."""
    times = selections.groupBy(id_col).agg(F.count(F.lit(1)).alias("times"))
    per_row = all_rows.select(id_col).join(times, id_col, "left").select(F.coalesce("times", F.lit(0)).cast("bigint").alias("times"))
    hist = per_row.groupBy("times").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(F.lit(0))  # over one row per distinct count of selections
    return hist.select("times", "n", F.round(F.col("n") / F.sum("n").over(total), 6).alias("share"))
