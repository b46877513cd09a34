"""Small numpy kernels for one bounded block of vectors.

BLAS products only shortlist; every reported distance is summed again left to
right over the dimensions, so it does not depend on how rows were blocked, and
equal vectors give equal distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

SMOOTHING = 1e-10
SLACK = 1e-9
CHUNK_CELLS = 4_000_000
# A base of more rows is shortlisted by minima of so many strands of it, fewer cells at a time.
STRANDS, STRAND_CELLS = 512, 1_000_000


def matrix(col) -> np.ndarray:
    """A list column as an (n, d) matrix of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(col), -1)


def list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An (n, d) matrix as a list column."""
    n, d = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))


def _unit(x):
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def near(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two blocks, to shortlisting accuracy; smaller is nearer."""
    return near_to(metric, b)(q)


def near_to(metric: str, b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``near`` for one base block and any number of queries; norms and logs of the base are taken once."""
    if metric == "ip":
        return lambda q: -(q @ b.T)
    if metric == "cosine":
        unit = _unit(b).T
        return lambda q: 1.0 - _unit(q) @ unit
    if metric == "sq_l2":
        squares = (b * b).sum(axis=1)[None, :]
        return lambda q: (q * q).sum(axis=1)[:, None] + squares - 2.0 * (q @ b.T)
    if metric == "kl":
        self_term = (b * np.log(b + SMOOTHING)).sum(axis=1)[None, :]
        return lambda q: self_term - np.log(q + SMOOTHING) @ b.T
    if metric == "cross":
        log_b = np.log(b + SMOOTHING).T
        return lambda q: -(q @ log_b)
    if metric == "l1":
        return lambda q: _near_l1(q, b)
    raise ValueError(f"unknown metric {metric!r}")


def _near_l1(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(b)))
    for d in range(q.shape[1]):
        out += np.abs(q[:, d, None] - b[None, :, d])
    return out


def _fold(terms) -> np.ndarray:
    acc = 0.0
    for term in terms:
        acc = acc + term
    return acc


def lengths(metric: str, x: np.ndarray) -> np.ndarray | None:
    """Norms summed left to right, where the metric needs them."""
    return np.sqrt(_fold(x[:, d] * x[:, d] for d in range(x.shape[1]))) if metric == "cosine" else None


def exact(metric: str, q, b, qi, bi, q_length=None, b_length=None) -> np.ndarray:
    """Distances of the row pairs (qi, bi), summed left to right; ``lengths`` of both blocks may be given."""
    dims = range(q.shape[1])  # one dimension at a time, so memory stays at one value per pair

    def gather(f):
        return _fold(f(q[qi, d], b[bi, d]) for d in dims)

    if metric == "ip":
        return -gather(lambda x, y: x * y)
    if metric == "cosine":
        q_length = lengths(metric, q) if q_length is None else q_length
        b_length = lengths(metric, b) if b_length is None else b_length
        scale = q_length[qi] * b_length[bi]
        inner = gather(lambda x, y: x * y)
        return 1.0 - np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0)
    if metric == "sq_l2":
        return gather(lambda x, y: (x - y) * (x - y))
    if metric == "l1":
        return gather(lambda x, y: np.abs(x - y))
    if metric == "kl":
        return gather(lambda x, y: y * (np.log(y + SMOOTHING) - np.log(x + SMOOTHING)))
    if metric == "cross":
        return -gather(lambda x, y: x * np.log(y + SMOOTHING))
    raise ValueError(f"unknown metric {metric!r}")


def _row_chunks(n_q: int, n_b: int):
    step = max(1, CHUNK_CELLS // max(1, n_b))
    for start in range(0, n_q, step):
        yield slice(start, min(n_q, start + step))


def _same(q_ids, b_ids):
    """The pairs of rows with equal ids: (q rows, b rows), by q row."""
    by = np.argsort(b_ids, kind="stable")
    first, last = (np.searchsorted(b_ids[by], q_ids, side=s) for s in ("left", "right"))
    qi = np.repeat(np.arange(len(q_ids)), last - first)
    nth = np.arange(len(qi)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    return qi, by[first[qi] + nth]


def _shortlists(metric, q, b, k, q_ids, b_ids, skip_same, limits=None):
    """Row pairs among which are the k nearest of every row of q, or all up to each row's limit, in single precision.

    A few rows of q come at a time. The k-th smallest of the minima of disjoint strands of
    b is no less than the k-th distance. What rounding can add is bounded by the vectors'
    lengths. None for other metrics, a small b, a large k and values that single precision
    does not hold.
    """
    if metric not in ("sq_l2", "ip", "cosine") or len(b) < 4 * STRANDS or 8 * k > STRANDS:
        return None
    a, c = (q, b) if metric != "cosine" else (_unit(q), _unit(b))
    with np.errstate(over="ignore"):
        q_size, b_size = np.sqrt((a * a).sum(axis=1)), float(np.sqrt((c * c).sum(axis=1).max()))
    most = max(float(q_size.max()), b_size)
    if not most < 1e15:
        return None
    d = a.shape[1]
    scale = -2.0 if metric == "sq_l2" else -1.0
    # the norm of a row of b as one more dimension; what depends on the row of q alone changes no order
    left = np.concatenate([scale * a, np.ones((len(a), 1))], axis=1).astype(np.float32)
    norms = (c * c).sum(axis=1)[:, None] if metric == "sq_l2" else np.zeros((len(c), 1))
    right = np.concatenate([c, norms], axis=1).astype(np.float32).T.copy()
    error = (d + 8) * float(np.finfo(np.float32).eps) * (2.0 * q_size * b_size + b_size * b_size) + 1e-30
    # slack as for double precision, for distances as they are reported
    error = error + SLACK * (1.0 + (q_size + b_size) ** 2)
    step = max(1, STRAND_CELLS // len(b))
    width = len(b) // STRANDS
    same = _same(q_ids, b_ids) if skip_same else None
    # what the products leave out of a distance
    apart = {"sq_l2": q_size * q_size, "cosine": 1.0, "ip": 0.0}[metric]

    def run():
        for start in range(0, len(q), step):
            approx = left[start : start + step] @ right
            if same is not None:
                lo, hi = np.searchsorted(same[0], [start, start + len(approx)])
                approx[same[0][lo:hi] - start, same[1][lo:hi]] = np.inf
            if limits is None:
                strands = approx[:, : width * STRANDS].reshape(len(approx), width, STRANDS).min(axis=1)
                limit = np.partition(strands, k - 1, axis=1)[:, k - 1].astype(np.float64)
            else:
                limit = (limits - apart)[start : start + len(approx)]
            # rounded up
            limit = np.nextafter((limit + 2.0 * error[start : start + len(approx)]).astype(np.float32), np.float32(np.inf))
            at = np.flatnonzero(approx <= limit[:, None])
            at = at[np.isfinite(approx.ravel()[at])]
            yield at // len(b) + start, at % len(b)

    return run()


def _double_shortlists(metric, q, b, k, q_ids, b_ids, skip_same):
    """``_shortlists`` for any k, metric and values."""
    to_b = near_to(metric, b)
    for rows in _row_chunks(len(q), len(b)):
        approx = to_b(q[rows])
        if skip_same:
            approx[q_ids[rows][:, None] == b_ids[None, :]] = np.inf
        if k < len(b):
            kth = np.partition(approx, k - 1, axis=1)[:, k - 1 : k]
            keep = (approx <= kth + SLACK * (1.0 + np.abs(kth))) & np.isfinite(approx)
        else:
            keep = np.isfinite(approx)
        qi, bi = np.nonzero(keep)
        yield qi + rows.start, bi


def top_k(metric, q, b, k, q_ids=None, b_ids=None, skip_same=False, tie_ids=None):
    """The k nearest rows of b for every row of q: (q rows, b rows, distances).

    Equal distances are ordered by ``tie_ids`` (default: the row number in b).
    """
    tie_ids = np.arange(len(b)) if tie_ids is None else tie_ids
    out = []
    if len(q) == 0 or len(b) == 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    scales = lengths(metric, q), lengths(metric, b)
    few = _shortlists(metric, q, b, k, q_ids, b_ids, skip_same)
    for qi, bi in few if few is not None else _double_shortlists(metric, q, b, k, q_ids, b_ids, skip_same):
        dist = exact(metric, q, b, qi, bi, *scales) if len(qi) else np.empty(0)
        order = np.lexsort((tie_ids[bi], dist, qi))
        qi, bi, dist = qi[order], bi[order], dist[order]
        first = np.searchsorted(qi, qi, side="left")
        take = np.arange(len(qi)) - first < k
        out.append((qi[take], bi[take], dist[take]))
    return tuple(np.concatenate(part) for part in zip(*out))


def pairs_below_parts(metric, q, b, limit):
    """Row pairs with a distance below ``limit``, a chunk of at most ``CHUNK_CELLS`` at a time."""
    to_b, scales = near_to(metric, b), (lengths(metric, q), lengths(metric, b))
    for rows in _row_chunks(len(q), len(b)):
        qi, bi = np.nonzero(to_b(q[rows]) < limit + SLACK)
        if len(qi) == 0:
            continue
        qi = qi + rows.start
        dist = exact(metric, q, b, qi, bi, *scales)
        hit = dist < limit
        yield qi[hit], bi[hit], dist[hit]


def pairs_below(metric, q, b, limit):
    """Row pairs with a distance below ``limit``."""
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0)), *pairs_below_parts(metric, q, b, limit)]
    return tuple(np.concatenate(part) for part in zip(*out))


def near_parts(metric: str, q: np.ndarray, b: np.ndarray):
    """``near`` for a few rows of q at a time: (slice of q, distances) of at most ``CHUNK_CELLS``."""
    to_b = near_to(metric, b)
    for rows in _row_chunks(len(q), len(b)):
        yield rows, to_b(q[rows])


def _double_shortlists_up_to(metric, q, b, limits, q_ids, b_ids, skip_same):
    """``_shortlists`` up to limits for any metric and values."""
    to_b = near_to(metric, b)
    for rows in _row_chunks(len(q), len(b)):
        approx = to_b(q[rows])
        if skip_same:
            approx[q_ids[rows][:, None] == b_ids[None, :]] = np.inf
        limit = limits[rows][:, None]
        qi, bi = np.nonzero((approx <= limit + SLACK * (1.0 + np.abs(limit))) & np.isfinite(approx))
        yield qi + rows.start, bi


def up_to(metric, q, b, limits, q_ids=None, b_ids=None, skip_same=False):
    """Distances up to each query's own limit: (q rows, distances)."""
    out = [(np.empty(0, int), np.empty(0))]
    if len(q) == 0 or len(b) == 0:
        return out[0]
    scales = lengths(metric, q), lengths(metric, b)
    few = _shortlists(metric, q, b, 1, q_ids, b_ids, skip_same, limits)
    for qi, bi in few if few is not None else _double_shortlists_up_to(metric, q, b, limits, q_ids, b_ids, skip_same):
        dist = exact(metric, q, b, qi, bi, *scales) if len(qi) else np.empty(0)
        hit = dist <= limits[qi]
        out.append((qi[hit], dist[hit]))
    return tuple(np.concatenate(part) for part in zip(*out))


def spanning_forest(n, i, j, weight):
    """A maximum spanning forest of a weighted graph on n nodes.

    Dropping its edges below any threshold leaves the same connected parts as
    dropping the edges of the whole graph, so n - 1 edges stand for all pairs.
    """
    dense = np.full((n, n), -np.inf)
    dense[i, j] = weight
    dense[j, i] = np.maximum(dense[j, i], weight)
    best = np.full(n, -np.inf)
    link = np.full(n, -1)
    open_ = np.ones(n, bool)
    edges = []
    for _ in range(n):
        cand = np.where(open_, best, -np.inf)
        node = int(np.argmax(cand))
        if cand[node] == -np.inf:
            node = int(np.argmax(open_))
        else:
            edges.append((link[node], node, best[node]))
        open_[node] = False
        better = open_ & (dense[node] > best)
        best[better] = dense[node][better]
        link[better] = node
    if not edges:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    a, c, w = zip(*edges)
    return np.array(a), np.array(c), np.array(w)


def fixed_point(x: np.ndarray, scale: float = 1e9) -> np.ndarray:
    """Whole-number multiples of 1/scale; their sums do not depend on the order."""
    return np.floor(x * scale + 0.5).astype(np.int64)
