"""Vector functions as Column expressions over arrays; nothing here leaves the JVM.

Sums run left to right in double precision, so results repeat bit for bit.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

SMOOTHING = 1e-10


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An outer expression used inside an array lambda is evaluated for every
    element; binding it as a lambda variable evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(col: Column | str) -> Column:
    return _c(col).cast("array<double>")


def total(col: Column | str) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x)


def _pairwise(a, b, f) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), f))


def dot(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, eps: float = 0.0) -> Column:
    """``x / (norm + eps)``; a zero vector stays zero."""
    return let(
        l2_norm(a) + F.lit(eps),
        lambda norm: F.transform(doubles(a), lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))),
    )


def cosine_sim(a, b) -> Column:
    """Zero when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def cosine_dist(a, b) -> Column:
    return F.lit(1.0) - cosine_sim(a, b)


def sq_l2(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def l2(a, b) -> Column:
    return F.sqrt(sq_l2(a, b))


def l1(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: F.abs(x - y))


def minkowski(a, b, p: float) -> Column:
    return F.pow(_pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def cosine_from_sq_l2(sq_dist, norm_a, norm_b) -> Column:
    """Cosine from a squared distance that an earlier step already carries, and the two norms."""
    a, b, d = _c(norm_a), _c(norm_b), _c(sq_dist)
    inner = F.lit(0.5) * (a * a + b * b - d)
    cos = inner / F.greatest(a * b, F.lit(1e-12))
    return F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))


def _exps(a: Column) -> Column:
    return let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))


def _to_shares(exps: Column) -> Column:
    return let(
        exps,
        lambda e: let(
            total(e), lambda s: F.transform(e, lambda x: F.coalesce(F.try_divide(x, s), F.lit(0.0)))
        ),
    )


def softmax(a) -> Column:
    return _to_shares(_exps(doubles(a)))


def logsumexp(a) -> Column:
    a = doubles(a)
    return let(F.array_max(a), lambda top: top + F.ln(total(F.transform(a, lambda x: F.exp(x - top)))))


def log_softmax(a) -> Column:
    return let(logsumexp(a), lambda norm: F.transform(doubles(a), lambda x: x - norm))


def log_smooth(a, eps: float = SMOOTHING) -> Column:
    return F.transform(doubles(a), lambda x: F.ln(x + F.lit(eps)))


def neg_entropy(a, eps: float = SMOOTHING) -> Column:
    return total(F.transform(doubles(a), lambda x: x * F.ln(x + F.lit(eps))))


def kl_div(p, q, eps: float = SMOOTHING) -> Column:
    """KL(p || q), smoothed inside the logarithms."""
    return _pairwise(p, q, lambda x, y: x * (F.ln(x + F.lit(eps)) - F.ln(y + F.lit(eps))))


def kl_from_parts(p_neg_entropy, p, log_q) -> Column:
    """KL from a precomputed negative entropy of p and a precomputed log q."""
    return _c(p_neg_entropy) - dot(p, log_q)


def js_div(p, q) -> Column:
    def term(x, y):
        mid = (x + y) / F.lit(2.0)
        left = F.when(x > 0, x * (F.ln(x) - F.ln(mid))).otherwise(F.lit(0.0))
        right = F.when(y > 0, y * (F.ln(y) - F.ln(mid))).otherwise(F.lit(0.0))
        return F.lit(0.5) * left + F.lit(0.5) * right

    return _pairwise(p, q, term)


def cross_entropy(logits, label) -> Column:
    return logsumexp(logits) - F.element_at(doubles(logits), (_c(label) + 1).cast("int"))


def argmax(a) -> Column:
    """Zero-based position of the first maximum."""
    a = doubles(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def top2(a) -> tuple[Column, Column]:
    ordered = F.sort_array(doubles(a), asc=False)
    return F.element_at(ordered, 1), F.element_at(ordered, 2)


def project(a, matrix) -> Column:
    """Multiply by a small constant matrix, given as rows of numbers or an array column."""
    if not isinstance(matrix, Column):
        matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return F.transform(matrix, lambda row: dot(row, a))


def masked_softmax(logits, mask) -> Column:
    """Softmax over the unmasked entries only; masked entries get 0."""
    kept = F.zip_with(doubles(logits), _c(mask).cast("array<boolean>"), lambda x, m: F.when(m, x))
    return _to_shares(
        let(
            F.array_max(kept),
            lambda top: F.transform(kept, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))),
        )
    )


def renormalize_masked(probs, mask) -> Column:
    """Probabilities with masked entries zeroed and the rest scaled to sum to 1."""
    return _to_shares(
        F.zip_with(doubles(probs), _c(mask).cast("array<boolean>"), lambda x, m: F.when(m, x).otherwise(0.0))
    )


def minus_onehot(probs, label) -> Column:
    label = _c(label)
    return F.transform(doubles(probs), lambda x, i: x - F.when(i == label, 1.0).otherwise(0.0))


def outer_flat(a, b) -> Column:
    """Outer product of two vectors as one flat array, row by row."""
    return let(
        doubles(b), lambda v: F.flatten(F.transform(doubles(a), lambda s: F.transform(v, lambda x: s * x)))
    )


def add(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def scale(a, factor) -> Column:
    factor = _c(factor) if isinstance(factor, str) else factor
    return F.transform(doubles(a), lambda x: x * factor)


def mean_of_rows(rows, n) -> Column:
    """Mean over the outer array of an ``array<array<double>>`` column."""
    rows = _c(rows)
    summed = F.aggregate(
        F.slice(rows, 2, F.size(rows)), F.element_at(rows, 1), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)
    )
    return F.transform(summed, lambda x: x / n)


def round_all(a, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, digits))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)
