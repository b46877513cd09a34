"""Arithmetic hashes that any SQL engine can restate, for repeatable random choices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: a prime modulus and multipliers below it, so that
# products of two residues stay inside a BIGINT.
MODULUS = 2147483647
MULTIPLIER = 1103515245
SEED_STEP = 134775813


def _constants(seed: int) -> tuple[int, int]:
    return (MULTIPLIER + SEED_STEP * seed) % MODULUS, 12345 + seed % 100_000


def id_hash(col: Column | str, seed: int = 0) -> Column:
    """Hash of an integer id into [0, MODULUS): a product, then a quadratic step."""
    col = F.col(col) if isinstance(col, str) else col
    multiplier, addend = _constants(seed)
    x = F.pmod(F.pmod(col.cast("bigint"), F.lit(MODULUS)) * F.lit(multiplier), F.lit(MODULUS))
    return F.pmod(x * (x + F.lit(addend)), F.lit(MODULUS))


def id_hash_values(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same hash of an array of 64-bit ids."""
    multiplier, addend = _constants(seed)
    x = ids % MODULUS * multiplier % MODULUS
    return x * (x + addend) % MODULUS


def id_hash_sql(expr: str, seed: int = 0) -> str:
    """The same hash as SQL text."""
    multiplier, addend = _constants(seed)
    x = f"((({expr}) % {MODULUS}) * {multiplier} % {MODULUS})"
    return f"({x} * ({x} + {addend}) % {MODULUS})"


def in_sample(col: Column | str, share: float, seed: int = 0) -> Column:
    """True for about ``share`` of the ids, the same ids in every run."""
    return id_hash(col, seed) < F.lit(int(share * MODULUS))


def in_sample_sql(expr: str, share: float, seed: int = 0) -> str:
    return f"{id_hash_sql(expr, seed)} < {int(share * MODULUS)}"


def sign_matrix(rows: int, dim: int, seed: int = 0) -> np.ndarray:
    """Random +1/-1 matrix; entry (i, j) is the parity of the hash of ``i * dim + j``."""
    multiplier, addend = _constants(seed)
    x = np.arange(rows * dim, dtype=np.int64) % MODULUS * multiplier % MODULUS
    return np.where(x * (x + addend) % MODULUS % 2 == 0, 1.0, -1.0).reshape(rows, dim)


def sign_matrix_sql(rows: int, dim: int, seed: int = 0) -> str:
    """SELECT giving (row, signs) for the same matrix."""
    h = id_hash_sql("r * %d + c" % dim, seed)
    return (
        f"SELECT r AS row, list(CASE WHEN {h} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY c) AS signs "
        f"FROM range({rows}) a(r), range({dim}) b(c) GROUP BY r"
    )


def gaussian_matrix(rows: int, dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, dim))
