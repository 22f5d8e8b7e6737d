"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components beyond it, either way, count as it, so that sums of products stay whole numbers of 64 bits.
LIMIT = 1 << 24
#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def sound(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows whose vector is not null, not empty and has finite components only.

    All vectors are of one width, that of the vector with the smallest vec_id; rows of another width are left out.
    """
    vector = F.col("embedding").cast("array<double>").alias("vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector)
    kept = kept.filter((F.size("vector") > 0) & finite)
    width = kept.agg(F.coalesce(F.min_by(F.size("vector"), "vec_id"), F.max(F.size("vector")))).first()[0]
    return kept.filter(F.size("vector") == F.lit(width))


def whole(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of every component, one row for each vector."""
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return np.clip(found, -LIMIT, LIMIT).astype(np.int64).reshape(len(column), -1 if len(column) else 0)


def ids(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit numbers, null as ``NO_ID``."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def products(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles, which are faster, if ``vectors`` is of doubles (see ``fast``)."""
    return (vectors @ one.astype(vectors.dtype)).astype(np.int64)


def fast(vectors: np.ndarray, most: int) -> np.ndarray:
    """The vectors as doubles where all products with components up to ``most`` are exact in them, else unchanged."""
    own = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.float64) if own * most * max(1, vectors.shape[1]) < 1 << 53 else vectors
