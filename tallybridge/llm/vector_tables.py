"""Vector columns as rows of bytes, and blocks of them as matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallybridge.workspace import Workspace

_ROWS = "vec_id long, dim int, key binary, x binary"


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), dim)


def clean(values: list | None) -> np.ndarray | None:
    """The vector in double precision; None if it is empty, zero or has NULL or non-finite components."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def scaled(x: np.ndarray) -> np.ndarray:
    """The vector times a power of two that brings its largest component near 1.

    Cosines stay the same to the last bit, and squares of huge components stay finite.
    """
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0  # no negative zeros


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, keys, rows = [], [], [], []
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = None if key is None else clean(values)
            if x is not None:
                ids.append(key)
                dims.append(len(x))
                rows.append(scaled(x).tobytes())
                keys.append(hashlib.blake2b(rows[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())],
            ["vec_id", "dim", "key", "x"],
        )


def directions(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, key, x`` of all ids of ``(id, vector)`` that have a direction.

    Of an id's different vectors that of the smallest digest stands for it.
    """
    return one_per_id(vectors.mapInArrow(_rows, _ROWS), ["key", "dim", "x"])


def one_per_id(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The row of every id that is least in ``columns``."""
    return rows.groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("_least")).select("vec_id", *[f"_least.{c}" for c in columns])


def foremost(rows: DataFrame, keys: list[str], most: int, workspace: Workspace, name: str) -> DataFrame:
    """Rows without those that follow ``most`` equal ones of smaller id.

    Nobody's nearest ``most`` hold a copy with ``most`` smaller equals, as ties go to the
    smaller id: what is left out can be in no result.
    """
    order = Window.partitionBy(*keys).orderBy("vec_id")
    return workspace.store(rows.withColumn("_place", F.row_number().over(order)).where(f"_place <= {most}").drop("_place"), name)
