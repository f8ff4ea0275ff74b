"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ASCII white space that separates words, as the inside of a character class.
WHITE = r"\x20\x09-\x0D"


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def refuse(df: DataFrame, *columns: str) -> DataFrame:
    """Raise if the input has columns that the operator adds for itself."""
    clash = [c for c in columns if c in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    return df


def text_or_empty(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True for documents whose ``crc32(doc_id as text) mod folds`` is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with fields added."""
    clash = {f.name for f in fields} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    return T.StructType([*df.schema.fields, *fields])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time, so that a worker holds few texts as Python values."""
    return (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows))


def add_columns(
    df: DataFrame, source: str, fields: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]], rows: int = 512
) -> DataFrame:
    """Append columns that ``compute`` derives from the column ``source``, at most ``rows`` rows at a time."""
    schema = with_fields(df, *fields)
    arrow = [pa.field(f.name, _arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            made = compute(batch.column(source))
            columns = [*batch.columns, *(a.cast(f.type) for a, f in zip(made, arrow, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, *arrow]))

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
            "boolean": pa.bool_()}[kind.simpleString()]


def crc_fold(doc_id: object, folds: int) -> int:
    """The fold of one document, as :func:`held_out` computes it."""
    return zlib.crc32(str(doc_id).encode()) % folds


def sample_by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``keys``.

    The rows are counted and thinned out by their hash to a few times ``n`` before they are ordered, so that the one task which
    orders them gets no more than that, however many tasks there are.
    """
    share = (4 * n + 64) / max(df.count(), 1)
    rank = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    near = df.where(rank < int(share * 2**63)) if share < 1 else df
    return near.orderBy(rank, *keys).limit(n)


def runs(*keys: np.ndarray) -> np.ndarray:
    """The first index of each run of equal keys, and the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


class Remembered(dict):
    """A memory of at most two generations of ``size`` values: what is asked for again outlives the older one."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __setitem__(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        super().__setitem__(key, value)

    def recall(self, key):
        """The value if it is known, else None; one of the older generation moves to the younger."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value
