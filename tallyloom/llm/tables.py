"""How the operators of this folder read their tables and hand out work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bits of a membership filter, whatever the number of its members (one mebibyte).
BITS = 1 << 23
#: Rows that are Python objects at one time; an Arrow batch has many more.
SLICE = 512


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_slices(
    df: DataFrame,
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    rows: int = SLICE,
    members: DataFrame | None = None,
) -> DataFrame:
    """``df.mapInPandas(run, schema)`` with frames of at most ``rows`` rows, to bound a task's memory.

    With ``members`` (one column, also a column of ``df``) rows whose value is not among
    them are mostly left out beforehand: all members come through, and some others.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    bits = None
    if members is not None:
        (column,) = members.columns
        bits = bit_array(members.select(_place(column).alias("place")), "place")
        df = df.withColumn("_place", _place(column))

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        if bits is None:
            return batch
        at = batch.schema.get_field_index("_place")
        mask = pa.array(_is_set(bits, batch.column(at).to_numpy(zero_copy_only=False)))
        return batch.select([c for c in batch.schema.names if c != "_place"]).filter(mask)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, rows).to_pandas() for b in map(chosen, batches) for at in range(0, b.num_rows, rows))
        for out in run(parts):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(sliced, schema)


def bit_array(places: DataFrame, column: str) -> np.ndarray:
    """The set bits (numbers from 0 to BITS - 1 in ``column``) as an array of BITS / 8 bytes.

    A fixed size, so that it may go to the driver and out with the tasks. The more members,
    the more bits are set: a full array lets everything through and excludes no member.
    """
    bit = places.select((F.col(column) + 1).alias("bit"))
    parts = (
        bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    out = np.zeros(BITS // 8, np.uint8)
    for part in parts:
        chunk = np.frombuffer(part.bits, np.uint8)
        out[(part.bucket - 1) * len(chunk) : part.bucket * len(chunk)] = chunk
    return out


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places.astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def may_be_in(members: DataFrame, column: str) -> Column:
    """True for every row whose ``column`` is among the members', and for some others."""
    bits = bit_array(members.select(_place(column).alias("place")), "place")

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        return pd.Series(_is_set(bits, places.to_numpy()))

    return test(_place(column))


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``column`` is among ``ids``; NULLs stay.

    Rows that the bit array excludes pass without a shuffle; only the others are joined.
    """
    marked = may_be_in(ids, column)
    unsure = docs.filter(marked).join(ids.select(column).distinct(), column, "left_anti").select(*docs.columns)
    return docs.filter(~marked).unionByName(unsure)
