"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut

BLOCKS, BITS = 1024, 32768  # of a table of bits: 4 MB whatever the input


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose `key` may be among `keys` (one column of the same type), and rows whose key is not; no row moves.

    Each of `keys` sets one bit in a table of fixed size, so a few other rows come with the
    former: whatever is done with them must be right for those too. Many more keys than bits
    only make the former more.
    """
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BLOCKS * BITS))

    def block(c: Column) -> Column:
        return F.floor(c / BITS)

    at = bit(F.col(keys.columns[0]))
    bits = cut(keys.select(block(at).alias("_block"), F.pmod(at, F.lit(BITS)).alias("_bit"))
               .groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    marked = rows.withColumn("_at", bit(key)).withColumn("_block", block(F.col("_at"))).withColumn("_bit", F.pmod("_at", F.lit(BITS)).cast("int"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.col("_bit") % 8) == 1, F.lit(False))
    marked = marked.join(F.broadcast(bits), "_block", "left").withColumn("_found", found)
    return marked.filter("_found").select(rows.columns), marked.filter("NOT _found").select(rows.columns)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and whole text (null: empty), with other columns only if asked for."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def per_row(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, rows: int = 256) -> DataFrame:
    """Rows through Python in Arrow batches cut to `rows` rows; `make` runs once per task and returns the batch function."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pylist(work(batch.slice(at, rows).to_pylist()), schema=arrow)

    return df.mapInArrow(task, out)
