"""Id encoders (M1, M2): dense 0..k-1 codes in lexicographic order of the id text.

No single-task window: the distinct ids are range-partitioned and sorted once,
written with their place in their partition, and per-partition sizes (one row per
partition) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import cut_lineage


_PART_BITS = 33   # monotonically_increasing_id: partition number above, position below


def global_index(df: DataFrame, order, out: str, partitions: int | None = None) -> DataFrame:
    """Number all rows 1..N in the given order (columns or sort expressions). One
    shuffle: rows are range-partitioned and sorted there, each takes its position in its
    partition, and the sizes of the partitions before it are added."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: a single-partition window over them is bounded
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0))
                           .alias("_offset"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_offset") + local + 1)
            .drop("_part", "_offset", "_at"))


def fit_encoder(ids: DataFrame, col: str, code: str, partitions: int | None = None) -> DataFrame:
    """M1: (col, code) with code = rank of cast(col as string) - 1."""
    distinct = (ids.select(col).where(F.col(col).isNotNull()).distinct()
                .withColumn("_key", F.col(col).cast("string")))
    idx = global_index(distinct, [F.col("_key")], "_idx", partitions)
    return idx.select(col, (F.col("_idx") - 1).cast("int").alias(code))


def encode(df: DataFrame, encoder: DataFrame, col: str) -> DataFrame:
    """Attach the code of ``col`` (inner: unknown ids have no code)."""
    return df.join(encoder, col, "inner")


def decode(df: DataFrame, encoder: DataFrame, col: str, code: str) -> DataFrame:
    """M2: code -> id."""
    return df.join(encoder, code, "inner").drop(code)
