"""Row numbers that do not put a whole group into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import materialise


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", width: int = 1_000_000) -> DataFrame:
    """Number the rows of each key 1..n in the order of the columns ``order``.

    The last order column is an integer, unique among rows that agree on the
    key and the other order columns.  Rows are cut into buckets of ``width``
    consecutive values of it; a bucket's offset is the running sum of the
    bucket counts, and rows are only numbered inside their bucket.  No window
    holds more than ``width`` rows, however large a group is.
    """
    *coarse, seq = order
    cut = df.withColumn("_bucket", F.floor(F.col(seq) / F.lit(width)))
    by = [*keys, *coarse, "_bucket"]
    earlier = (
        Window.partitionBy(*keys).orderBy(*coarse, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*by).orderBy(seq)
    return (
        cut.join(offsets, by)
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def rank_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Number the rows of each key 1..n in the order of the columns ``order``, which may be of any type.

    Rows are dealt out by ranges of key and order and written, so that their parts stay as they are; a part is
    numbered by itself, and its offset is the running sum of the counts of the parts before it.  A key with any
    number of rows spreads over as many parts as its rows need.  Pass narrow rows and join the rank back.
    """
    parted = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    by = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return parted.withColumn("_inside", inside).join(offsets, by).withColumn(out, (F.col("_offset") + F.col("_inside")).cast("int")).drop(
        "_part", "_inside", "_offset"
    )
