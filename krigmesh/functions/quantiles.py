"""Exact quantiles (linear interpolation between order statistics) with bounded aggregation state.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a bounded sketch first brackets
each quantile between two values of the column; rows below a bracket are only counted, and the two order statistics
are found among the distinct values inside it, a few thousandths of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """by columns, n, and one column for each named probability; null values are left out."""
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 5.0 / accuracy
    lows, highs = [max(0.0, p - margin) for p in named.values()], [min(1.0, p + margin) for p in named.values()]
    arr = lambda ps: F.array(*[F.lit(p) for p in ps])
    box = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", arr(lows), accuracy).alias("_lo"), F.percentile_approx("_v", arr(highs), accuracy).alias("_hi"))
    small = F.col("n") <= 10 * accuracy  # the sketch's error may be a whole rank here
    part = [F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.when(small | F.lit(lows[k] == 0), F.col("_min")).otherwise(F.col("_lo")[k]).alias("lo"), F.when(small | F.lit(highs[k] == 1), F.col("_max")).otherwise(F.col("_hi")[k]).alias("hi")) for k, p in enumerate(named.values())]
    box = box.where("n > 0").select(*by, "n", F.explode(F.array(*part)).alias("b")).select(*by, "n", "b.*")
    met = rows.join(box, by) if by else rows.crossJoin(F.broadcast(box))  # a row for each probability
    below = met.where("_v < lo").groupBy(*by, "k").agg(F.count("*").alias("_below"))
    inside = met.where("_v between lo and hi").groupBy(*by, "k", "_v").agg(F.count("*").alias("c"))
    inside = inside.withColumn("_upto", F.sum("c").over(Window.partitionBy(*by, "k").orderBy("_v")))
    at = (F.col("n") - 1) * F.col("p")
    ranked = box.join(below, [*by, "k"], "left").withColumn("_r", F.floor(at) - F.coalesce("_below", F.lit(0))).withColumn("_f", at - F.floor(at))
    got = ranked.join(inside, [*by, "k"]).groupBy(*by, "k").agg(F.max("n").alias("n"), F.min(F.when(F.col("_upto") > F.col("_r"), F.col("_v"))).alias("a"), F.min(F.when(F.col("_upto") > F.col("_r") + 1, F.col("_v"))).alias("z"), F.max("_f").alias("f"))
    q = F.col("a") + (F.coalesce("z", "a") - F.col("a")) * F.col("f")
    return got.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, q)).alias(name) for k, name in enumerate(named)])
