"""Estimators over a numeric column.

All of them start from the histogram of the values (value, how often), which is
small however many rows there are: an employer network of n people has at most
about sqrt(2n) distinct sizes.  So the ordered windows that rank-based estimators
need run over the histogram and never over the rows.

Values that are NULL or NaN do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str) -> DataFrame:
    """v (double) and n of every distinct value."""
    v = F.col(value).cast("double")
    return df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count("*").alias("n"))


def rounded(c: Column | str, digits: int) -> Column:
    """To so many places by the binary value, which a decimal tie may lie above or below of."""
    c, scale = (F.col(c) if isinstance(c, str) else c).cast("double"), float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def share(part: Column, whole: Column) -> Column:
    """part / whole to four places, 0 where there is no whole."""
    return F.coalesce(rounded(F.try_divide(part.cast("double"), whole.cast("double")), 4), F.lit(0.0))


def concentration(hist: DataFrame, k: int = 10, x_min: float = 1.0) -> DataFrame:
    """One row: gini, hhi, entropy, evenness, effective, top_k_share, alpha, median, p95, n, total."""
    up, down = Window.orderBy("v"), Window.orderBy(F.desc("v"))
    ranked = hist.filter("v >= 0").select(
        "v",
        F.col("n").cast("double").alias("n"),
        F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("below"),
        F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("n"))).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("above"),
        (F.sum(F.col("v") * F.col("n")).over(Window.partitionBy())).alias("total"),
    )
    v, n = F.col("v"), F.col("n")
    p = F.try_divide(v, F.col("total"))
    positive = v > 0
    a = ranked.agg(
        F.sum("n").alias("N"),
        F.max("total").alias("total"),
        F.sum(v * (n * F.col("below") + n * (n + 1) / 2)).alias("weighted"),
        F.coalesce(F.sum(F.when(positive, n)), F.lit(0.0)).alias("m"),
        F.sum(F.when(positive, n * p * p)).alias("squares"),
        F.sum(F.when(positive, -n * p * F.log(p))).alias("h"),
        F.sum(F.when(positive, F.least(n, F.greatest(F.lit(float(k)) - F.col("above"), F.lit(0.0))) * v)).alias("top"),
        F.coalesce(F.sum(F.when(v >= x_min, n)), F.lit(0.0)).alias("tail"),
        F.sum(F.when(v >= x_min, n * F.log(v / F.lit(x_min - 0.5)))).alias("logs"),
        F.expr("percentile(v, 0.5D, cast(n as bigint))").alias("median"),
        F.expr("percentile(v, 0.95D, cast(n as bigint))").alias("p95"),
    )
    some = F.coalesce(F.col("total"), F.lit(0.0)) > 0
    m = F.col("m")
    entropy = F.when(m > 1, rounded("h", 4)).otherwise(F.lit(0.0))
    alpha = F.when((F.col("tail") >= 10) & (F.col("logs") > 0), rounded(1 + F.col("tail") / F.col("logs"), 3))
    return a.select(
        F.when(some, rounded(2 * F.col("weighted") / (F.col("N") * F.col("total")) - (F.col("N") + 1) / F.col("N"), 4)).otherwise(F.lit(0.0)).alias("gini"),
        F.when(m < 1, 0.0).when(m == 1, 1.0).otherwise(rounded(F.greatest(F.try_divide(F.col("squares") - 1 / m, 1 - 1 / m), F.lit(0.0)), 4)).alias("hhi"),
        entropy.alias("entropy"),
        F.when(m > 1, rounded(F.try_divide(entropy, F.log(m)), 4)).otherwise(F.lit(0.0)).alias("evenness"),
        F.when(m >= 1, rounded(F.exp(entropy), 2)).otherwise(F.lit(0.0)).alias("effective"),
        F.when(some, rounded(F.col("top") / F.col("total"), 4)).otherwise(F.lit(0.0)).alias("top_k_share"),
        alpha.alias("alpha"),
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce(rounded("p95", 2), F.lit(0.0)).alias("p95"),
        F.coalesce(F.col("N"), F.lit(0.0)).cast("long").alias("n"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
    )


def tail_regime(alpha: Column) -> Column:
    return F.when(alpha.isNull(), "insufficient_data").when(alpha < 2.0, "extreme_hub_dominance").when(alpha < 3.0, "heavy_tailed").otherwise("thin_tailed")


def spread(hist: DataFrame) -> DataFrame:
    """One row: median, mad (median absolute deviation) and aad (mean absolute deviation from the median)."""
    middle = hist.agg(F.coalesce(F.expr("percentile(v, 0.5D, n)"), F.lit(0.0)).alias("median"))
    off = hist.crossJoin(F.broadcast(middle)).select("median", F.abs(F.col("v") - F.col("median")).alias("d"), "n")  # one row
    return off.groupBy().agg(F.first("median").alias("median"), F.expr("percentile(d, 0.5D, n)").alias("mad"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("aad")).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median", "mad", "aad")])


def modified_z(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """``df`` with the robust z-score of each value, to three places."""
    one = spread(histogram(df, value))
    x = F.col(value).cast("double") - F.col("median")
    z = F.when(F.col("mad") > 0, F.lit(0.6745) * x / F.col("mad")).when(F.col("aad") > 0, F.lit(0.7979) * x / F.col("aad")).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(one)).withColumn(name, rounded(z, 3)).drop("median", "mad", "aad")  # one row


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept and r_squared of the least-squares line, with n."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.filter(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"), F.avg(a).alias("mx"), F.avg(b).alias("my")
    )
    few, flat = F.col("n") < 2, F.col("sxx") == 0
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    fit = F.when(F.col("syy") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))))
    return s.select(
        F.when(few | flat, 0.0).otherwise(rounded(slope, 4)).alias("slope"),
        F.when(few, 0.0).when(flat, F.col("my")).otherwise(rounded(F.col("my") - slope * F.col("mx"), 4)).alias("intercept"),
        F.when(few | flat, 0.0).otherwise(rounded(fit, 4)).alias("r_squared"),
        "n",
    )
