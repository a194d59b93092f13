"""Temporal sections, from the number of connections on each day.

Rows are counted by day first.  There are at most as many days as the calendar
has, so what needs them in order - gaps, running counts, eras - is a window over
that small table, never over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions import estimators as E
from affinity.functions.dates import month_key
from affinity.functions.text import title_tokens

BURST_Z = 3.5
#: Eras: least gap in days, multiple of the median gap, least size, least share of rows, least dated rows.
GAP_DAYS, GAP_TIMES, ERA_LEAST, ERA_SHARE, ERA_ROWS = 45.0, 3.0, 5, 0.02, 12
DAYS_A_MONTH = 30.44


def day_counts(df: DataFrame) -> DataFrame:
    """day and n."""
    return df.filter("connected_on IS NOT NULL").groupBy(F.col("connected_on").alias("day")).agg(F.count("*").alias("n"))


def monthly(days: DataFrame) -> DataFrame:
    """Every month from the first to the last, also those without connections."""
    ends = days.agg(F.trunc(F.min("day"), "MM").alias("a"), F.trunc(F.max("day"), "MM").alias("b")).filter("a IS NOT NULL")
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select(month_key(F.col("m")).alias("month"))
    counts = days.groupBy(month_key(F.col("day")).alias("month")).agg(F.sum("n").alias("count"))
    return calendar.join(counts, "month", "left").select("month", F.coalesce("count", F.lit(0)).alias("count"))


def bursts(months: DataFrame) -> DataFrame:
    return E.modified_z(months, "count").filter(F.col("z") >= BURST_Z)


def yearly(days: DataFrame) -> DataFrame:
    return days.groupBy(F.year("day").cast("long").alias("year")).agg(F.sum("n").alias("count"))


def _placed(days: DataFrame) -> DataFrame:
    """day, n, before (rows of earlier days), gap (days since the day before it), total."""
    w = Window.orderBy("day")
    return days.select(
        "day",
        "n",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.datediff("day", F.lag("day").over(w)).cast("long").alias("gap"),
        F.lag("day").over(w).alias("previous"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )


def half_life(days: DataFrame) -> DataFrame:
    """The day by which half of the rows were there, and how far into the span it is."""
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    middle = _placed(days).filter("before + n >= total / 2").agg(F.min("day").alias("half_life"))
    span = F.datediff("last", "first")
    part = F.when(span > 0, E.rounded(F.datediff("half_life", "first") / span, 4))
    return middle.crossJoin(F.broadcast(ends)).select("half_life", part.alias("elapsed_fraction"))  # one row each


def longest_dormancy(days: DataFrame) -> DataFrame:
    """The largest gap between rows in order, the earliest of equals; gaps within a day are zero."""
    placed = _placed(days)
    within = placed.filter("n > 1").select(F.lit(0).cast("long").alias("days"), F.col("day").alias("from"), F.col("day").alias("to"))
    gaps = placed.filter("gap IS NOT NULL").select(F.col("gap").alias("days"), F.col("previous").alias("from"), F.col("day").alias("to"))
    return gaps.unionByName(within).orderBy(F.desc("days"), "from").limit(1)


def velocity(days: DataFrame) -> DataFrame:
    """The last twelve months against the twelve before."""
    last = days.agg(F.max("day").alias("last"))
    one = days.crossJoin(F.broadcast(last))  # one row
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    recent, early = F.date_sub("last", 365), F.date_sub("last", 730)
    counts = one.agg(total(F.col("day") > recent).alias("trailing_12m"), total((F.col("day") > early) & (F.col("day") <= recent)).alias("prior_12m"))
    change = E.rounded(F.try_divide((F.col("trailing_12m") - F.col("prior_12m")).cast("double"), F.col("prior_12m").cast("double")), 4)
    return counts.select("*", change.alias("pct_change")).select("*", F.when(F.col("pct_change") > 0.1, "expanding").when(F.col("pct_change") < -0.1, "contracting").otherwise("steady").alias("direction"))


def activity(months: DataFrame) -> DataFrame:
    """active_months, total_months, duty_cycle, median_month, peak month and the bursts' share of all."""
    z = E.modified_z(months, "count")
    count = F.col("count")
    a = z.agg(
        F.count_if(count > 0).alias("active_months"),
        F.count("*").alias("total_months"),
        F.median("count").alias("median_month"),
        F.min(F.struct((-count).alias("c"), "month")).alias("peak"),
        F.coalesce(F.sum(F.when(F.col("z") >= BURST_Z, count)), F.lit(0)).alias("in_bursts"),
        F.sum(count).alias("all"),
    )
    return a.select("active_months", "total_months", E.share(F.col("active_months"), F.col("total_months")).alias("duty_cycle"), "median_month", F.col("peak.month").alias("peak_month"), (-F.col("peak.c")).alias("peak_count"), E.share(F.col("in_bursts"), F.col("all")).alias("burst_share_of_volume"))


def era_days(days: DataFrame) -> DataFrame:
    """Every day with its era (from 0); empty under ``ERA_ROWS`` dated rows.

    A day begins an era if the gap before it is above the threshold and the era so
    far is large enough; a last era that is too small joins the one before it.
    Days whose gap qualifies are few, so the greedy choice is a fold over them.
    """
    placed = _placed(days)
    # gaps between rows in order: within a day they are zero
    gaps = placed.select(F.col("gap").alias("v"), F.lit(1).cast("long").alias("k")).filter("v IS NOT NULL").unionByName(placed.filter("n > 1").select(F.lit(0).cast("long").alias("v"), (F.col("n") - 1).alias("k")))
    rule = gaps.agg(F.expr("percentile(v, 0.5D, k)").alias("mid"), (F.sum("k") + 1).alias("rows")).select(
        F.greatest(F.lit(GAP_DAYS), F.lit(GAP_TIMES) * F.col("mid")).alias("threshold"), F.greatest(F.lit(ERA_LEAST).cast("long"), F.floor(F.col("rows") * F.lit(ERA_SHARE))).alias("least"), "rows"
    )
    placed = placed.crossJoin(F.broadcast(rule)).filter(F.col("rows") >= ERA_ROWS)  # one row
    cuts = placed.agg(F.array_sort(F.collect_list(F.when(F.col("gap") > F.col("threshold"), F.col("before")))).alias("at"), F.first("least").alias("least"), F.first("rows").alias("rows"))
    fold = F.aggregate("at", F.array(F.lit(0).cast("long")), lambda acc, p: F.when(p - F.element_at(acc, -1) >= F.col("least"), F.concat(acc, F.array(p))).otherwise(acc))
    cuts = cuts.select(fold.alias("cuts"), "least", "rows")
    short = (F.size("cuts") > 1) & (F.col("rows") - F.element_at("cuts", -1) < F.col("least"))
    cuts = cuts.select(F.when(short, F.slice("cuts", 1, F.size("cuts") - 1)).otherwise(F.col("cuts")).alias("cuts"))
    era = F.size(F.filter("cuts", lambda c: c <= F.col("before"))) - 1
    return placed.crossJoin(F.broadcast(cuts)).select("day", "n", era.cast("long").alias("era"), E.rounded("threshold", 1).alias("gap_threshold_days"), F.col("least").alias("min_segment_size"))  # one row


def era_profile(df: DataFrame, eras: DataFrame) -> DataFrame:
    """start, end, span_days, count, rate_per_month and mean_seniority_rank of each era."""
    spans = eras.groupBy("era").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.sum("n").alias("count"))
    span = F.greatest(F.datediff("end", "start"), F.lit(1)).cast("long")
    ranks = _of_era(df, eras).filter("seniority <> 'unknown'").groupBy("era").agg(E.rounded(F.avg("seniority_rank"), 2).alias("mean_seniority_rank"))
    return spans.join(ranks, "era", "left").select("era", "start", "end", span.alias("span_days"), "count", E.rounded(F.col("count") / (span / F.lit(DAYS_A_MONTH)), 2).alias("rate_per_month"), "mean_seniority_rank")


def _of_era(df: DataFrame, eras: DataFrame) -> DataFrame:
    """Dated rows with their era; the table of days is bounded by the calendar."""
    return df.join(F.broadcast(eras.select(F.col("day").alias("connected_on"), "era")), "connected_on")


def _ranked(counts: DataFrame, k: int, *order) -> DataFrame:
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("era").orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def era_top(df: DataFrame, eras: DataFrame, column: str, none: str, k: int) -> DataFrame:
    """The k commonest values of a column in each era; ties go to the one met first."""
    counts = _of_era(df, eras).filter(F.col(column) != none).groupBy("era", column).agg(F.count("*").alias("count"), F.min(F.struct("connected_on", "row_idx")).alias("first"))
    return _ranked(counts, k, F.desc("count"), F.col("first")).select("era", "place", column, "count")


def distinctive_terms(df: DataFrame, eras: DataFrame, k: int = 6) -> DataFrame:
    """Title words commoner in an era than in all: log ratio of smoothed shares, the k largest."""
    words = _of_era(df, eras).select("era", F.explode(title_tokens(F.col("position"))).alias("term"))
    local = words.groupBy("era", "term").agg(F.count("*").alias("count"))
    overall = local.groupBy("term").agg(F.sum("count").alias("g"))
    sizes = local.groupBy("era").agg(F.sum("count").alias("l_total"))
    whole = local.agg(F.sum("count").alias("g_total"))
    j = local.filter("count >= 2").join(overall, "term").join(F.broadcast(sizes), "era").crossJoin(F.broadcast(whole))  # a row for each era; one row
    score = F.log(((F.col("count") + 1) / (F.col("l_total") + 2)) / ((F.col("g") + 1) / (F.col("g_total") + 2)))
    return _ranked(j.withColumn("s", score), k, F.desc("s"), F.desc("term")).select("era", "place", "term", "count", E.rounded("s", 3).alias("log_odds"))
