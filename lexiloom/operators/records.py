"""Experiment records: progress of record times, significance of run losses, training logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Record number and time in minutes.
RECORD_MINUTES = [
    (1, 45.0), (2, 31.4), (3, 24.9), (4, 22.3), (5, 15.2), (6, 13.1), (7, 12.0), (8, 10.8), (9, 8.2), (10, 7.8), (11, 7.2),
    (12, 5.03), (13, 4.66), (14, 4.41), (15, 3.95), (16, 3.8), (17, 3.57), (18, 3.4), (19, 3.142), (20, 2.992), (21, 2.933),
]

#: Validation losses of eighty runs of one record.
RUN_LOSSES = [
    3.2798, 3.2804, 3.2837, 3.2808, 3.2782, 3.2801, 3.283, 3.2825, 3.2777, 3.2769, 3.2834, 3.2832, 3.2753,
    3.2809, 3.2778, 3.2801, 3.2799, 3.2804, 3.2765, 3.2792, 3.2786, 3.2792, 3.2801, 3.2762, 3.2803, 3.2784,
    3.2792, 3.2791, 3.2769, 3.279, 3.2784, 3.2775, 3.283, 3.2785, 3.2753, 3.2805, 3.2766, 3.2766, 3.2781,
    3.2819, 3.2754, 3.2827, 3.2803, 3.2784, 3.2802, 3.2794, 3.2765, 3.278, 3.2782, 3.278, 3.2816, 3.279,
    3.2771, 3.2791, 3.2768, 3.2781, 3.2794, 3.2798, 3.2785, 3.2804, 3.2777, 3.2765, 3.2796, 3.278, 3.2803,
    3.2793, 3.2793, 3.2788, 3.2797, 3.278, 3.2799, 3.2813, 3.2803, 3.2768, 3.2803, 3.2796, 3.28, 3.2796,
    3.2783, 3.278,
]


def record_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECORD_MINUTES, "n int, minutes double")


def run_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(RUN_LOSSES)), "run int, val_loss double")


def progression(records: DataFrame) -> DataFrame:
    """Each record with the one before, its speed-up over it and over the first."""
    w = Window.orderBy("n")
    before, first = F.lag("minutes").over(w), F.first("minutes").over(w)
    return records.select("n", "minutes", before.alias("previous"), (before / F.col("minutes")).alias("speed_up"), (first / F.col("minutes")).alias("total_speed_up"))


def significance(runs: DataFrame, threshold: float = 3.28, loss: str = "val_loss") -> DataFrame:
    """One row: n, mean, std, t and df of the one-sided test that the mean is below the threshold."""
    x = runs.agg(F.count(loss).alias("n"), F.avg(loss).alias("mean"), F.stddev_samp(loss).alias("std"))
    return x.withColumns({"t": (F.col("mean") - threshold) / (F.col("std") / F.sqrt("n")), "df": F.col("n") - 1})


def p_below(t: float, df: float) -> float:
    """Student's distribution function at t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    tail = 0.5 * _incomplete_beta(df / 2, 0.5, x)
    return tail if t < 0 else 1 - tail


def t_quantile(q: float, df: float) -> float:
    """The t with ``p_below(t, df) = q``, by bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if p_below(middle, df) < q else (low, middle)
    return (low + high) / 2


def judged(tested: DataFrame, share: float = 0.95) -> DataFrame:
    """A row of ``significance`` with p, the chance of a t as low if the mean were the threshold, and low and high, between
    which the mean lies with the probability ``share`` if nothing was known of it before (flat prior)."""
    p = F.udf(lambda t, df: p_below(t, df), "double")
    q = F.udf(lambda df: t_quantile((1 + share) / 2, df), "double")
    x = tested.withColumns({"p": p(F.col("t"), F.col("df").cast("double")), "_e": q(F.col("df").cast("double")) * F.col("std") / F.sqrt("n")})
    return x.withColumns({"low": F.col("mean") - F.col("_e"), "high": F.col("mean") + F.col("_e")}).drop("_e")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(step, val_loss, train_time_ms, step_avg_ms) of both log formats; other lines go."""
    v = F.col(value)
    new = r"^step:(\d+)(?:/\d+)? val_loss:([\d.]+)(?: train_time:([\d.]+)ms)?(?: step_avg:([\d.na]+)ms)?"
    old = r"^s:(\d+) tel:([\d.]+)"

    def number(pattern, k, kind):
        return F.nullif(F.regexp_extract(v, pattern, k), F.lit("")).try_cast(kind)

    x = lines.select(
        F.coalesce(number(new, 1, "int"), number(old, 1, "int")).alias("step"), F.coalesce(number(new, 2, "double"), number(old, 2, "double")).alias("val_loss"),
        number(new, 3, "double").alias("train_time_ms"), number(new, 4, "double").alias("step_avg_ms"),
    )
    return x.filter("step is not null")


def mean_over_ranks(losses: DataFrame, steps: str = "step") -> DataFrame:
    """The mean over validation batches of each rank, then over ranks."""
    return losses.groupBy(steps, "rank").agg(F.avg("loss").alias("loss")).groupBy(steps).agg(F.avg("loss").alias("loss"))
