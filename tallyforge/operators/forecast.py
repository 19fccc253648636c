"""Monthly forecasts of every series in one job, as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import periods
from tallyforge.functions.money import MONEY

ALPHA, BETA = 0.5, 0.2
SEASON = 12


def monthly_series(history: DataFrame, by: str, last: str, lookback: int) -> DataFrame:
    """(by, values): ``lookback`` monthly totals ending in ``last``, oldest first, missing months 0."""
    months = periods.between(periods.shift(last, 1 - lookback), last)
    inside = history.where(F.col("period").isin(months)).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("period", F.col("total").cast("double")))).alias("_m"))
    spine = F.array(*map(F.lit, months))
    return inside.select(by, F.transform(spine, lambda m: F.coalesce(F.try_element_at("_m", m), F.lit(0.0))).alias("values"))


def of_largest(history: DataFrame, by: str, period: str, n: int = 8) -> DataFrame:
    """The history of the ``n`` series with the largest totals in ``period``."""
    largest = history.where(F.col("period") == period).orderBy(F.desc("total"), by).limit(n)
    return history.join(largest.select(by), by, "left_semi")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _steps(h: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: k.cast("double"))


def _floor(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def _result(forecast: Column, rmse: Column) -> Column:
    return F.struct(forecast.alias("forecast"), rmse.alias("rmse"))


def mean(values: Column, h: int) -> Column:
    """The mean (0 of nothing) repeated."""
    n = F.size(values)
    m = F.when(n > 0, F.try_divide(_sum(values), n.cast("double"))).otherwise(F.lit(0.0))
    return _result(F.transform(_steps(h), lambda k: m), F.lit(0.0))


def linear(values: Column, h: int) -> Column:
    """Least squares over 0, 1, ..., carried on and floored at 0; fewer than 2 values repeat."""
    n = F.size(values).cast("double")
    x_mean, y_mean = (n - 1) / 2, F.try_divide(_sum(values), n)
    cross = _sum(F.transform(values, lambda y, i: (i.cast("double") - x_mean) * (y - y_mean)))
    square = _sum(F.transform(values, lambda y, i: (i.cast("double") - x_mean) * (i.cast("double") - x_mean)))
    slope = F.coalesce(F.try_divide(cross, square), F.lit(0.0))
    start = y_mean - slope * x_mean
    errors = _sum(F.transform(values, lambda y, i: F.pow(y - start - slope * i.cast("double"), F.lit(2.0))))
    out = _result(_floor(F.transform(_steps(h), lambda k: start + slope * (n + k - 1))), F.sqrt(F.try_divide(errors, n)))
    return F.when(F.size(values) >= 2, out).otherwise(mean(values, h))


def holt(values: Column, h: int, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Double exponential smoothing; the first fitted value is the second observation, so its error is 0."""
    first, second = F.element_at(values, 1), F.try_element_at(values, F.lit(2))
    start = F.struct(first.alias("level"), (second - first).alias("trend"), F.lit(0.0).alias("sse"), F.lit(0).alias("t"))

    def step(s: Column, y: Column) -> Column:
        fitted = s["level"] + s["trend"]
        level = F.lit(alpha) * y + F.lit(1 - alpha) * fitted
        trend = F.lit(beta) * (level - s["level"]) + F.lit(1 - beta) * s["trend"]
        error = F.when(s["t"] == 0, F.lit(0.0)).otherwise(F.pow(y - fitted, F.lit(2.0)))
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sse"] + error).alias("sse"), (s["t"] + 1).alias("t"))

    end = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
    out = _result(_floor(F.transform(_steps(h), lambda k: end["level"] + k * end["trend"])), F.sqrt(F.try_divide(end["sse"], (F.size(values) - 1).cast("double"))))
    return F.when(F.size(values) >= 2, out).otherwise(mean(values, h))


def seasonal(values: Column, h: int, season: int = SEASON) -> Column:
    """The value a season ago; under two seasons the mean."""
    n = F.size(values)
    errors = _sum(F.zip_with(F.slice(values, season + 1, F.greatest(n - season, F.lit(0))), F.slice(values, 1, F.greatest(n - season, F.lit(0))), lambda a, b: (a - b) * (a - b)))
    again = F.transform(_steps(h), lambda k: F.element_at(values, (n - season + F.pmod(k.cast("int") - 1, F.lit(season)) + 1).cast("int")))
    return F.when(n >= 2 * season, _result(again, F.sqrt(F.try_divide(errors, (n - season).cast("double"))))).otherwise(mean(values, h))


def forecast(series: DataFrame, last: str, h: int = 3) -> DataFrame:
    """Each series' method by its length (24 seasonal, 6 smoothing, 2 linear, else mean), forecasts, rmse and average, to 2 places."""
    n, v = F.size("values"), F.col("values")
    method = F.when(n >= 2 * SEASON, "seasonal_naive").when(n >= 6, "holt").when(n >= 2, "linear").otherwise("mean")
    result = F.when(n >= 2 * SEASON, seasonal(v, h)).when(n >= 6, holt(v, h)).when(n >= 2, linear(v, h)).otherwise(mean(v, h))
    keys = [c for c in series.columns if c != "values"]
    out = series.select(*keys, "values", method.alias("method"), result.alias("_r"))
    money = lambda c: F.round(c, 6)
    return out.select(*keys, "method", F.array(*map(F.lit, periods.following(last, h))).alias("periods"), F.transform("_r.forecast", money).alias("forecast"), money(F.col("_r.rmse")).alias("rmse"), money(F.try_divide(_sum(v), n.cast("double"))).alias("monthly_average"))


def to_money(c: Column) -> Column:
    return F.bround(c, 2).cast(MONEY)


def scaled(points: DataFrame, by: str, value: str) -> DataFrame:
    """``scaled``: values from 0 to 1 within each series; a flat series counts as span 1."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return points.withColumn("scaled", F.round((F.col(value) - low).cast("double") / F.when(span == 0, F.lit(1.0)).otherwise(span.cast("double")), 6))
