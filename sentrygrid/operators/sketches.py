"""Mergeable daily summaries: distinct assets and closing times of any period without reading its alerts again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two (a standard error of 1.04 / sqrt(2 ** 14), 0.8 %), and the size of a quantile summary (a
#: rank error of about 0.35 % at 99 %).
LG_K, QUANTILE_K = 14, 800
#: Errors that estimates keep: six standard errors of a count, and eight times the rank error, so that none of very many estimates is expected beyond.
COUNT_ERROR, RANK_ERROR = 0.05, 0.03


def daily(alerts: DataFrame, seconds: Column) -> DataFrame:
    """One row an entity and day: sketches of assets and of ``seconds``, and the number of alerts.  Days without a value have an empty sketch, null."""
    day = F.to_date("created_ts").alias("day")
    return alerts.where("entity_id is not null and created_ts is not null").groupBy("entity_id", day).agg(
        F.count("*").alias("alerts"), F.hll_sketch_agg("asset_id", LG_K).alias("assets"), F.kll_sketch_agg_double(seconds.cast("double"), QUANTILE_K).alias("seconds")
    )


def merged(days: DataFrame, *by: Column | str) -> DataFrame:
    """Days merged by any grouping: a month, a quarter, a sector that was joined on."""
    return days.groupBy(*by).agg(F.sum("alerts").alias("alerts"), F.hll_union_agg("assets").alias("assets"), F.kll_merge_agg_double("seconds").alias("seconds"))


def estimates(periods: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The number of distinct assets and the quantiles of closing times, as p50, p95 and so on."""
    quantiles = [F.kll_sketch_get_quantile_double("seconds", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return periods.select(*[c for c in periods.columns if c not in ("assets", "seconds")], F.hll_sketch_estimate("assets").alias("assets"), *quantiles)
