"""Metric tables: long (step, name, value) records, timing, environment stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Sections whose time is given per response token, and per prompt plus response token.
RESPONSE_SECTIONS = ("gen",)
OVERALL_SECTIONS = ("ref", "values", "adv", "update_critic", "update_actor", "rollout")


def timing_metrics(batch: DataFrame, timings: DataFrame, tokens_col: str = "responses",
                   prompt_col: str | None = None) -> DataFrame:
    """Seconds per section and milliseconds per token: ``gen`` per response token,
    the other timed sections per prompt plus response token, null for the rest.
    ``prompt_col`` is an array of prompt tokens or their number; without it prompts
    count nothing. The totals are scalar subqueries."""
    kind = dict(batch.dtypes).get(prompt_col or "", "")
    prompt = F.lit(0) if prompt_col is None else F.size(prompt_col) if kind.startswith("array") else F.col(prompt_col)
    response = batch.select(F.sum(F.size(tokens_col))).scalar()
    overall = batch.select(F.sum(F.size(tokens_col) + prompt)).scalar()
    tokens = (F.when(F.col("section").isin(*RESPONSE_SECTIONS), response)
              .when(F.col("section").isin(*OVERALL_SECTIONS), overall))
    return timings.select("section", "seconds", (F.col("seconds") * 1000.0 / tokens).alias("per_token_ms"))


def env_metrics(replay: DataFrame) -> DataFrame:
    """Actions mean/max/min, finish ratio, valid actions, mean per-row
    valid ratio, valid searches over a replayed rollout table."""
    t = F.col("turns")
    return replay.agg(
        F.avg(t).alias("env/number_of_actions/mean"), F.max(t).cast("double").alias("env/number_of_actions/max"),
        F.min(t).cast("double").alias("env/number_of_actions/min"),
        (1.0 - F.avg(F.col("active").cast("double"))).alias("env/finish_ratio"),
        F.avg("valid_actions").alias("env/number_of_valid_action"),
        F.avg(F.col("valid_actions") / t).alias("env/ratio_of_valid_action"),
        F.avg("valid_searches").alias("env/number_of_valid_search"))


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide metric row(s) -> long (keys..., metric, value)."""
    names = [c for c in wide.columns if c not in keys]
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
                             for c in names]))
    return wide.select(*keys, st.alias("_m")).select(*keys, "_m.metric", "_m.value")


def write_metrics(metrics: DataFrame, path: str, step: int | None = None) -> None:
    """Append (step, metric, value) records, of one ``step`` or of the table's own
    ``step`` column; a wide view is a pivot."""
    rows = metrics if step is None else metrics.withColumn("step", F.lit(step))
    rows.withColumn("step", F.col("step").cast("long")).write.mode("append").parquet(path)


def metrics_wide(metrics: DataFrame, names: list[str], index: str = "step") -> DataFrame:
    """One column per metric of ``names`` (a fixed list: no pass over the data to find them)."""
    return metrics.groupBy(index).pivot("metric", names).agg(F.first("value"))
