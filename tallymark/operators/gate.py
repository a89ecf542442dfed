"""Regression gate: current metric cells against a stored baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.ordering import CONFIG_ORDER, config_order
from tallymark.operators.summary import latest_rows

# Fixed value: differences below this are formatting noise.
EPSILON = 1e-9
CELL_KEYS = ["config", "subset", "metric"]


def summary_cells(summary_rows: DataFrame, metrics: list[str], digits: int | None = 4) -> DataFrame:
    """(config, subset, metric, value) of the latest execution of each configuration.

    Gated values are those of the printed summary, so they are rounded to its four decimals unless ``digits`` is None.
    """
    unknown = [m for m in metrics if m not in summary_rows.columns]
    if unknown:
        raise ValueError(f"gated metrics are not columns of the summary: {', '.join(unknown)}")
    rows = latest_rows(summary_rows).select("config", "subset", *[F.col(m).cast("double") for m in metrics])
    cells = rows.unpivot(["config", "subset"], metrics, "metric", "value")
    return cells if digits is None else cells.withColumn("value", F.round("value", digits))


def gate(baseline: DataFrame, current: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells of either side that a threshold gates, with the presence flags the verdict needs.

    Both sides are first restricted to gated cells, so the full outer join carries nothing else.
    """
    gated = thresholds.select("metric", "subset", F.col("maxDrop").alias("max_drop"))
    b = baseline.select(*CELL_KEYS, F.col("value").alias("baseline"), F.lit(True).alias("has_baseline"))
    c = current.select(*CELL_KEYS, F.col("value").alias("current"), F.lit(True).alias("has_current"))
    cells = b.join(c, CELL_KEYS, "full_outer").join(gated, ["metric", "subset"])
    known = baseline.select("config").distinct().withColumn("config_in_baseline", F.lit(True))
    run = current.select("config").distinct().withColumn("config_in_current", F.lit(True))
    flagged = cells.join(known, "config", "left").join(run, "config", "left")
    flags = ("has_baseline", "has_current", "config_in_baseline", "config_in_current")
    return flagged.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def gate_verdicts(cells: DataFrame, eps: float = EPSILON) -> DataFrame:
    """(config, metric, subset, baseline, current, max_drop, result, breach). The order of the arms matters."""
    base, cur = F.col("baseline"), F.col("current")
    result = (
        F.when(~F.col("has_baseline") & ~F.col("config_in_baseline"), "new config, no baseline")
        .when(~F.col("has_baseline"), "no baseline")
        .when(~F.col("has_current") & ~F.col("config_in_current"), "❌ config not run")
        .when(base.isNull(), "n/a")
        .when(cur.isNull(), "❌ missing")
        .when(base - cur > F.col("max_drop") + eps, "❌ regression")
        .otherwise("✅")
    )
    judged = cells.withColumn("result", result)
    return judged.select(
        "config", "metric", "subset", "baseline", "current", "max_drop", "result",
        F.col("result").startswith("❌").alias("breach"))


def promote_baseline(current: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The gated cells of the current summary, which become the next baseline."""
    return current.join(thresholds.select("metric", "subset"), ["metric", "subset"], "left_semi").select(
        *CELL_KEYS, "value")


def baseline_order(cells: DataFrame, thresholds: DataFrame, ranked=CONFIG_ORDER) -> DataFrame:
    """Cells in configuration order, then in the order of the thresholds (their ``position`` column)."""
    placed = cells.join(thresholds.select("metric", "subset", "position"), ["metric", "subset"])
    return placed.orderBy(config_order(F.col("config"), ranked), "config", "position").select(*CELL_KEYS, "value")
