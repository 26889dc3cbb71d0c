"""Feature tables to forecasts and an error report."""

from __future__ import annotations

import logging
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from trafficlens import fixed_values as V
from trafficlens.operators import combine, forecast
from trafficlens.operators.forecast import Budget
from trafficlens.session import side_by_side, written
from trafficlens.sources import tables

log = logging.getLogger(__name__)


def train_grid(
    spark: SparkSession, path: str, out: str | None = None, cut: str = V.HOLD_OUT_DATE,
    freqs=tuple(V.FREQ_MINUTES), targets=tuple(V.TARGETS), budget: Budget = Budget(),
    split: str = "train", read=tables.read_table,
) -> DataFrame:
    """Fit every frequency and target; one report row each.

    Each table is stored once and read by all of its targets; the cells are fitted side
    by side. With ``out`` the forecasts, models and the report are written there. A cell
    whose table is missing or empty, or whose fit fails, is logged and left out.
    """
    tables_of = {}
    for freq in freqs:
        try:
            table = read(spark, path, freq, split)
        except FileNotFoundError as error:
            log.warning("no table at %s: %s", freq, error)
            continue
        if table.isEmpty():
            log.warning("no rows at %s", freq)
            continue
        tables_of[freq] = table

    def cell(freq: str, target: str) -> DataFrame:
        table = tables_of[freq]
        chosen = forecast.all_features(table) if budget.log_target else forecast.short_features(table)
        result, model = forecast.hold_out_forecast(table, target, chosen, cut, budget)
        if out:
            name = f"{budget.name}_{target}_{freq}"
            tables.write_csv(result, f"{out}/forecasts/{name}")
            tables.save_model(model, f"{out}/models/{name}")
        return written(forecast.metric_row(result, target, freq, budget), "metrics")

    lines = []
    cells = {f"{freq}-{target}": partial(cell, freq, target) for freq in tables_of for target in targets}
    for name, line in side_by_side(cells).items():
        if isinstance(line, Exception):
            log.warning("no forecast for %s: %s", name, line)
        else:
            lines.append(line)
    if not lines:
        raise RuntimeError("no forecast could be made")
    report = combine.metric_report(lines)
    if out:
        tables.write_csv(report, f"{out}/report")
    return report
