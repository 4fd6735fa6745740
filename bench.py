"""Time the headline queries on the benchmark tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from stockweave.operators import baselines as bl  # noqa: E402
from stockweave.operators import boosting as bo  # noqa: E402
from stockweave.operators import churn as ch  # noqa: E402
from stockweave.operators import evaluate as ev  # noqa: E402
from stockweave.operators import feature_store as fs  # noqa: E402
from stockweave.operators import features as ft  # noqa: E402
from stockweave.operators import hierarchy as hi  # noqa: E402
from stockweave.operators import inventory as iv  # noqa: E402
from stockweave.operators import models as md  # noqa: E402
from stockweave.operators import quality as ql  # noqa: E402
from stockweave.operators import recursion as rc  # noqa: E402
from stockweave.operators.reshape import densify, pivot_categories, silver, with_calendar  # noqa: E402
from stockweave.plans.planning_queries import MEASURES  # noqa: E402
from stockweave.schema import CATEGORY, CHANNEL_INV, QTY, SELL_IN, SKU, WEEK  # noqa: E402
from stockweave.session import build_session  # noqa: E402
from stockweave.sources import tables as tb  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


WARM = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.001")


def run(df) -> None:
    """Force the whole result without keeping it."""
    df.write.format("noop").mode("overwrite").save()


def risk(spark, sf):
    weekly = tb.long_table(spark, sf, "fine").filter(F.col(WEEK) <= tb.CUTOFF_WEEK)
    fc = bl.naive_forecast(tb.sell_in(spark, sf, "fine"), tb.FIRST_WEEK, tb.CUTOFF_WEEK, 13)
    return iv.report_order(iv.risk_table(weekly, fc, demand="forecast_naive", horizon=13))


def two_stage(spark, sf):
    base = md.stored(md.base_frame(tb.dense_table(spark, sf, "coarse")))
    frame = md.stored(md.model_frame(base, tb.CUTOFF_WEEK))
    fitted = md.fit_two_stage(md.with_roles(frame, tb.CUTOFF_WEEK))
    return md.score(frame.filter(F.col(WEEK) > tb.CUTOFF_WEEK), fitted).drop("features")


def recursion(spark, sf):
    base = md.stored(md.base_frame(tb.dense_table(spark, sf, "coarse")))
    rows = md.with_roles(md.stored(md.model_frame(base, tb.CUTOFF_WEEK)), tb.CUTOFF_WEEK)
    model = rc.FlatOneStage(bo.flatten(md.one_stage(rows)))
    long = tb.long_table(spark, sf, "coarse").filter(F.col(WEEK) <= tb.CUTOFF_WEEK)
    stats = ft.channel_stats(ft.with_rolling(tb.dense_table(spark, sf, "coarse", SELL_IN, tb.CUTOFF_WEEK)))
    sold, inv = (long.filter(F.col(CATEGORY) == c) for c in (SELL_IN, CHANNEL_INV))
    return rc.recursive_forecast(md.start_state(sold, stats, tb.CUTOFF_WEEK, inv), tb.CUTOFF_WEEK, 71, model)


HEADLINE = {
    "silver_table": lambda s, d: silver(tb.signed_observations(s, d).drop("l_linenumber")),
    "densify": lambda s, d: tb.dense_table(s, d, "fine"),
    "gold_features": lambda s, d: ft.gold(tb.dense_table(s, d, "fine")),
    "all_baselines": lambda s, d: bl.run_models(tb.sell_in(s, d, "fine"), tb.FIRST_WEEK, tb.CUTOFF_WEEK, 13),
    "forward_forecast_71_weeks": lambda s, d: bl.naive_forecast(
        tb.sell_in(s, d, "fine"), tb.FIRST_WEEK, tb.LAST_SALES_WEEK, 71
    ),
    "walk_forward_5x5": lambda s, d: ev.walk_forward(tb.sell_in(s, d, "fine"), tb.FIRST_WEEK, tb.FOLDS),
    "inventory_risk": risk,
    "customer_churn": lambda s, d: ch.churn_table(tb.long_table(s, d, "customer"), tb.REFERENCE_WEEK),
    "quality_checks": lambda s, d: ql.run_all(
        with_calendar(tb.signed_observations(s, d)), tb.YEAR_RANGE
    ),
    "outliers": lambda s, d: ql.outliers(tb.long_table(s, d), 2.5),
    "feature_store": lambda s, d: fs.feature_store(
        densify(pivot_categories(tb.long_table(s, d, "fine")), SKU, tb.FIRST_WEEK, tb.LAST_WEEK, MEASURES)
    ),
    "two_stage_training": two_stage,
    "learned_recursion_71_weeks": recursion,  # with the fit
    "hierarchy_sums": lambda s, d: hi.hierarchy_sums(tb.sell_in(s, d, "fine"), QTY),
}


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM):  # session start and class loading are not timed
        for make in HEADLINE.values():
            run(make(spark, WARM))
    times = {}
    for name, make in HEADLINE.items():
        spark.catalog.clearCache()
        start = time.perf_counter()
        run(make(spark, SF))
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
