"""Small weekly frames for tests."""

from stockweave.functions import weeks as wk

SCHEMA = "Channel string, `Material Description` string, Category string, year_week int, quantity double"


def weekly(spark, series, first=200001, category="Sell-in", keep_zero=True):
    """``{(channel, material): [q, ...]}`` to rows starting at ``first``."""
    rows = []
    for (c, m), ys in series.items():
        for i, y in enumerate(ys):
            if keep_zero or y:
                rows.append((c, m, category, wk.week_add(first, i), None if y is None else float(y)))
    return spark.createDataFrame(rows, SCHEMA)


def by_week(df, *cols):
    return [tuple(r[c] for c in cols) for r in sorted(df.collect(), key=lambda r: r["year_week"])]
