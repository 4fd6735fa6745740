"""Mixing: targets by repeated resharing, exact permutations, spans against the texts."""

import os
import re
import sys
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from stockweave.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string, no int, size string, x string, target int"


def resharing(sizes, weights, total, most=2):
    """Targets as the rule is worded: cut at the cap, hand the excess on, until none is above."""
    got, free = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while left and free:
        weight = sum(weights[i] for i in free)
        for i in list(free):
            got[i] += left * weights[i] / weight
        left = Fraction(0)
        for i in list(free):
            if got[i] >= most * sizes[i]:
                left += got[i] - most * sizes[i]
                got[i] = Fraction(most * sizes[i])
                free.discard(i)
    return got


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 5, 300, 0, 20], [7], [0, 0], [0, 3], list(range(1, 60)), [100] * 7 + [10**9]])
def test_targets(sizes):
    weights = [Fraction([3, 1, 2][i % 3]) for i in range(len(sizes))]
    total = Fraction(3, 2) * sum(sizes)
    assert mixing.targets(sizes, weights, total, Fraction(2)) == resharing(sizes, weights, total)


@pytest.mark.parametrize("b", [1, 2, 3, 17, 1000, 65_537])
def test_permutation_is_one_to_one(spark, b):
    df = spark.range(b).selectExpr("id AS x", f"CAST({b} AS BIGINT) AS b", "CAST(2 AS BIGINT) AS no", "CAST(1 AS BIGINT) AS epoch")
    got = [r["x"] for r in mixing.permuted(df, 5).collect()]
    assert sorted(got) == list(range(b))
    if b >= 1000:  # neighbours are torn apart
        assert sum(abs(x - y) == 1 for x, y in zip(got, got[1:])) < 20 + b / 500


def rows_of():
    rows = [(i, t, "abc"[i % 3] + "ä" * (i % 2)) for i, t in fx.corpus(3, 150)]
    rows += [(i, "same words here " * 40, None) for i in range(5000, 5040)]
    return rows + rows[:4] + [rows[0]] * 6 + [(None, "no id at all", "a"), (9000, None, "empty"), (9001, " \t ", "empty"), (9002, "x" * 9, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "s", "x", 2) for i, t, s in rows], SCHEMA)


def test_documents_and_spans(spark):
    rows = rows_of()
    documents, spans = mixing.mix(frame(spark, rows), block_words=16, shard_slots=64)
    docs, spans = documents.collect(), spans.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((d["id"], d["source"], d["size"]) for d in docs) == Counter((i, s, size(t)) for i, t, s in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == name) for name in names]
    want = resharing(sizes, [Fraction([3, 1, 2][i % 3]) for i in range(len(names))], Fraction(3, 2) * sum(sizes))
    of = {(d["no"], d["start"]): d for d in docs if d["size"]}
    assert len(of) == sum(d["size"] > 0 for d in docs)
    for d in docs:
        k = names.index(d["source"])
        assert (d["no"], d["source_size"], d["target"]) == (k, sizes[k], float(want[k]))
    took, by_source, by_slot = Counter(), Counter(), Counter()
    for s in spans:
        d = of[s["no"], s["start"]]
        assert d["id"] == s["id"] and 0 <= s["from"] and s["length"] > 0 and s["from"] + s["length"] <= d["size"]
        took[s["no"], s["start"]] += s["length"]
        by_source[s["no"]] += s["length"]
        by_slot[s["shard"], s["slot"]] += s["length"]
    assert all(n <= 2 * of[k]["size"] for k, n in took.items())
    assert all(abs(by_source[k] - want[k]) <= 32 for k in range(len(names)))
    assert max(by_slot.values()) == 16 and len({s for s, _ in by_slot}) > 3
    for shard in {s for s, _ in by_slot}:
        held = sorted(i for s, i in by_slot if s == shard)
        assert held == list(range(len(held)))


def test_shards_draw_like_a_multinomial(spark):
    sources = [mixing.Source(c, 0, Fraction(0), b, q) for c, b, q in (("a", 30_000, 50_000), ("b", 9_000, 10_000), ("c", 20_000, 40_000))]
    got = mixing.slots(spark, sources, 1000, 3).groupBy("shard", "no").count().collect()
    total = Counter()
    for r in got:
        total[r["no"]] += r["count"]
    assert dict(total) == {0: 50_000, 1: 10_000, 2: 40_000}
    spread = [r["count"] - sources[r["no"]].quota / 100 for r in got if r["no"] == 0]
    variance = sum(x * x for x in spread) / len(spread)
    assert 120 < variance < 500  # 1000 x 0.5 x 0.5 = 250
    assert all(r["epoch"] < 2 for r in mixing.slots(spark, sources, 1000, 3).select("epoch").distinct().collect())


def test_reruns_agree_and_match_the_statement(spark, tmp_path):
    df = frame(spark, [r for r in rows_of() if r[0] is not None]).repartition(3)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = [Counter(map(tuple, mixing.taken(d, block_words=16, shard_slots=64).select(columns).collect())) for d in (df, df.repartition(7))]
    assert got[0] == got[1]
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.statement(16, 64)})").fetchall()
    assert got[0] == Counter(want)


def test_no_words_and_no_rows(spark):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        got = mixing.taken(frame(spark, rows)).collect()
        assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * len(rows)


def test_too_many_sources(spark):
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, [(i, "a", str(i)) for i in range(5)]), max_sources=4)
