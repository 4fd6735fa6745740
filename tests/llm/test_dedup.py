"""Phrase dedup, suffix dedup and the n-gram join against plain versions."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from stockweave.llm import ngram_join, phrase_dedup, seeds, suffix_dedup  # noqa: E402

ROWS = fx.corpus() + [(None, fx.corpus()[5][1]), (7, fx.corpus()[1][1]), (7, fx.corpus()[1][1]), (None, None)]


@pytest.fixture(params=[(8 << 20, 1000), (900, 3)], ids=["one group", "many groups, hot keys"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(seeds, "GROUP_BYTES", request.param[0])
    monkeypatch.setattr(seeds, "HOT", request.param[1])
    monkeypatch.setattr(seeds, "CHUNK_BYTES", request.param[0] // 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4096 if request.param[1] > 3 else 3)


def test_phrases(spark, sizes):
    got = phrase_dedup.remove_repeats(fx.frame(spark, ROWS), window=20).collect()
    want = Counter((i, *x) for (i, _), x in zip(ROWS, fx.passages_removed(ROWS, 20)))
    assert Counter((r["id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 300
    for r in got:
        assert sum(r["span_length"]) == r["n_removed"]


def test_strings(spark, sizes):
    got = suffix_dedup.remove_repeats(fx.frame(spark, ROWS), window=50, carry=("shard",)).collect()
    want = Counter((i, *x) for (i, _), x in zip(ROWS, fx.strings_removed(ROWS, 50)))
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == want
    assert all(r["shard"] == "z" and r["kept_text"] == bytes(r["kept"]).decode(errors="ignore") for r in got)


def test_radix_groups_are_equal_strings():
    import numpy as np

    raw = np.frombuffer(b"abcdefgh12345678abcdefgh12345679abcdefgh12345678" + bytes(8), np.uint8)
    big = suffix_dedup.words64(raw, ">")
    alive, group = suffix_dedup.radix_groups([lambda p: big[p], lambda p: big[p + 8]], np.zeros(3, np.int64), np.array([0, 16, 32]))
    assert sorted(alive.tolist()) == [0, 2] and len(set(group.tolist())) == 1


def test_near_duplicates(spark, sizes):
    got = ngram_join.near_duplicates(fx.frame(spark, ROWS)).collect()
    want = [(i, *x) if x[0] else (i, 0, i) for (i, _), x in zip(ROWS, fx.classes(ROWS))]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_of_small_sets(spark, seed):
    import random

    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(w)] * rng.randint(0, 2)
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(fx.frame(spark, rows)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, fx.classes(rows))}


def test_one_of_each(spark):
    rows = fx.corpus(2, 40)
    kept = ngram_join.one_of_each(fx.frame(spark, rows + rows[:3]))
    assert kept.columns == fx.SCHEMA.fieldNames()
    want = {c for (i, _), (n, c) in zip(rows, fx.classes(rows)) if n} | {i for (i, _), (n, _) in zip(rows, fx.classes(rows)) if not n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_empty_tables(spark):
    none = fx.frame(spark, [])
    assert phrase_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    nulls = fx.frame(spark, [(None, None), (1, None)])
    assert {r["n_removed"] for r in phrase_dedup.remove_repeats(nulls).collect()} == {0}
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(nulls).collect()} == {(None, None), (1, 1)}


def test_suffix_dedup_makes_only_the_columns_asked_for(spark):
    df = fx.frame(spark, ROWS)
    want = sorted((r["kept_text"], r["shard"]) for r in suffix_dedup.remove_repeats(df, carry=("shard",)).collect())
    got = suffix_dedup.remove_repeats(df, carry=("shard",), columns=("kept_text",))
    assert got.columns == ["kept_text", "shard"] and sorted(map(tuple, got.collect())) == want
    assert suffix_dedup.remove_repeats(df, columns=("id", "kept")).columns == ["id", "kept"]
