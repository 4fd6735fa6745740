"""Packing, sharding, decontamination and the pipeline."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from stockweave.llm import decontamination, sharding  # noqa: E402
from stockweave.llm.packing import Encoder, pack, pack_lengths  # noqa: E402

P = pytest.importorskip("public_tokenizers")
TOKENIZER, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ROWS = fx.corpus(6) + [(None, "no id"), (3, "twice"), (3, "twice"), (4, "special <|endoftext|> ’ 漢字 ﬁ")]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    got = pack(fx.frame(spark, ROWS), TOKENIZER, RANKS, shard_tokens=3000).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    want = Counter()
    for i, t in ROWS:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids)] += 1
        found = sorted(docs[i, len(ids)])
        k = found.count(found[0])
        assert b"".join(b for _, b in found[::k]) == np.array(ids, "<u4").tobytes()
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in want.items())


def test_fast_ids_equal_the_tokenizer_file():
    fast, exact = Encoder(TOKENIZER, RANKS), Encoder(TOKENIZER, None)
    for t in ["", " ", "a\n\n  b", "Ünïcode éç – ’s", "<|endoftext|>", "12 345,67", "x" * 3000, "\x00\x1f\x85   z", "漢字 مرحبا"]:
        assert fast.ids(t) == exact.ids(t)


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_full_but_for_one(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.pareto(1.2, 600) * 80 + 1, 9000).astype(int).tolist()
    windows = pack_lengths(lengths, 1024)
    got = defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 1024
        for d, start, n in w:
            got[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got[d]):
            assert start == at
            at += k
        assert at == n
    assert sum(sum(n for _, _, n in w) < 1024 - 1024 // 64 for w in windows) <= 1


def test_packing_nothing(spark):
    assert pack(fx.frame(spark, []), TOKENIZER, RANKS).count() == 0
    assert [r["length"] for r in pack(fx.frame(spark, [(1, None)]), TOKENIZER, RANKS).collect()] == [1]


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 500)
    rows = fx.corpus(8, 120)[:-2] + [(k, "hot text " * 3) for k in range(2000, 2040)] + [(None, None), (1, "r"), (1, "r")]
    df = fx.frame(spark, rows).withColumnRenamed("n", "SLOT")
    got = sharding.shard_by_bytes(df, shards).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= 2 * largest + 0.01 * total / shards
    if shards == 5:  # a text's copies share a shard where they fit
        of = defaultdict(set)
        for r in got:
            of[r["text"]].add(r["shard"])
        assert sum(len(s) > 1 for s in of.values()) <= 1


def test_shards_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 2000)
    df = fx.frame(spark, fx.corpus(6, 80))
    order = ["doc_id", "size", "shard", "slot"]
    want = sorted(map(str, sharding.shard_by_bytes(df, 3).select(order).collect()))
    monkeypatch.setattr(decontamination, "SMALL_ROWS", 0)
    got = sharding.shard_by_bytes(df, 3)
    assert sorted(map(str, got.select(order).collect())) == want


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(fx.frame(spark, []), 3).count() == 0


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.fold(text))


def contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = benchmark_words(t)
        if i is not None and w:
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for i, t in rows:
        w = benchmark_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [200_000, 0], ids=["broadcast", "shuffle"])
def test_decontamination(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "SMALL_ROWS", limit)
    source = [t for _, t in fx.corpus(6) if t and len(t.split()) > 40]
    cut = lambda k, a, b: ", ".join(source[k].split()[a:b])
    items = [(1, cut(0, 3, 30)), (2, cut(1, 0, 13)), (10, cut(2, 5, 18).upper()), (3, cut(3, 2, 9)), (4, cut(4, 1, 3)), (5, ""), (6, None),
             (None, cut(5, 0, 20)), (1, cut(6, 0, 25)), (7, "Zu lang ÉÈ"), (8, "aa " * 30), (9, cut(7, 0, 12))]
    rows = ROWS + [(900, "aa " * 50), (901, "aa " * 12), (902, "zu LANG ÉÈ!"), (903, "zu lang éè")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(fx.frame(spark, rows), bench).collect()
    have = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got)
    assert have == Counter(contamination(rows, items))
    assert sum(r["contaminated"] for r in got) > 5
    kept = decontamination.without_contaminated(fx.frame(spark, rows), bench)
    assert kept.columns == fx.SCHEMA.fieldNames()
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x[0] for x in contamination(rows, items) if not x[4])


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(fx.frame(spark, ROWS[:5]), none).collect()} == {0}
    assert decontamination.contamination(fx.frame(spark, []), none).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp
    from stockweave.llm.common import stored
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf), "stage"))
    raw, good, single, cut, clean, packed = [d.toPandas() for d in seen]
    assert all(list(d.columns) == list(raw.columns) for d in (good, single, cut, clean))
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    judged = raw[raw.doc_id.isin(labels.index)]
    kept = judged.doc_id.isin(good.doc_id)
    assert (kept == (judged.doc_id.map(labels) == 1)).mean() > 0.95
    rows = list(zip(good.doc_id, good.text))
    assert sorted(single.doc_id) == sorted({c if n else i for (i, _), (n, c) in zip(rows, fx.classes(rows))})
    rows = list(zip(single.doc_id, single.text))
    want = {i: k.decode(errors="ignore") for (i, _), (_, _, k) in zip(rows, fx.strings_removed(rows, 50))}
    assert dict(zip(cut.doc_id, cut.text)) == want and (cut.n_chars == cut.text.str.len()).all()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = list(zip(cut.doc_id, cut.text))
    assert sorted(clean.doc_id) == sorted(x[0] for x in contamination(rows, items) if not x[4])
    plain = Tokenizer.from_file(TOKENIZER)
    pieces = packed.sort_values(["doc_id", "start"]).groupby("doc_id").ids.agg(lambda x: b"".join(x))
    for i, t in list(zip(clean.doc_id, clean.text))[:50]:
        assert pieces[i] == np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_queries_give_the_columns_of_their_contract(spark, sf):
    from stockweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = list(zip(docs.doc_id, docs.text))
    got = {r["doc_id"]: r for r in QUERIES["op1_phrase_dedup"](spark, sf).collect()}
    for (i, _), (n, gone, kept) in zip(rows, fx.passages_removed(rows, 20)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: r for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()}
    for (i, _), (n, gone, kept) in zip(rows, fx.strings_removed(rows, 50)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: r for r in QUERIES["op9_sharding"](spark, sf).collect()}
    for i, t in rows:
        assert got[i]["text_crc32"] == zlib.crc32(t.encode()) and got[i]["law"] == "bytes" and got[i]["grown_shard"] is None
