"""Multi-index search, HTML extraction, toxicity, quality, components."""

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from stockweave.llm import multi_index, quality, toxicity  # noqa: E402
from stockweave.llm.components import components  # noqa: E402
from stockweave.llm.html_extract import extract, main_text  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, cell int, rank string"


def vectors(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist(), 0, "r") for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, 0, "r") for i in range(60)] + rows[:3]
    bad = [None, [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] + [0.0] * (dim - 1), [float("inf")] * dim, [1.0]]
    return rows, [(10_000 + 100 * i, v, 0, "r") for i, v in enumerate(bad)] + [(None, hot, 0, "r")]


def nearest(rows, query, k=10):
    of = dict((r[0], np.array(r[1])) for r in rows)
    d = {i: float(np.sqrt(((v - of[query]) ** 2).sum())) for i, v in of.items() if i != query}
    return sorted(d, key=lambda i: (d[i], i))[:k], d


def test_search_is_exact_when_all_cells_are_visited(spark):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, VECTORS)
    got = multi_index.search(df, df.filter("vec_id % 100 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {0, 100, 200, 300, 400}
    for q, found in by.items():
        want, d = nearest(rows, q)
        assert [i for i, _ in found] == want
        assert all(abs(s - d[i]) < 1e-12 for i, s in found)


def test_search_recall_with_part_of_the_cells(spark):
    rows, _ = vectors(5, 3000, 8)
    df = spark.createDataFrame(rows, VECTORS)
    got = multi_index.search(df, df.filter("vec_id % 100 = 0"), enough=600, share=0.1).collect()
    hits = sum(r["vec_id"] in nearest(rows, r["query_id"])[0] for r in got)
    assert hits >= 0.9 * len(got) and len(got) == 31 * 10


@pytest.mark.parametrize("copies", [2, 5])
def test_search_looks_at_its_share_when_vectors_have_copies(spark, copies):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16))
    rows = [(i + 2000 * c, v.tolist(), 0, "r") for i, v in enumerate(x) for c in range(copies)]
    df = spark.createDataFrame(rows, VECTORS)
    once = multi_index.search(df.filter("vec_id < 2000"), df.filter("vec_id < 2000 and vec_id % 50 = 0"), k=20, enough=1, share=0.3)
    got = multi_index.search(df, df.filter("vec_id < 2000 and vec_id % 50 = 0"), k=20, enough=1, share=0.3)

    def recall(found, n):
        hits = 0
        for r in found.collect():
            d = np.sqrt(((x - x[r["query_id"]]) ** 2).sum(axis=1))
            others = np.sort(np.r_[np.repeat(d, n)])[1:21]  # without the query itself
            hits += r["score"] <= others[-1] + 1e-9
        return hits / (40 * 20)

    assert recall(got, copies) >= recall(once, 1) - 0.01


def test_walk_visits_cells_by_rising_sum():
    rng = np.random.default_rng(1)
    left, right = rng.random(7), rng.random(5)
    cells = multi_index.walk(left, right, np.ones(35, np.int64), 35)
    sums = left[cells // 5] + right[cells % 5]
    assert sorted(cells.tolist()) == list(range(35)) and (np.diff(sums) >= 0).all()


def test_search_without_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert multi_index.search(df, df).collect() == []
    few = spark.createDataFrame([(100, [1.0, 2.0], 0, ""), (1, [3.0, 1.0], 0, "")], VECTORS)
    assert [r["vec_id"] for r in multi_index.search(few, few.filter("vec_id = 100")).collect()] == [1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy now, the best of all that there is for you and for me and for them.</div>
<article><h1>A title</h1><p>First part of the&nbsp;text &amp; more<br>goes on, with <b>bo</b>ld.<p>caf&eacute; &#x263A; &lt;tag&gt;</p>
<aside>Aside</aside><form><p>Mail</p><input value="x"></form><p class="advert">Ad</p><div hidden>secret</div>
<div class="comments"><p>A reader says a lot about the text and that it is good for all of us to read it.</p></div></article>
<div id="sidebar">Side</div><footer>Foot</footer></body></html>"""


def test_html_main_text():
    assert main_text(PAGE) == "A title First part of the text & more goes on, with bold. café ☺ <tag>"
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert main_text("<article><p>Cut &am") == "Cut &am"
    assert main_text('<article><p>x <a href="unclosed>y</p>').startswith("x")
    assert len(main_text("<article>" + "<div>" * 5000 + "deep")) == 4


def test_html_short_blocks_take_the_label_of_their_neighbours():
    long = "This is the text of the story and it is long and it has a lot of the words that are in it. " * 3
    page = f"<div><h2>Head</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=1>Home</a> <a href=2>More</a><p>All rights.</p></div>"
    assert main_text(page) == " ".join(["Head", long.strip(), "Short one.", long.strip()])


FINNISH = "Kaupunginvaltuusto päätti maanantaina uuden kirjaston rakentamisesta keskustaan, vaikka osa valtuutetuista vastusti hanketta. "
DENSE = "Parliament approved new library construction downtown on Monday, though several councillors opposed spending plans. "


def test_html_text_in_a_div_beside_a_teaser_article():
    good = "This is the text of the story and it is long and it has a lot of the words that are in it. " * 3
    for text in (good.strip(), (FINNISH * 2).strip(), (DENSE * 2).strip(), DENSE.strip()):
        page = f"<nav><a href=1>Home</a></nav><article><h2><a href=2>Teaser</a></h2></article><div><p>{text}</p><p>{text}</p></div><footer>F</footer>"
        assert main_text(page).count(text) == 2, text
    page = f"<article><p>{good}</p><p>{good}</p></article><div>Registered office: Examplestreet 5, 12345 Exampletown, company number 998877, tax 1234567.</div>"
    assert main_text(page) == f"{good.strip()} {good.strip()}"


def test_html_long_blocks_with_few_stop_words():
    for text in (FINNISH.strip(), (FINNISH * 2).strip(), DENSE.strip(), (DENSE * 2).strip()):
        page = f"<nav><a href=1>Home</a></nav><div><h1>Head</h1><p>{text}</p><p>{text}</p></div><footer>All rights reserved</footer>"
        assert main_text(page).count(text) == 2, text
        assert main_text(f"<article><p><a href=1>x y z</a></p><p>{text}</p></article>").endswith(text)
    good = "This is the text of the story and it is long and it has a lot of the words that are in it. " * 3
    assert DENSE.strip() in main_text(f"<div><p>{good}</p><p>{DENSE}</p><p>{good}</p></div>")
    links = "<p>" + "".join(f"<a href={i}>A link to some other page</a> " for i in range(9)) + "</p>"
    assert "link" not in main_text(f"<div>{links}<p>{good}</p>{links}</div>")


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(got.collect(), key=lambda r: r["page_id"])
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and rows[2]["text"] == "" and rows[0] == rows[1]
    assert extract(df.limit(0)).count() == 0


def toxic_rows(seed=1, n=600):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    insults = ["grumbold", "snarkfest", "blisterpod"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "er", "ing", ","]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_rows()
    more = [(None, "grumbold snarkfest"), (5000, None), (5001, ""), (1, docs[1][1])]
    got = toxicity.score_toxicity(
        fx.frame(spark, docs + more), spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    ).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs) + len(more)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["evidence"] for r in held if r["predicted"])
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (5000, 5001))


def test_toxicity_without_labels(spark):
    docs, _ = toxic_rows(n=10)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(fx.frame(spark, docs), none).collect()} == {0.5}
    assert toxicity.score_toxicity(fx.frame(spark, []), none).count() == 0


def test_block_max_search_equals_brute_force():
    docs, labels = toxic_rows(3, 500)
    texts, label = [t.encode() for _, t in docs], np.array([t for _, _, t in labels], float)
    ix = toxicity.build_index(texts, label, np.unique(toxicity.terms_of(texts)[1])[::3])
    doc, term, count = toxicity.terms_of(texts, ix.terms)
    term = term.astype(np.int64)
    weight = toxicity.unit_rows(doc, term, count, ix.idf, len(texts))
    dense = np.zeros((len(texts), len(ix.terms)))
    dense[doc, term] = weight
    for d in range(0, 500, 17):
        ids, cos = toxicity.nearest(ix, term[doc == d], weight[doc == d], 10, d)
        all_cos = dense @ dense[d]
        all_cos[d] = 0
        assert np.allclose(cos, np.sort(all_cos)[::-1][: len(cos)])
        assert np.allclose(all_cos[ids], cos) and len(ids) == min(10, (all_cos > 0).sum())


def junk_rows(seed=1, n=400):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "to", "in"] * 8 + ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, good = [], {}
    for i in range(n):
        w = [rng.choice(vocab) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(10, 90))]
        kind = i % 12
        if kind == 0:
            w = [x if x.endswith(".") else x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x if x.endswith(".") else x + rng.choice(["***", "%%%"]) for x in w]
        elif kind == 2:
            w = [w[0]] * len(w)
        elif kind == 3:
            w = " | ".join(w).split(" ")
        rows.append((i, " ".join(w)))
        good[i] = kind > 3
    return rows, good


def test_quality_finds_junk_without_labels(spark):
    rows, good = junk_rows()
    df = fx.frame(spark, rows + [(9000, None), (9001, ""), (9002, "\n"), (0, rows[0][1])])
    got = quality.score_quality(df)
    assert got.columns == [*df.columns, "quality", "good"]
    out = {r["doc_id"]: r["good"] for r in got.collect()}
    assert sum(out[i] == g for i, g in good.items()) >= 0.97 * len(good)
    assert not any(out[i] for i in (9000, 9001, 9002)) and got.count() == len(rows) + 4
    assert quality.score_quality(df.limit(0)).count() == 0


def test_quality_of_rare_junk_and_of_columns_with_its_names(spark):
    rng = random.Random(5)
    words = "the river and a small house in the old town was seen by many people who had come to look at it".split()
    rows = [(i, " ".join(f"{rng.choice(words)}{'.' if k % 9 == 8 else ''}" for k in range(60)), i, "x") for i in range(3000)]
    for i in (500, 1500, 2500):  # one in a thousand
        rows[i] = (i, " ".join("|#$%"[rng.randrange(4)] * rng.randint(1, 4) for _ in range(60)), i, "x")
    df = spark.createDataFrame(rows, "doc_id long, text string, Quality long, GOOD string")
    got = quality.score_quality(df)
    assert got.columns == ["doc_id", "text", "quality", "good"]
    assert sorted(r["doc_id"] for r in got.filter("not good").collect()) == [500, 1500, 2500]


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 90)
    edges = [(a, b) for a, b in zip(ids[:40], ids[1:40])] + [(ids[50], b) for b in ids[51:70]] + [(ids[80], ids[80])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(ids[:40]) for i in ids[:40]} | {i: min(ids[50:70]) for i in ids[50:70]}


@pytest.mark.parametrize("window", [1, 4])
def test_best_fit(window):
    from stockweave.llm.packing import FreeSpace

    f = FreeSpace(window)
    for w, free in enumerate(range(1, window + 1)):
        f.put(w, free)
    assert f.take(1) == (0, 1) and f.take(window) == ((window - 1, window) if window > 1 else None)


def test_toxicity_terms_looked_up_once_equal_terms_of_each_text():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts = [" ".join(rng.choice(words).title() for _ in range(rng.choice([0, 1, 5, 300]))).encode() for _ in range(80)]
    doc, h, count = toxicity.terms_of(texts)
    known = np.unique(h)[::2]
    at = toxicity.places(known, h)
    got = toxicity.places_of(texts, known)
    assert [x.tolist() for x in got] == [x[at >= 0].tolist() for x in (doc, at, count)]
    assert all(len(x) == 0 for x in toxicity.places_of(texts, known[:0]))
    big = np.array([5, 1 << 60, 5])  # keys too wide to be packed
    assert [x.tolist() for x in toxicity.runs(big, np.array([1, 2, 3]))] == [[5, 1 << 60], [4, 2]]


def test_toxicity_index_in_many_buckets_is_the_index_in_one(spark, monkeypatch):
    docs, labels = toxic_rows(4, 200)
    docs += [(20_000, None), (20_001, ""), (20_002, "word " * 3000)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = {r["doc_id"]: r for r in toxicity.score_toxicity(fx.frame(spark, docs), labels).collect()}
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(toxicity, "OWN_ROWS", 20)
    split = {r["doc_id"]: r for r in toxicity.score_toxicity(fx.frame(spark, docs), labels).collect()}
    assert whole.keys() == split.keys() == {d for d, _ in docs}
    assert all(abs(whole[i]["score"] - split[i]["score"]) < 1e-6 for i in whole)
    few = toxicity.score_toxicity(fx.frame(spark, docs), labels, example_bytes=1).collect()
    assert len({r["score"] for r in few}) <= 2  # one example


def test_toxicity_of_terms_in_few_examples(spark):
    """Toxic wording that only two examples have, and every clean text shares words with examples."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    docs, labels = toxic_rows(2, 300)
    fit = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1][:3]
    docs += [(i, " ".join([rng.choice(vocab), "zwarblet quoxinder murgatroy", rng.choice(vocab)])) for i in fit + held]
    docs += [(2000, " ".join(docs[1][1].split()[:4]))]
    got = toxicity.score_toxicity(
        fx.frame(spark, docs), spark.createDataFrame(labels + [(i, 1, 1) for i in fit], "doc_id long, quality int, toxic int")
    )
    by = {r["doc_id"]: r for r in got.collect()}
    for i in held:
        assert {e["example"] for e in by[i]["evidence"][:2]} == set(fit) and by[i]["predicted"] == 1
    assert by[2000]["evidence"] and by[2000]["predicted"] == 0


def test_toxicity_examples_are_labels_of_the_documents(spark):
    docs, labels = toxic_rows(6, 300)
    other = [(i, 1, 0) for i in range(10_000, 13_000)]
    schema = "doc_id long, quality int, toxic int"
    a = toxicity.score_toxicity(fx.frame(spark, docs), spark.createDataFrame(labels + other, schema), examples=100).collect()
    b = toxicity.score_toxicity(fx.frame(spark, docs), spark.createDataFrame(labels, schema), examples=100).collect()
    score = {r["doc_id"]: r["score"] for r in b}
    assert {r["doc_id"]: r["score"] for r in a} == pytest.approx(score)
    assert sum(r["predicted"] for r in a) > 0


def test_toxicity_postings_are_added_up_in_pieces_of_bounded_memory(monkeypatch):
    docs, labels = toxic_rows(7, 300)
    texts, label = [t.encode() for _, t in docs] + [b""], np.array([t for _, _, t in labels] + [0], float)
    ix = toxicity.build_index(texts, label, np.unique(toxicity.terms_of(texts)[1]))
    doc, term, count = toxicity.known_terms(texts, ix.terms)
    weight = (1 + np.log(count)) * ix.idf[term]
    both = np.zeros((len(texts), len(ix.terms)))
    both[ix.example, np.repeat(np.arange(len(ix.terms)), ix.df)] = ix.weight
    query = np.zeros_like(both)
    query[doc, term] = weight
    want = query @ both.T
    taken = []
    take = np.take
    monkeypatch.setattr(toxicity.np, "take", lambda x, at, **how: taken.append(len(at)) or take(x, at, **how))
    for piece in (1, 1000, toxicity.PIECE):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        taken.clear()
        assert np.allclose(toxicity.added(ix, doc, term, weight, len(texts), len(texts)), want, rtol=1e-5)
        assert max(taken) <= max(piece, ix.df.max()) and sum(taken) == ix.df[term].sum()
    none = np.zeros(0, np.int64)
    assert not toxicity.added(ix, none, none, none, 2, len(texts)).any()


def test_toxicity_hashes_of_all_spans_from_one_running_sum():
    from stockweave.llm.phrase_dedup import spans_hash

    texts = [b"Some words and MORE words, longerwordsthanusual", b"", "ünïcode wörds".encode()]
    doc, start, end, x = toxicity.words_of(texts)
    folded = toxicity.FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
    assert len(start) == 8 and x.hash(start, end).tolist() == spans_hash(folded, start, end).tolist()
    for n, (long, h) in zip(toxicity.BEGINNINGS, toxicity.beginnings(x, start, end), strict=True):
        assert h.tolist() == (spans_hash(folded, start[long], start[long] + n) ^ np.uint64(n)).tolist()


def test_toxicity_blocks_hold_similar_examples_and_only_their_columns(monkeypatch):
    rng = random.Random(9)
    vocab = [["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)] for letters in ("abcdefgh", "ijklmnop")]
    texts = [" ".join(rng.choice(vocab[i % 2]) for _ in range(30)).encode() for i in range(64)] + [b""]
    label = np.array([i % 4 == 0 for i in range(64)] + [0], float)
    ix = toxicity.build_index(texts, label, np.unique(toxicity.terms_of(texts)[1]))
    doc, term, count = toxicity.known_terms(texts, ix.terms)
    weight = toxicity.unit_rows(doc, term, count, ix.idf, len(texts))
    whole = np.zeros((len(texts), len(ix.terms)))
    whole[doc, term] = weight
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "FIRST", 16)
    for common in (0, 30, 1000):  # no columns, some and all
        monkeypatch.setattr(toxicity, "COMMON", common)
        ix.dense = None
        column, order, blocks, most = toxicity.common_terms(ix)
        assert sorted(order.tolist()) == list(range(80)) and most.shape == (min(common, len(ix.terms)), 5)
        if common == 1000:
            assert all(len({i % 2 for i in block if i < 64}) < 2 for block in order.reshape(-1, 16).tolist())
            assert sum(len(columns) for columns, _ in blocks) < 0.6 * 5 * len(ix.terms)
        skip = np.where(np.arange(len(texts)) % 3 == 0, np.arange(len(texts)), -1)
        for d, (ids, cos) in enumerate(toxicity.nearest_of(ix, doc, term, weight, len(texts), 5, skip)):
            want = whole @ whole[d]
            want[skip[d] if skip[d] >= 0 else []] = 0
            assert len(ids) == min(5, (want > 0).sum())
            assert np.allclose(cos, np.sort(want)[::-1][: len(cos)], atol=1e-5) and np.allclose(want[ids], cos, atol=1e-5)


def test_toxicity_of_examples_without_a_term(spark):
    docs, labels = toxic_rows(5, 120)
    bare = [(1000 + i, [None, "", "12 34"][i % 3]) for i in range(12)]
    schema = "doc_id long, quality int, toxic int"
    every = spark.createDataFrame(labels + [(i, 1, 0) for i, _ in bare], schema)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(fx.frame(spark, docs + bare), every).collect()}
    assert len(got) == 132 and len({got[i]["score"] for i, _ in bare}) == 1 and got[1000]["predicted"] == 0
    assert sum(got[i]["predicted"] == t for i, _, t in labels) > 100
    only = toxicity.score_toxicity(fx.frame(spark, docs + bare), spark.createDataFrame([(i, 1, 0) for i, _ in bare], schema))
    assert only.filter("predicted = 0").count() == 132
