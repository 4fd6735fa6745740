"""Token alignment against a plain version that marks every byte."""

import hashlib
import os
import sys
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from stockweave.llm import token_alignment as ta  # noqa: E402

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, id string, row int, links string, groups int"
ODD = [
    None, "", " ", "\n", "a", "a  b   c\t\td\n\n e ", "naïve Ünïcode 東京 مرحبا 👩‍👩‍👧 x", "<|endoftext|> and <s> </s> <unk>",
    "▁marked▁text", "x" * 900, "東京都" * 200, " no-break em", "<0x41> byte", "é ﬁ ½ ｆｕｌｌ", "0123456789 " * 30, "\x00\x01 \x7f",
]


def plain(rows):
    """Digest columns by comparing all ends, and counting links in a dictionary."""
    a_tok = Tokenizer.from_file(FIRST)
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(c): c for c in own}
    of.update({chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)})
    a_bytes = lambda i: bytes(of[c] for c in a_tok.id_to_token(i))

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()

    found = []
    for name, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            found.append((name, 0, 0, [], ""))
            continue
        ends = []
        for ids, spell in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(spell(i))
                out[at] = k
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links, groups, i, j = [], [], 0, 0
        for e in shared:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        found.append((name, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return Counter(
        (n, na, nb, len(l), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), h) for n, na, nb, l, h in found
    )


def rows_of():
    rows = fx.corpus(4, 80)
    rows = [(i, t if i != 5 else "long words and more " * 3000 + (t or "")) for i, t in rows]
    return rows + [(2000 + k, t) for k, t in enumerate(ODD)] + rows[:3] + [(None, rows[0][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "l", 0) for i, t in rows_of()], SCHEMA).repartition(4)


@pytest.mark.parametrize("ranks,small", [(RANKS, ta.PAIRS), (RANKS, 10), (None, ta.PAIRS)])
def test_matches_the_plain_version(spark, docs, ranks, small):
    got = ta.aligned_documents(docs, FIRST, SECOND, ranks, broadcast_pairs=small).collect()
    assert Counter(map(tuple, got)) == plain(rows_of())


def test_groups_hold_all_ids_and_end_together(spark, docs):
    of = ta.Tokenizers(FIRST, None, SECOND)
    texts = {i: t for i, t in rows_of()}
    some = 0
    for r in ta.align(docs, FIRST, SECOND, RANKS).collect():
        if not r["n_a"]:
            assert r["groups"] == "" and not r["links"]
            continue
        a, b = of.ids(texts[r["doc_id"]])
        groups = [[list(map(int, s.split(","))) for s in g.split("|")] for g in r["groups"].split(";")]
        assert [i for x, _ in groups for i in x] == a and [i for _, y in groups for i in y] == b
        for x, y in groups:
            assert b"".join(of.first.tokens[i] for i in x) == b"".join(of.second.tokens[i] for i in y)
        assert Counter(x[-1] << 32 | y[-1] for x, y in groups) == dict(zip(r["links"], r["times"]))
        some += len(groups)
    assert some > 10_000


def test_kept_windows_are_bounded_and_change_nothing(monkeypatch):
    of = ta.Tokenizers(FIRST, RANKS, SECOND)
    pairs = [p for _, t in rows_of() if t and (p := of.ids(t))]
    want = [ta.Aligner(of).align(*p)[0] for p in pairs]
    monkeypatch.setattr(ta, "KEPT", 7)
    few = ta.Aligner(of)
    assert [few.align(*p)[0] for p in pairs] == want and len(few.kept) == 7


def test_empty_table(spark):
    got = ta.aligned_documents(spark.createDataFrame([], SCHEMA), FIRST, SECOND, RANKS)
    assert got.count() == 0 and got.columns[0] == "doc_id"


def test_documents_together_are_each_alignment_alone():
    """Several documents share one pass; one whose bytes differ leaves the others alone and no window behind."""
    of = ta.Tokenizers(FIRST, RANKS, SECOND)
    texts = [t for _, t in rows_of() if t]
    docs = [(*of.encoded(t), (" " + t).encode()) for t in texts]
    want = [ta.Aligner(of).align_all([d])[0] for d in docs]
    together = ta.Aligner(of)
    for got in (together.align_all(docs), together.align_all(docs)):  # nothing kept, then much of it
        assert [g and (g[0], g[1].tolist()) for g in got] == [w and (w[0], w[1].tolist()) for w in want]
    assert [g is None for g in want] == [of.ids(t) is None for t in texts] and None in want
    a, b, raw = docs[0]
    other = next(i for i, t in enumerate(of.second.tokens) if len(t) == of.second.length[b[-1]] and t != of.second.tokens[b[-1]])
    wrong = [(a, b[:-1] + [other], raw), (a, b, raw[:-1] + b"\0"), (a, b + b[-1:], raw)]
    assert [g is None for g in together.align_all([*wrong, docs[0]])] == [True, True, True, False]
    assert all(of.first.spelled(x) == of.second.spelled(y) == kept[2] for key, kept in together.kept.items() for x, y in [sides(of, key)])


def sides(of, key):
    """Ids of both sides from the key of a kept window."""
    ids, n = memoryview(key).cast("i").tolist(), len(of.first.tokens)
    return [i for i in ids if i < n], [i - n for i in ids if i >= n]
