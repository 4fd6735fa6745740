"""Recurring passages of words by sharded phrase automata.

Three passes over documents dealt into groups. Seeds tell which windows can
recur (:mod:`stockweave.llm.seeds`). Their pieces of text meet by key, which
confirms recurring passages and where each one starts first. Every group of
documents then compiles the confirmed passages it needs into one Aho-Corasick
automaton over words, and streams all its documents through it.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockweave.llm.common import mix64
from stockweave.llm.seeds import (
    LOW32, NO_ID, candidates, chunks, joined, recurring, seed_keys, sizes, spread, table_of, take_spans, without_copies,
)

GRAM = 8  # words in a seed
MUL, INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
BYTE = mix64(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)  # two numbers for each byte value


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, .. modulo 2^64."""
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


def spans_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the numbers ``x``, from one running polynomial."""
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(x * powers(MUL, len(x)), dtype=np.uint64)]
        return mix64((total[end] - total[start]) * powers(INV, len(x) + 1)[start])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and 09 to 0D."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    return spans_hash(BYTE[kind][raw], start, end)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place."""
    at = np.arange(max(0, len(words) - n + 1))
    return spans_hash(words, at, at + n)


def word_chunk(texts: list[bytes]) -> tuple:
    """Words of documents; ``raw`` is a pair of the bytes and the words' spans and hashes."""
    text = b" ".join(texts)
    raw = np.frombuffer(text, np.uint8)
    start, end = word_spans(raw)
    words = word_hash(raw, start, end)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    first = np.searchsorted(start, begin)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.r_[first, len(start)]))
    return (raw, start, end, words), doc, gram_hash(words, GRAM), first


PIECES = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32())]
    + [(c, pa.binary()) for c in ("key", "piece", "doc", "start", "many", "size", "length", "content")]
)
PASSAGES = pa.schema(
    [("part", pa.int32())] + [(c, pa.binary()) for c in ("doc", "start", "words", "length", "content")]
)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each row repeats the row before it."""
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


def confirm(t: pa.Table, window: int) -> pa.Table:
    """Recurring passages among the pieces of one bucket, for each group that needs them.

    A passage is a run of recurring windows whose first places run on in one
    document.
    """
    part = t.column("part").to_pylist()
    own = np.repeat(np.arange(len(part)), sizes(t.column("key"), 8))
    key, piece = joined(t.column("key"), np.uint64), joined(t.column("piece"), np.uint64)
    doc, start = joined(t.column("doc"), np.int64), joined(t.column("start"), np.int64)
    many, n = joined(t.column("many"), np.bool_), joined(t.column("size"), np.uint8).astype(np.int64)
    length = joined(t.column("length"), np.int32).astype(np.int64)
    raw = np.frombuffer(b"".join(t.column("content").to_pylist()), np.uint8)
    where = np.cumsum(length) - length
    # one copy of each distinct piece, at its first place
    order = np.lexsort((start, doc, key, piece))
    again = same_as_before(piece[order], key[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(~again) - 1
    pick = order[~again]
    seen = np.bincount(which) + np.bincount(which, weights=many)
    # words of the distinct pieces; every piece has n + window - 1 of them
    raw = take_spans(raw, where[pick], length[pick])
    n = n[pick]
    w_start, w_end = word_spans(raw)
    one, two = (gram_hash(word_hash(raw, w_start, w_end, kind), window) for kind in (0, 1))
    words = n + window - 1
    at = np.repeat(np.cumsum(words) - words, n) + spread(n)
    owner = np.repeat(np.arange(len(pick)), n)
    w_doc, w_from = doc[pick][owner], start[pick][owner] + spread(n)
    order = np.lexsort((w_from, w_doc, two[at], one[at]))
    again = same_as_before(one[at][order], two[at][order])
    group = np.cumsum(~again) - 1
    times = np.bincount(group, weights=seen[owner][order])
    first_doc, first_from, often = np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), bool)
    first_doc[order], first_from[order] = w_doc[order][~again][group], w_from[order][~again][group]
    often[order] = times[group] > 1
    # passages: runs of recurring windows with first places in a row
    offset = spread(n)
    run_on = same_as_before(owner, first_doc, first_from - offset, often)
    begin = np.flatnonzero(~run_on)
    size = np.diff(np.r_[begin, len(at)])
    size, begin = size[often[begin]], begin[often[begin]]
    p_owner, p_doc, p_from, p_off = owner[begin], first_doc[begin], first_from[begin], offset[begin]
    a, b = w_start[at[begin]], w_end[at[begin] + size + window - 2]
    # back to the groups, unless the only place there is the first one
    count = np.bincount(p_owner, minlength=len(pick))
    base = np.cumsum(count) - count
    rows_of = count[which]
    piece_row = np.repeat(np.arange(len(which)), rows_of)
    p = np.repeat(base[which], rows_of) + spread(rows_of)
    need = many[piece_row] | (doc[piece_row] != p_doc[p]) | (start[piece_row] + p_off[p] != p_from[p])
    piece_row, p = piece_row[need], p[need]
    cut = np.searchsorted(own[piece_row], np.arange(len(part) + 1))
    rows = []
    for i, name in enumerate(part):
        if cut[i] < cut[i + 1]:
            k = p[cut[i] : cut[i + 1]]
            rows.append(
                (name, p_doc[k].tobytes(), p_from[k].tobytes(), (size[k] + window - 1).astype(np.uint16).tobytes(),
                 (b[k] - a[k] + 1).astype(np.int32).tobytes(),
                 b" ".join([raw[x:y].tobytes() for x, y in zip(a[k].tolist(), b[k].tolist(), strict=True)]) + b" ")
            )
    return table_of(PASSAGES, rows)


def automaton(found: pa.Table) -> tuple[ahocorasick.Automaton | None, list[np.ndarray]]:
    """Automaton over 32-bit word numbers; values are places in arrays of words, hash, document and start."""
    n = joined(found.column("words"), np.uint16).astype(np.int64)
    raw = np.frombuffer(b"".join(found.column("content").to_pylist()), np.uint8)
    words = word_hash(raw, *word_spans(raw))
    end = np.cumsum(n)
    value = [n, spans_hash(words, end - n, end), joined(found.column("doc"), np.int64), joined(found.column("start"), np.int64)]
    if not len(n):
        return None, value
    letters = (words & LOW32).tolist()
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, (size, to) in enumerate(zip(n.tolist(), end.tolist(), strict=True)):
        auto.add_word(tuple(letters[to - size : to]), i)
    auto.make_automaton()
    return auto, value


OUT = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
     ("span_start", pa.list_(pa.int64())), ("span_length", pa.list_(pa.int64())), ("kept", pa.binary())]
)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word of a passage of ``window`` words that also starts earlier.

    Earlier: in a row with a smaller id, or further ahead in the same one. Words
    are runs of bytes other than space and 09 to 0D. Returns per row of
    ``docs``: ``id``, ``n_words``, ``n_removed``, ``span_start`` and
    ``span_length`` (maximal removed runs of words), ``kept`` (remaining words
    joined by a space, UTF-8).

    Passages are judged on the input. Null and empty texts have no words. A null
    id counts as larger than all others. Rows with equal ids count as one
    document whose rows begin at one place. Other columns are ignored, whatever
    their names; empty input gives no rows. ``window`` must be 9 to 200.
    """
    if not GRAM < window <= 200:
        raise ValueError("window must be 9 to 200 words")
    plan = recurring(docs, id_col, text_col, window, GRAM, word_chunk)
    groups = plan.groups

    def pieces(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows or not back.num_rows:
            return PIECES.empty_table()
        part = t.column("part")[0].as_py()
        t, back, _ = without_copies(t, back)
        if not t.num_rows:
            return PIECES.empty_table()
        of, seeds, times = seed_keys(back, groups)
        got, content = [], []
        for c in chunks(t, word_chunk):
            raw, w_start, w_end, words = c.raw
            start, size, key, is_hot = candidates(c, window, GRAM, of, seeds, times)
            piece = spans_hash(words, start, start + size + window - 1)
            doc, place = c.ids[c.doc[start]], start - c.first[c.doc[start]]
            order = np.lexsort((place, doc, piece))
            again = same_as_before(piece[order])
            pick = order[~again]
            many = np.bincount(np.cumsum(~again) - 1, minlength=len(pick)) > 1
            got.append((piece[pick], key[pick], doc[pick], place[pick], many, size[pick], is_hot[pick]))
            text = raw.tobytes()
            for a, b in zip(w_start[start[pick]].tolist(), w_end[start[pick] + size[pick] + window - 2].tolist(), strict=True):
                content.append(b" ".join(text[a:b].split()) + b" ")
        piece, key, doc, place, many, size, is_hot = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((place, doc, piece))
        again = same_as_before(piece[order])
        pick = order[~again]
        which = np.cumsum(~again) - 1
        many = (np.bincount(which, weights=many[order], minlength=len(pick)) > 0) | (np.bincount(which, minlength=len(pick)) > 1)
        route = mix64(np.where(is_hot[pick], piece[pick], key[pick]))
        bucket = ((route >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(groups + 1))
        rows = []
        for b in np.unique(bucket).tolist():
            k = by[cut[b] : cut[b + 1]]
            p = pick[k]
            texts = [content[i] for i in p.tolist()]
            rows.append(
                (b, part, key[p].tobytes(), piece[p].tobytes(), doc[p].tobytes(), place[p].tobytes(), many[k].tobytes(),
                 size[p].astype(np.uint8).tobytes(), np.array([len(x) for x in texts], np.int32).tobytes(), b"".join(texts))
            )
        return table_of(PIECES, rows)

    def stream(t: pa.Table, found: pa.Table) -> pa.Table:
        everything, out = t, [[] for _ in OUT]
        t, found, gone = without_copies(t, found)
        for i, _ in gone:
            kept = (everything.column("text")[i].as_py() or "").encode().split()
            n = len(kept)
            cut = n if n >= window else 0
            row = (everything.column("id")[i].as_py(), n, cut, [0] if cut else [], [cut] if cut else [], b" ".join(kept[cut:]))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        auto, (n_of, hash_of, doc_of, start_of) = automaton(found)
        for c in chunks(t, word_chunk):
            raw, w_start, w_end, words = c.raw
            last = np.r_[c.first[1:], len(words)]
            letters = (words & LOW32).tolist() if auto else []
            ends, which = [], []
            for a, b in zip(c.first.tolist(), last.tolist(), strict=True):
                if auto and b - a >= window:
                    for end, k in auto.iter(tuple(letters[a:b])):
                        ends.append(a + end + 1)
                        which.append(k)
            end, which = np.array(ends, np.int64), np.array(which, np.int64)
            at = end - n_of[which]
            doc = c.doc[at]
            other = (doc_of[which] != c.ids[doc]) | (start_of[which] != at - c.first[doc])
            sure = other & (spans_hash(words, at, end) == hash_of[which])
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, at[sure], 1)
            np.add.at(cover, end[sure], -1)
            covered = np.cumsum(cover[:-1]) > 0
            for i, (a, b) in enumerate(zip(c.first.tolist(), last.tolist(), strict=True)):
                mask = covered[a:b]
                spans = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)
                text = raw[w_start[a] : w_end[b - 1]].tobytes() if b > a else b""
                kept = text.split()
                if len(spans):
                    kept = [kept[k] for k in np.flatnonzero(~mask).tolist()]
                row = (t.column("id")[c.rows.start + i].as_py(), b - a, int((spans[:, 1] - spans[:, 0]).sum()),
                       spans[:, 0].tolist(), (spans[:, 1] - spans[:, 0]).tolist(), b" ".join(kept))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
        return pa.Table.from_arrays([pa.array(o, f.type) for o, f in zip(out, OUT, strict=True)], schema=OUT)

    by_part = plan.docs.groupBy("part")
    sent = by_part.cogroup(plan.seeds.groupBy("part")).applyInArrow(pieces, _sql(PIECES))
    found = sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(lambda t: confirm(t, window), _sql(PASSAGES))
    told = found.unionByName(plan.copies, allowMissingColumns=True)
    return by_part.cogroup(told.groupBy("part")).applyInArrow(
        stream, "id long, n_words long, n_removed long, span_start array<long>, span_length array<long>, kept binary"
    )


__all__ = ["remove_repeats", "NO_ID"]
