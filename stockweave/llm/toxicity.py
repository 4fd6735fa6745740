"""Toxicity scores from the nearest labelled examples.

Texts are TF-IDF vectors over all terms (words and word beginnings) of the
examples, with document counts over all documents; terms that go with a label
weigh more. Neighbours by exact cosine come from an inverted index with block
maxima: only blocks of examples whose upper bound can change the result are
completed. Similar examples share a block. Votes are weighted by similarity and calibrated on the examples
themselves, each without its own vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.phrase_dedup import INV, MUL, powers
from stockweave.llm.common import mix64, parts_for, stored

EXAMPLES = 8_000  # labelled rows the model is fitted on, at most
FLOOR = 0.06  # weight of a term that tells nothing about the labels, as a correlation with them
BEGINNINGS = (4, 5, 6, 7, 8, 10)  # bytes of word beginnings that are terms of their own
NEIGHBOURS = 25
BLOCK = 128  # examples in a block of the index
FIRST = 512  # examples completed first for each text
EVIDENCE = 5  # nearest examples reported
COMMON = 2048  # terms with the longest postings, kept as columns
ALIKE = 256  # the longest of them, by which similar examples are put into one block
SLICE = 384  # texts searched together, at most
PIECE = 1 << 17  # postings added up at a time, about
ROUNDING = 2e-6  # cosines nearer than this count as equal
CHUNK_BYTES = 1 << 20
EXAMPLE_BYTES = 64 << 20  # texts of the examples, at most
BUCKET_BYTES = 2 << 20  # example text whose postings make one bucket, on average
OWN_ROWS = 500  # examples calibrated in one task
EXAMPLE = (1 << 32) - 1  # the half of a posting that is its example
LETTER = np.zeros(256, bool)
LETTER[np.r_[65:91, 97:123, 128:256]] = True
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += 32
FOLD = mix64(FOLD + np.uint64(1))
KEPT: dict[int, np.ndarray] = {}  # powers of each base


def kept_powers(base: int, n: int) -> np.ndarray:
    """:func:`powers`, kept for the next texts unless these are unusually long."""
    if n > 2 * CHUNK_BYTES:
        return powers(base, n)
    if base not in KEPT or len(KEPT[base]) < n:
        KEPT[base] = powers(base, n)
    return KEPT[base][:n]


class Spans:
    """Hashes of spans of folded bytes, as ``spans_hash`` has them; the running sums are made once for all spans."""

    def __init__(self, raw: np.ndarray):
        x = FOLD[raw]
        with np.errstate(over="ignore"):
            self.total = np.r_[np.uint64(0), np.cumsum(x * kept_powers(MUL, len(x)), dtype=np.uint64)]
        self.scale = kept_powers(INV, len(x) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[end] - self.total[start]) * self.scale[start])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans]:
    """Document, start and end of each word of letters, and the folded bytes that terms are hashed from."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    edge = np.diff(np.r_[False, LETTER[raw], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return doc, start, end, Spans(raw)


def beginnings(x: Spans, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of beginnings the words that are longer, and the hashes of their beginnings."""
    got = []
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        got.append((long, x.hash(start[long], start[long] + n) ^ np.uint64(n)))
    return got


def runs(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (not negative) and the sums of their counts."""
    if not len(key):
        return key, count
    bits = int(count.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:  # one sort of plain numbers
        both = np.sort(key << bits | count)
        key, count = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def terms_of(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count, for words of letters (A-Z as a-z) and their beginnings, by document and term.

    With ``known`` (sorted), only those terms, as their places in it.
    """
    if known is not None:
        return places_of(texts, known)
    doc, start, end, x = words_of(texts)
    more = beginnings(x, start, end)
    h = np.concatenate([x.hash(start, end)] + [g for _, g in more])
    doc = np.concatenate([doc] + [doc[long] for long, _ in more])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else order
    return doc[first], h[first], np.diff(np.r_[first, len(h)])


def places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in ``known`` (sorted), or -1."""
    if not len(known):
        return np.full(len(h), -1)
    order = np.argsort(h)
    h = h[order]  # in order, neighbouring searches read the same memory
    found = np.minimum(np.searchsorted(known, h), len(known) - 1)
    at = np.empty(len(h), np.int64)
    at[order] = np.where(known[found] == h, found, -1)
    return at


def places_of(texts: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`terms_of` as places in ``known``, other terms left out. Each distinct word is looked up once."""
    doc, start, end, x = words_of(texts)
    h = x.hash(start, end)
    order = np.argsort(h)
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    word, first, which = h[new], order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    table = np.full((len(word), 1 + len(BEGINNINGS)), -1)
    table[:, 0] = places(known, word)
    for k, (long, h) in enumerate(beginnings(x, start[first], end[first]), 1):
        table[long, k] = places(known, h)
    pair, count = runs(doc * max(len(word), 1) + which, np.ones(len(doc), np.int64))
    doc, which = np.divmod(pair, max(len(word), 1))
    at = table[which]
    held = at >= 0
    key = (doc[:, None] * max(len(known), 1) + at)[held]
    key, count = runs(key, np.broadcast_to(count[:, None], at.shape)[held])
    return *np.divmod(key, max(len(known), 1)), count


@dataclass
class Index:
    """Examples by term. Postings of a term run from ``begin`` to the next one, by example."""

    terms: np.ndarray  # sorted hashes
    rarity: np.ndarray  # idf
    df: np.ndarray  # examples and toxic examples with the term
    toxic: np.ndarray
    idf: np.ndarray  # idf times association with the labels
    begin: np.ndarray
    posting: np.ndarray  # example and weight side by side in one number, so that both are fetched at once
    label: np.ndarray
    none: float  # toxic share of examples without any term
    dense: tuple | None = None  # column of each common term or -1, their weights by example, their block maxima

    @property
    def example(self) -> np.ndarray:
        return self.posting.view(np.int32)[::2]

    @property
    def weight(self) -> np.ndarray:
        return self.posting.view(np.float32)[1::2]


def association(df: np.ndarray, toxic: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weight of terms by their correlation with the labels; every term keeps at least ``FLOOR``."""
    share = label.mean() if len(label) else 0.0
    z = (toxic - df * share) / np.sqrt((df + 1) * max(share * (1 - share), 1e-9))
    return np.hypot(FLOOR, z / np.sqrt(max(len(label), 1)))


def unit_rows(doc: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights, of length 1 in each document."""
    return unit((1 + np.log(count)) * idf[term], doc, n)


def unit(w: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n))
    return w / np.maximum(norm, 1e-300)[doc]


def known_terms(texts: list[bytes], terms: np.ndarray, step: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`places_of` a few texts at a time."""
    got = []
    for a in range(0, len(texts), step):
        doc, term, count = places_of(texts[a : a + step], terms)
        got.append((doc + a, term, count))
    if not got:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def build_index(texts: list[bytes], label: np.ndarray, terms: np.ndarray) -> Index:
    """Index of texts on their own, with idf from these texts."""
    doc, term, count = known_terms(texts, terms)
    df = np.bincount(term, minlength=len(terms))
    toxic = np.bincount(term, weights=label[doc], minlength=len(terms))
    order = np.argsort(term, kind="stable")
    rarity = np.log((1 + len(label)) / (1 + df)) + 1
    return assemble(label, terms, df, toxic, rarity, [(doc[order], count[order])])


def assemble(label: np.ndarray, terms: np.ndarray, df: np.ndarray, toxic: np.ndarray, rarity: np.ndarray, postings) -> Index:
    """Index from pieces of postings: examples and counts by term and example, pieces in the order of their terms."""
    n = len(label)
    idf = rarity * association(df, toxic, label)
    begin = np.r_[0, np.cumsum(df)]
    posting = np.empty(begin[-1], np.int64)
    example, weight = posting.view(np.int32)[::2], posting.view(np.float32)[1::2]
    square = np.zeros(n)
    a = 0
    for ids, count in postings:
        b = a + len(ids)
        t = slice(*np.searchsorted(begin, [a, b]))
        w = (1 + np.log(count)) * np.repeat(idf[t], df[t])
        example[a:b], weight[a:b] = ids, w
        square += np.bincount(ids, weights=w * w, minlength=n)
        a = b
    length = np.sqrt(np.maximum(square, 1e-300)).astype(np.float32)
    for a in range(0, len(example), 1 << 20):
        weight[a : a + (1 << 20)] /= length[example[a : a + (1 << 20)]]
    empty = square == 0
    share = label.mean() if n else 0.0
    none = (label[empty].sum() + share) / (empty.sum() + 1.0)
    return Index(terms, rarity, df, toxic, idf, begin, posting, label, float(none))


def alike(weight: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Order of rows in which a block holds similar ones: halved along the direction in which they differ most, until
    a part is one block."""
    order = np.arange(len(weight))
    todo = [(0, len(order))]
    while todo:
        a, b = todo.pop()
        if b - a <= BLOCK:
            continue
        x = weight[order[a:b]]
        x -= x.mean(axis=0)
        way = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(rounds):
            way = (x @ way) @ x
            way /= max(float(np.sqrt(way @ way)), 1e-30)
        order[a:b] = order[a:b][np.argsort(x @ way, kind="stable")]
        middle = a + max(1, (b - a) // BLOCK // 2) * BLOCK
        todo += [(a, middle), (middle, b)]
    return order


def common_terms(ix: Index) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Terms with long postings as columns: column of each term or -1, the example at each place of the blocks (numbers
    from ``len(ix.label)`` on for none), the columns that each block has with their weights, and the block maxima."""
    if ix.dense is None:
        n = len(ix.label)
        blocks = max(1, -(-n // BLOCK))
        hot = np.argsort(-ix.df, kind="stable")[:COMMON]
        column = np.full(len(ix.terms), -1, np.int64)
        column[hot] = np.arange(len(hot))
        held = [slice(*at) for at in zip(ix.begin[hot].tolist(), ix.begin[hot + 1].tolist(), strict=True)]
        first = np.zeros((n, min(len(hot), ALIKE)), np.float32)
        for c, at in enumerate(held[:ALIKE]):
            first[ix.example[at], c] = ix.weight[at]
        order = np.r_[alike(first), np.arange(n, blocks * BLOCK)]
        block, place = np.divmod(np.argsort(order), BLOCK)
        has = np.zeros((len(hot), blocks), bool)
        for c, at in enumerate(held):
            has[c, block[ix.example[at]]] = True
        row = np.cumsum(has.T).reshape(has.T.shape) - 1  # of each column in each block, through all blocks
        weight = np.zeros((int(has.sum()), BLOCK), np.float32)
        for c, at in enumerate(held):
            ids = ix.example[at]
            weight[row[block[ids], c], place[ids]] = ix.weight[at]
        parts = [(np.flatnonzero(h), w) for h, w in zip(has.T, np.split(weight, np.cumsum(has.sum(axis=0))[:-1]), strict=True)]
        most = np.zeros(has.shape, np.float32)
        for b, (columns, w) in enumerate(parts):
            most[columns, b] = w.max(axis=1)
        ix.dense = column, order, parts, most
    return ix.dense


def added(ix: Index, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """Postings of the terms, times their weights in each of ``n`` texts, added up by text and example."""
    out = np.zeros((n, width), np.float32)
    size, edge = ix.df[term], np.searchsorted(doc, np.arange(n + 1))
    end = np.cumsum(size)
    jump = ix.begin[term] - end + size
    room = min(int(end[-1]), PIECE + int(size.max())) if len(end) else 0
    # every piece goes through the same memory: fresh arrays cost more than the sums
    number, at, got, part = np.arange(room), np.empty(room, np.int64), np.empty(room, np.int64), np.empty(room)
    for a in range(n):
        i, last = int(edge[a]), int(edge[a + 1])
        while i < last:
            base = int(end[i] - size[i])
            j = min(last, max(i + 1, int(np.searchsorted(end, base + PIECE, side="right"))))
            m = int(end[j - 1]) - base
            np.add(number[:m], np.repeat(jump[i:j] + base, size[i:j]), out=at[:m])
            np.take(ix.posting, at[:m], out=got[:m], mode="clip")  # all places exist; the default mode copies
            np.multiply(got[:m].view(np.float32)[1::2], np.repeat(weight[i:j], size[i:j]), out=part[:m])
            np.bitwise_and(got[:m], EXAMPLE, out=at[:m])
            out[a] += np.bincount(at[:m], weights=part[:m], minlength=width)
            i = j
    return out


def nearest_of(
    ix: Index, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``n`` texts the ``k`` examples with the greatest cosine (ties: the earlier one) and their cosines.

    Zero cosines and the example ``skip`` of a text are left out. Postings of
    rarer terms are added up; with the block maxima of the common terms they
    bound each block, and only blocks that can change a result are completed.
    """
    column, order_of, blocks, block_max = common_terms(ix)
    width = len(order_of)
    hot = column[term]
    q = np.zeros((len(block_max), n), np.float32)
    q[hot[hot >= 0], doc[hot >= 0]] = weight[hot >= 0]
    cold = hot < 0
    flat = added(ix, doc[cold], term[cold], weight[cold], n, width)
    rest = flat.take(order_of, axis=1).reshape(n, -1, BLOCK)
    bound = rest.max(axis=2) + q.T @ block_max
    flat.fill(0)
    score = flat.reshape(rest.shape)
    own, place = np.zeros(0, np.int64) if skip is None else np.flatnonzero(skip >= 0), np.argsort(order_of)
    done = bound <= 0
    order = np.argsort(-bound, axis=1, kind="stable")
    least = np.zeros(n, np.float32)
    for first in (FIRST // BLOCK, bound.shape[1]):
        want = np.zeros_like(done)
        np.put_along_axis(want, order[:, :first], True, axis=1)
        want &= ~done & (bound >= least[:, None] - ROUNDING)
        for b in np.flatnonzero(want.any(axis=0)).tolist():
            r = np.flatnonzero(want[:, b])
            columns, w = blocks[b]
            part = q[columns]
            if 4 * len(r) > 3 * n:  # cheaper for all texts than picking some
                score[:, b] = np.where(want[:, b, None], rest[:, b] + part.T @ w, score[:, b])
            else:
                score[r, b] = rest[r, b] + part.take(r, axis=1).T @ w
        if len(own):
            flat[own, place[skip[own]]] = 0
        done |= want
        if first * BLOCK > k and first < bound.shape[1]:  # all that is not zero yet
            seen = np.take_along_axis(score, order[:, :first, None], axis=1).reshape(n, -1)
            least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
    out = []
    for row, low in zip(flat, least.tolist(), strict=True):
        ids = np.flatnonzero((row > 0) & (row >= low - ROUNDING))
        if len(ids) > k:
            got = row[ids]
            ids = ids[got >= np.partition(got, len(got) - k)[len(got) - k] - ROUNDING]
        cos = row[ids].astype(np.float64)
        at = np.lexsort((order_of[ids], -cos.round(6)))[:k]
        out.append((order_of[ids[at]], cos[at]))
    return out


def nearest(ix: Index, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest_of` one text."""
    return nearest_of(ix, np.zeros(len(term), np.int64), term, weight, 1, k, np.array([skip]))[0]


def vote(ix: Index, ids: np.ndarray, cos: np.ndarray) -> float:
    """Toxic share of the neighbours, each weighted by its similarity squared, with one vote of the empty texts' share."""
    w = cos * cos
    return float(((w * ix.label[ids]).sum() + ix.none) / (w.sum() + 1.0))


def votes_of(
    ix: Index, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, own: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vote of each text, and its nearest examples with their cosines. Texts that are the examples ``own``
    do not vote for themselves, and what they add to the weights of their own terms is taken out."""
    evidence, parts = [], -(-n // SLICE)  # of one size, or nearly so
    edges = [n * i // parts for i in range(parts + 1)]
    at = np.searchsorted(doc, edges)
    for k, a in enumerate(edges[:-1]):
        rows, m = slice(at[k], at[k + 1]), edges[k + 1] - a
        d, t = doc[rows] - a, term[rows]
        weight = (1 + np.log(count[rows])) * ix.idf[t]
        mine = None
        if own is not None:
            mine = own[a : a + m]
            without = association(ix.df[t] - 1, ix.toxic[t] - ix.label[mine[d]], ix.label)
            weight = np.where(ix.df[t] > 1, weight / ix.idf[t] * ix.rarity[t] * without, 0.0)
        evidence += nearest_of(ix, d, t, unit(weight, d, m), m, NEIGHBOURS, mine)
    return np.array([vote(ix, *e) for e in evidence]), evidence


def votes(ix: Index, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """:func:`votes_of` texts."""
    return votes_of(ix, *known_terms(texts, ix.terms), len(texts))


def calibration(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of labels on votes by pooling neighbours that are out of order: votes and the scores they stand for."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        if pools and pools[-1][3] == x:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1.0, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, _, hi = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = hi
    share = label.mean() if len(label) else 0.0
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([(p[0] + share) / (p[1] + 1) for p in pools])


def scores(ix: Index, fitted: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Calibrated scores, and the nearest examples with their cosines."""
    raw, evidence = votes(ix, texts)
    # the votes break ties inside a pool
    return np.clip(0.98 * np.interp(raw, *fitted) + 0.02 * raw, 0, 1), evidence


def rarity_of(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Inverse document frequency of the terms over all rows of ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        n, df = 0, np.zeros(len(shared.value), np.int64)
        for b in batches:
            n += b.num_rows
            for held in text_batches(b.column(0)):
                df += np.bincount(places_of(held, shared.value)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], ["term", "n"])

    got = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term
    df = np.zeros(len(terms) + 1, np.int64)
    df[got["term"].to_numpy() + 1] = got["n"].to_numpy()
    shared.destroy()
    return np.log((1 + df[0]) / (1 + df[1:])) + 1


def flat(column, kind: type) -> np.ndarray:
    """Numbers of all rows of a binary column."""
    return np.concatenate([np.zeros(0, kind)] + [np.frombuffer(v.as_buffer(), kind) for v in column])


def example_index(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Postings of the rows (example, label, text), a row for each range of term hashes: its terms in order,
    their examples and toxic examples, and by term and example the examples and counts."""
    buckets = parts_for(n_bytes, BUCKET_BYTES)
    width = np.uint64(2**64 // buckets + 1) if buckets > 1 else None

    def spread(batches):
        for b in batches:
            out = []
            for example, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, h, count = terms_of([(text or "").encode()])
                bucket = h // width if width else np.zeros(len(h), np.uint64)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.zeros(0, np.int64)
                for i, j in zip(first.tolist(), np.r_[first, len(h)][1:].tolist(), strict=True):
                    out.append((int(bucket[i]), example, label, h[i:j].tobytes(), count[i:j].astype(np.int32).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "example", "label", "terms", "counts"]
            )

    def merge(rows: pa.Table) -> pa.Table:
        size = pc.binary_length(rows["counts"]).to_numpy() // 4
        example, label = (np.repeat(rows[c].to_numpy(), size) for c in ("example", "label"))
        h, count = flat(rows["terms"], np.uint64), flat(rows["counts"], np.int32)
        order = np.lexsort((example, h))
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        parts = {
            "terms": h[first],
            "df": np.diff(np.r_[first, len(h)]).astype(np.int32),
            "toxic": np.add.reduceat(label[order], first).astype(np.int32),
            "examples": example[order].astype(np.int32),
            "counts": count[order],
        }
        return pa.table({"bucket": rows["bucket"].slice(0, 1)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

    return (
        texts.select("example", "label", "text")
        .mapInArrow(spread, "bucket int, example int, label int, terms binary, counts binary")
        .repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(merge, "bucket int, terms binary, df binary, toxic binary, examples binary, counts binary")
    )


def index_in_task(base, postings) -> Index:
    """The index from its broadcast parts, put together once in each worker process."""
    parts = base.value
    if "index" not in parts:
        pieces = ((np.frombuffer(e, np.int32), np.frombuffer(c, np.int32)) for e, c in (p.value for p in postings))
        parts["index"] = assemble(*(parts[k] for k in ("label", "terms", "df", "toxic", "rarity")), pieces)
        common_terms(parts["index"])
    return parts["index"]


def text_batches(column):
    """Texts of a column as bytes, in pieces of bounded size."""
    held, total = [], 0
    for v in column:
        held.append((v.as_py() or "").encode())
        total += len(held[-1])
        if total >= CHUNK_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def held_out(id_col) -> F.Column:
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    examples: int = EXAMPLES,
    example_bytes: int = EXAMPLE_BYTES,
    threshold: float = 0.7,
) -> DataFrame:
    """Toxicity of every row of ``docs``: the id, ``held_out``, ``score``, ``predicted`` and ``evidence``.

    The model is fitted on at most ``examples`` labelled rows, those with the
    least hash of the id among rows that are not held out (crc32 of the id as
    text is 1 modulo 3), as far as their texts stay within ``example_bytes`` (one
    at least); calibration sees all of them. ``evidence`` holds the nearest
    examples with their cosines. The index is built and searched in tasks; the
    driver holds a few numbers per example and per term, and passes on one
    bucket of postings at a time.

    Null and empty texts and texts without a known term get the share of toxic
    examples without one. Null labels and ids are no examples; an id with
    several labels counts once, with the least; of several texts of an id the least
    one is the example. Without any example the score is
    one half. Repeated rows repeat; other columns are ignored; empty input gives
    no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = (
        labels.filter(labels[id_col].isNotNull() & labels[label_col].isNotNull())
        .filter(~held_out(labels[id_col]))
        .groupBy(labels[id_col].alias("key"))
        .agg(F.min(labels[label_col]).cast("int").alias("label"))
        .join(docs.select(docs[id_col].alias("key")), "key", "left_semi")  # labels of other documents are no examples
        .orderBy(F.xxhash64("key"), "key")
        .limit(examples)
    )
    found = stored(
        docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
        .join(F.broadcast(chosen), "key")  # at most ``examples`` rows
        .groupBy("key")
        .agg(F.min("text").alias("text"), F.first("label").alias("label")),
        "toxic-examples",
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    rows = found.select("key", "label", size, F.xxhash64("key").alias("h")).toArrow()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("h", "ascending"), ("key", "ascending")]))
    total = np.cumsum(rows["size"].to_numpy())
    rows = rows.slice(0, max(1, int((total <= example_bytes).sum())))
    keys, label = rows["key"].to_pylist(), rows["label"].to_numpy().astype(np.float64)
    base, postings, fitted = None, [], None
    if len(keys):
        numbers = spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), f"key {kind}, example int")
        texts = found.join(F.broadcast(numbers), "key")
        index = stored(example_index(texts, int(total[len(keys) - 1])), "toxic-index")
        heads = index.select("bucket", "terms", "df", "toxic").toArrow().sort_by("bucket")
        terms = flat(heads["terms"], np.uint64)
        model = {"names": keys, "label": label, "terms": terms, "df": flat(heads["df"], np.int32).astype(np.int64)}
        model |= {"toxic": flat(heads["toxic"], np.int32).astype(np.float64), "rarity": rarity_of(docs.select(docs[text_col]), terms)}
        base = spark.sparkContext.broadcast(model)  # numbers per term and per example
        sent = {}
        for r in index.select("bucket", "examples", "counts").toLocalIterator():  # at most a few bytes per byte of example
            sent[r["bucket"]] = spark.sparkContext.broadcast((bytes(r["examples"]), bytes(r["counts"])))
        postings = [sent[b] for b in sorted(sent)]

        def own_votes(batches):
            ix = index_in_task(base, postings)
            for b in batches:
                own, a = b.column(0).to_numpy().astype(np.int64), 0
                for held in text_batches(b.column(1)):
                    mine = own[a : a + len(held)]
                    raw = votes_of(ix, *known_terms(held, ix.terms), len(held), mine)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(raw)], ["example", "raw"])
                    a += len(held)

        spread = texts.select("example", "text").repartition(parts_for(len(keys), OWN_ROWS))
        raw = spread.mapInArrow(own_votes, "example int, raw double").toArrow().sort_by("example")["raw"].to_numpy()
        fitted = calibration(raw, label)

    def run(batches):
        model = index_in_task(base, postings) if base is not None else None
        names = base.value["names"] if base is not None else []
        for b in batches:
            out, evidence = np.full(b.num_rows, 0.5), [[]] * b.num_rows
            held, begin, total = [], 0, 0
            column = b.column(1)
            for i in range(b.num_rows):
                held.append((column[i].as_py() or "").encode())
                total += len(held[-1])
                if total >= CHUNK_BYTES or i == b.num_rows - 1:
                    if model is not None:
                        out[begin : i + 1], near = scores(model, fitted, held)
                        evidence[begin : i + 1] = [
                            [{"example": names[e], "cosine": float(x)} for e, x in zip(ids[:EVIDENCE].tolist(), cos, strict=False)]
                            for ids, cos in near
                        ]
                    held, begin, total = [], i + 1, 0
            got = pa.array(evidence, pa.list_(pa.struct([("example", b.column(0).type), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), got], ["id", "score", "evidence"])

    got = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, score double, evidence array<struct<example: {kind}, cosine: double>>")
    return got.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )
