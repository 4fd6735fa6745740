"""Near-duplicate documents by a parity-sketch join on word shingles.

A document's shingles are dealt into blocks by hash; the sketch of a block is
the XOR of its shingles' hashes. Two sets of a size band that may link differ
in at most ``t`` shingles, which spoil ``t`` of ``K`` blocks, so some block
sketch is equal (pigeonhole). Pairs under an equal sketch are tested by the
Hamming distance of one-bit-per-shingle parity sketches, which never exceeds
the symmetric difference, and then by their sets.

Only keys found more than once travel with a document; every distinct text
takes part once, however many copies it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import fresh, mix64, stored
from stockweave.llm.components import components
from stockweave.llm.phrase_dedup import gram_hash, spans_hash, word_hash, word_spans
from stockweave.llm.seeds import (
    NO_ID, SENT_SQL, Chunk, chunks, counts_of, deal, joined, member, recurring_keys, seed_keys, sizes, spread, table_of,
    take_spans, without_copies,
)

SHINGLE = 5
BITS = 1024  # of the parity sketch that bounds the symmetric difference from below
PARTNERS = 256  # pairs of one text that one bucket verifies
SMALL_ROWS = 200_000  # rows of two numbers that may be broadcast
BLOCK = 4096  # documents under one key that one task compares
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Upper ends of the size bands, each a quarter above the one before.
BANDS = np.unique(np.floor(1.25 ** np.arange(1, 200)).astype(np.float64)[:150]).astype(np.int64)


def shingle_chunk(texts: list[bytes]) -> tuple:
    """Shingle hashes of documents, sorted and distinct in each; ``doc`` runs over shingles."""
    raw = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    start, end = word_spans(raw)
    words = word_hash(raw, start, end)
    begin = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))
    last = np.r_[begin[1:], len(words)]
    grams = gram_hash(words, SHINGLE)
    short = (last - begin < SHINGLE) & (last > begin)
    whole = spans_hash(words, begin, last)
    sets = []
    for i, (a, b) in enumerate(zip(begin.tolist(), last.tolist(), strict=True)):
        got = whole[i : i + 1] if short[i] else np.sort(grams[a : max(a, b - SHINGLE + 1)])
        sets.append(got[np.r_[True, got[1:] != got[:-1]]] if len(got) > 1 else got)
    n = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    return raw, doc, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(n) - n


def set_sizes(c: Chunk) -> np.ndarray:
    return np.diff(np.r_[c.first, len(c.doc)])


def block_keys(c: Chunk, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a chunk: key, its document, and whether the band is the document's own.

    A set pairs with larger ones in its own band and in the bands above that
    reach no further than the allowed ratio of sizes. Blocks of fewer than two
    shingles are left out where enough others must be equal anyway.
    """
    n = set_sizes(c)
    out = []
    own = np.searchsorted(BANDS, n)
    step = 0
    while True:
        band = own + step
        low = np.r_[0, BANDS][band] + 1
        docs = np.flatnonzero((n > 0) & ((low * percent <= 100 * n) | (step == 0)))
        if not len(docs):
            break
        top = BANDS[band[docs]]
        # s <= (|A| + |B|) * (100 - p) / (100 + p), as the union is (|A| + |B| + s) / 2
        t_band = 2 * top * (100 - percent) // (100 + percent)
        blocks = np.maximum(t_band + 1, (7 * t_band + 4) // 5)
        partner = np.minimum(top, n[docs] * 100 // percent)
        spoiled = (n[docs] + partner) * (100 - percent) // (100 + percent)
        base = np.cumsum(blocks) - blocks
        at = np.full(len(n), -1, np.int64)
        at[docs] = np.arange(len(docs))
        mine = at[c.doc]
        use = mine >= 0
        mine, h = mine[use], c.gram[use]
        where = base[mine] + (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % blocks[mine].astype(np.uint64)).astype(np.int64)
        total = int(blocks.sum())
        count = np.bincount(where, minlength=total)
        sketch = np.zeros(total, np.uint64)
        np.bitwise_xor.at(sketch, where, h)
        few = np.add.reduceat((count < 2).astype(np.int64), base)
        none = np.add.reduceat((count < 1).astype(np.int64), base)
        sure = blocks - spoiled
        least = np.where(few < sure, 2, np.where(none < sure, 1, 0))
        owner = np.repeat(np.arange(len(docs)), blocks)
        keep = count >= least[owner]
        owner = owner[keep]
        tag = (band[docs][owner].astype(np.uint64) << np.uint64(40)) + spread(blocks)[keep].astype(np.uint64)
        out.append((mix64(sketch[keep] ^ mix64(tag)), docs[owner], np.full(len(owner), step == 0)))
        step += 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of ``BITS`` bits, packed."""
    bit = (mix64(hashes) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS).astype(np.uint8) & 1)


KEYS = pa.schema([("bucket", pa.int32()), ("part", pa.int32())] + [(c, pa.binary()) for c in ("key", "text", "n", "own")])
MEMBERS = pa.schema(
    [("gid", pa.int64()), ("text", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("own", pa.bool_()),
     ("lead", pa.int64()), ("lead_part", pa.int32()), ("lead_n", pa.int32())]
)
MEMBERS_SQL = "gid long, text long, part int, n int, own boolean, lead long, lead_part int, lead_n int"


def members_of(t: pa.Table) -> pa.Table:
    """Groups of texts under one key with a leader, one copy of each distinct group."""
    width = sizes(t.column("key"), 8)
    part = np.repeat(t.column("part").to_numpy(), width)
    key, text = joined(t.column("key"), np.uint64), joined(t.column("text"), np.int64)
    n, own = joined(t.column("n"), np.int32), joined(t.column("own"), np.bool_)
    order = np.lexsort((text, ~own, key))  # own members first, so the first one can lead
    key, text, part, n, own = key[order], text[order], part[order], n[order], own[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(key)])
    with np.errstate(over="ignore"):
        gid = np.add.reduceat(mix64(text.view(np.uint64) ^ np.uint64(0xA5)) + own, begin)
    good = (size > 1) & own[begin]
    _, first = np.unique(gid, return_index=True)
    once = np.zeros(len(gid), bool)
    once[first] = True
    rows = take_spans(np.arange(len(key)), begin[good & once], size[good & once])
    lead = begin[group[rows]]
    cols = (gid[group[rows]].view(np.int64), text[rows], part[rows], n[rows], own[rows], text[lead], part[lead], n[lead])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MEMBERS, strict=True)], schema=MEMBERS)


def fetch(dealt: DataFrame, copies: DataFrame, wanted: DataFrame, sketch: bool) -> DataFrame:
    """Sets (or parity sketches) of the texts asked for, once for each ``bucket`` that asks.

    ``wanted``: part, text, bucket. Returns bucket, text, n, data.
    """

    def give(t: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("text", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
        want = told.filter(told.column("bucket").is_valid())
        if not want.num_rows or not t.num_rows:
            return schema.empty_table()
        asked: dict[int, list[int]] = {}
        for text, bucket in zip(want.column("text").to_pylist(), want.column("bucket").to_pylist(), strict=True):
            asked.setdefault(text, []).append(bucket)
        t = t.filter(pa.array(member(t.column("t1").to_numpy(), np.unique(want.column("text").to_numpy()))))
        rows = []
        for c in chunks(t, shingle_chunk):
            last = np.r_[c.first[1:], len(c.doc)]
            names = t.column("t1")[c.rows.start : c.rows.stop].to_pylist()
            for name, a, b in zip(names, c.first.tolist(), last.tolist(), strict=True):
                if buckets := asked.pop(name, None):
                    data = (parity_sketch(c.gram[a:b]) if sketch else c.gram[a:b]).tobytes()
                    rows += [(k, name, b - a, data) for k in buckets]
        return table_of(schema, rows)

    return dealt.groupBy("part").cogroup(wanted.select("part", "text", "bucket").groupBy("part")).applyInArrow(
        give, "bucket long, text long, n int, data binary"
    )


def verify(dealt: DataFrame, copies: DataFrame, pairs: DataFrame, percent: int, groups: int) -> DataFrame:
    """Of the pairs (a, a_part, b, b_part), those whose sets are similar enough: a, b.

    Pairs meet their sets in buckets by ``a``, with salts where ``a`` has many
    partners, so a set travels once for each bucket that needs it.
    """
    busy = pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > PARTNERS)
    busy = stored(busy.select(F.col("a").alias("hub"), F.ceil(F.col("m") / PARTNERS).alias("salts")), "busy-texts")
    hubs = F.broadcast(busy) if busy.count() <= SMALL_ROWS else busy
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long")))
    salted = pairs.join(hubs, F.col("a") == F.col("hub"), "left")
    bucket = F.pmod(F.xxhash64("a", salt), F.lit(8 * groups))
    spread_pairs = stored(salted.select("a", "a_part", "b", "b_part", bucket.alias("bucket")), "pairs")
    wanted = (
        spread_pairs.select(F.col("a_part").alias("part"), F.col("a").alias("text"), "bucket")
        .union(spread_pairs.select("b_part", "b", "bucket"))
        .distinct()
    )
    sets = fetch(dealt, copies, wanted, False)

    def test(pair: pa.Table, got: pa.Table) -> pa.Table:
        of = {k: np.frombuffer(v, np.uint64) for k, v in zip(got.column("text").to_pylist(), got.column("data").to_pylist(), strict=True)}
        out = []
        for a, b in zip(pair.column("a").to_pylist(), pair.column("b").to_pylist(), strict=True):
            x, y = of[a], of[b]
            if len(x) > len(y):
                x, y = y, x
            both = int(member(x, y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
        return table_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), out)

    return spread_pairs.select("bucket", "a", "b").groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInArrow(
        test, "a long, b long"
    )


def close_pairs(t: pa.Table, percent: int) -> pa.Table:
    """Pairs of a group from different components that their sketches do not rule out."""
    schema = pa.schema([("a", pa.int64()), ("a_part", pa.int32()), ("b", pa.int64()), ("b_part", pa.int32())])
    order = np.argsort(t.column("gid").to_numpy(), kind="stable")
    gid = t.column("gid").to_numpy()[order]
    text, part, n = (t.column(c).to_numpy()[order] for c in ("text", "part", "n"))
    own, root = t.column("own").to_numpy(zero_copy_only=False)[order], t.column("root").to_numpy()[order]
    sketch = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
    begin = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    left, right = [], []
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(gid)].tolist(), strict=True):
        for i in range(a, b - 1):
            rest = slice(i + 1, b)
            m = n[rest].astype(np.int64)
            fit = (root[rest] != root[i]) & (own[rest] | own[i])
            fit &= (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
            j = np.flatnonzero(fit)
            if len(j):
                far = np.bitwise_count(sketch[rest][j] ^ sketch[i]).sum(axis=1).astype(np.int64)
                j = j[far * (100 + percent) <= (m[j] + n[i]) * (100 - percent)] + i + 1
                left.append(np.full(len(j), i))
                right.append(j)
    if not left:
        return schema.empty_table()
    i, j = np.concatenate(left), np.concatenate(right)
    swap = text[i] > text[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    cols = (text[i], part[i], text[j], part[j])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def similar_texts(dealt: DataFrame, copies: DataFrame, groups: int, percent: int) -> DataFrame:
    """Component root of every distinct text that links with another one: node, root (text hashes)."""

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of(pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("low", pa.binary()), ("n", pa.binary())]), [])
        part = t.column("part")[0].as_py()
        t, _, _ = without_copies(t, told)
        got = [block_keys(c, percent)[0] for c in chunks(t, shingle_chunk)]
        return counts_of(np.concatenate(got or [np.zeros(0, np.uint64)]), part, groups)

    def keys(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return KEYS.empty_table()
        part = t.column("part")[0].as_py()
        t, told, _ = without_copies(t, told)
        of, known, times = seed_keys(told, groups)
        got = []
        for c in chunks(t, shingle_chunk):
            key, doc, own = block_keys(c, percent)
            number = of(key)
            hit = member(number, known)
            key, doc, own, number = key[hit], doc[hit], own[hit], number[hit]
            text, n = t.column("t1")[c.rows.start : c.rows.stop].to_numpy()[doc], set_sizes(c)[doc]
            # under a frequent key, documents meet in pairs of blocks
            blocks = -(-times[np.searchsorted(known, number)].astype(np.int64) // BLOCK) if len(known) else np.ones(0, np.int64)
            mine = (mix64(text.view(np.uint64)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(key)), blocks)
            other = spread(blocks)
            pair = np.minimum(mine[row], other) * 65537 + np.maximum(mine[row], other)
            key = np.where(blocks[row] > 1, mix64(key[row] ^ mix64(pair.astype(np.uint64) + np.uint64(1))), key[row])
            got.append((key, text[row], n[row].astype(np.int32), own[row]))
        if not got:
            return KEYS.empty_table()
        key, text, n, own = (np.concatenate(x) for x in zip(*got, strict=True))
        bucket = ((mix64(key) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        by = np.lexsort((text, bucket))
        cut = np.searchsorted(bucket[by], np.arange(groups + 1))
        rows = []
        for b in np.unique(bucket).tolist():
            k = by[cut[b] : cut[b + 1]]
            rows.append((b, part, key[k].tobytes(), text[k].tobytes(), n[k].tobytes(), own[k].tobytes()))
        return table_of(KEYS, rows)

    by_part = dealt.groupBy("part")
    back = recurring_keys(by_part.cogroup(copies.groupBy("part")).applyInArrow(send, SENT_SQL), groups)
    told = back.unionByName(copies, allowMissingColumns=True)
    sent = by_part.cogroup(told.groupBy("part")).applyInArrow(
        keys, "bucket int, part int, key binary, text binary, n binary, own binary"
    )
    found = sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(members_of, MEMBERS_SQL)
    found = stored(found.dropDuplicates(["gid", "text", "part"]), "members")

    alike = 100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")
    first = (
        found.filter(alike & (F.col("text") != F.col("lead")))
        .select(F.col("lead").alias("a"), F.col("lead_part").alias("a_part"), F.col("text").alias("b"), F.col("part").alias("b_part"))
        .dropDuplicates(["a", "b"])
    )
    links = stored(verify(dealt, copies, first, percent, groups), "first-links")
    roots = components(links)
    placed = found.join(roots, found["text"] == roots["node"], "left").withColumn("root", F.coalesce("root", "text"))
    mixed = placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    open_ = stored(placed.join(mixed.select("gid"), "gid").select("gid", "text", "part", "n", "own", "root"), "mixed")
    bucket = F.pmod("gid", F.lit(8 * groups))
    data = fetch(dealt, copies, open_.select("part", "text", bucket.alias("bucket")).distinct(), True)
    bundle = open_.withColumn("bucket", bucket).join(data.select("bucket", "text", "data"), ["bucket", "text"])
    second = (
        bundle.groupBy("bucket")
        .applyInArrow(lambda t: close_pairs(t, percent), "a long, a_part int, b long, b_part int")
        .dropDuplicates(["a", "b"])
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = verify(dealt, copies, stored(second, "second-pairs"), percent, groups)
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Class of each document under links of Jaccard similarity ``percent`` or more on 5-word shingles.

    Words are runs of bytes other than space and 09 to 0D, with A-Z in lower
    case; a text of fewer than five words is one shingle. Returns per row of
    ``docs``: the id, ``n_shingles`` (set size), ``component_id`` (least id of
    the class), ``leads`` (the row that stays if one of each class may stay) and
    ``text_hash_1`` and ``text_hash_2``.

    Null texts and texts without words have no shingles and are their own class.
    A null id never names a class, unless the class has no other. Copies and
    rows with equal ids are members like all others. Shingles are told apart by
    64-bit hashes. Other columns are ignored, whatever their names; empty input
    gives no rows. ``percent`` must be 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    dealt, copies, groups = deal(docs, id_col, text_col)
    roots = similar_texts(dealt, copies, groups, percent)

    def count(batches):
        schema = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int32()), ("n", pa.int64())])
        for b in batches:
            t = pa.Table.from_batches([b])
            for c in chunks(t, shingle_chunk):
                part = t.slice(c.rows.start, c.rows.stop - c.rows.start)
                yield from pa.Table.from_arrays(
                    [*(part.column(k) for k in ("id", "t1", "t2")), pa.array(set_sizes(c))], schema=schema
                ).to_batches()

    plain = docs.select(
        docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t1"),
        F.hash(docs[text_col]).alias("t2"),
    )
    rows = stored(plain.mapInArrow(count, "id long, t1 long, t2 int, n long"), "shingle-counts")
    lead = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "t1", "t2"))
    texts = rows.filter("n > 0").groupBy("t1", "t2").agg(F.min("id").alias("least"), lead.alias("lead"))
    rooted = texts.join(roots, texts["t1"] == roots["node"], "left").withColumn("root", F.coalesce("root", "t1"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("lead").alias("class_lead"))
    named = rooted.join(classes, "root").select("t1", "t2", "component_id", "class_lead")
    me = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "t1", "t2")
    return rows.join(named, ["t1", "t2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | (me == F.col("class_lead"))).alias("leads"),
        F.col("t1").alias("text_hash_1"),
        F.col("t2").alias("text_hash_2"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row of each class of near-duplicates, with its columns: the one with the least id, then text hash."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    k1, k2, k3 = fresh(docs, "text_hash_1", "text_hash_2", "row_id")
    chosen = classes.filter("leads").select(
        F.col("text_hash_1").alias(k1), F.col("text_hash_2").alias(k2), F.coalesce(id_col, F.lit(NO_ID)).alias(k3)
    )
    keys = {
        k1: F.xxhash64(docs[text_col]), k2: F.hash(docs[text_col]), k3: F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)),
    }
    return docs.withColumns(keys).join(chosen.distinct(), [k1, k2, k3], "left_semi").dropDuplicates([k1, k2, k3]).drop(k1, k2, k3)
