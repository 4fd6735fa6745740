"""Repeated byte strings by depth-limited radix sort of suffixes.

Only suffixes whose key recurs (:mod:`stockweave.llm.seeds`) can share their
first ``window`` bytes with another one. They travel as pieces of text, each
distinct piece once per group of documents, to the bucket of their key. Inside a
bucket digits of eight bytes split unequal suffixes apart, the first one first; single ones leave at once, and what is still together after
``window`` bytes is a repeated string. The least document id of each string goes
back to the groups that hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import give_back, mix64
from stockweave.llm.seeds import (
    NO_ID, Chunk, Plan, candidates, chunks, joined, member, recurring, runs, seed_keys, sizes, spread,
    table_of, take_spans, window_keys, without_copies,
)

GRAM = 24  # bytes hashed at once; also what the least hash is taken over
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words64(raw: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place as one number."""
    return np.ndarray((max(0, len(raw) - 7),), f"{order}u8", raw, strides=(1,))


def gram_hash(eight: np.ndarray, a, b, c) -> np.ndarray:
    """Hash of ``GRAM`` bytes from their three parts of eight."""
    with np.errstate(over="ignore"):
        h = eight[a] * ODD[0] + eight[b] * ODD[1]
        h ^= h >> np.uint64(29)
        return mix64(h + eight[c] * ODD[2])


def byte_chunk(texts: list[bytes]) -> tuple:
    joined_text = b"".join(texts)
    raw = np.frombuffer(joined_text + bytes(GRAM), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    n = len(joined_text)
    h = gram_hash(words64(raw), slice(0, n), slice(8, n + 8), slice(16, n + 16))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    return raw, doc, h[: max(0, n - GRAM + 1)], np.cumsum(size) - size


def window_hash(raw: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` bytes from each place in ``at``."""
    eight, h = words64(raw), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in sorted({*range(0, window - 7, 8), window - 8}):
            h = (h ^ eight[at + k]) * ODD[k // 8 % 4]
            h ^= h >> np.uint64(31)
    return mix64(h)


def keys_at(raw: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Key of the window at each place: the least hash of its grams."""
    eight = words64(raw)
    least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for k in range(window - GRAM + 1):
        np.minimum(least, gram_hash(eight, at + k, at + k + 8, at + k + 16), out=least)
    return least


def piece_ids(raw: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Id of a run of windows; the first and the last one overlap, so they give all its bytes."""
    with np.errstate(over="ignore"):
        h = window_hash(raw, start, window) * ODD[0] + window_hash(raw, start + size - 1, window)
        return mix64(h + size.astype(np.uint64) * ODD[3])


PIECES = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32())]
    + [(c, pa.binary()) for c in ("least", "most", "size", "hot", "content")]
)
FOUND = pa.schema(
    [("part", pa.int32())] + [(c, pa.binary()) for c in ("key", "piece", "hot", "n", "run", "least")]
)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def radix_groups(digits, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split groups of suffixes digit by digit; returns members and group of what stays together.

    ``digits`` gives for each depth a function from suffix starts to numbers.
    """
    alive = np.arange(len(at))
    for digit in digits:
        d = digit(at[alive])
        order = np.lexsort((d, group))
        g, d = group[order], d[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.zeros(0, bool)
        gid = np.cumsum(new) - 1
        keep = np.bincount(gid, minlength=1)[gid] > 1 if len(g) else new
        alive, group = alive[order][keep], gid[keep]
    return alive, group


def least_ids(t: pa.Table, window: int) -> pa.Table:
    """For the pieces of one bucket, the least id of a document with each of their windows."""
    part = t.column("part").to_pylist()
    own = np.repeat(np.arange(len(part)), sizes(t.column("least"), 8))
    least, most = joined(t.column("least"), np.int64), joined(t.column("most"), np.int64)
    size, hot = joined(t.column("size"), np.uint8).astype(np.int64), joined(t.column("hot"), np.bool_)
    raw = np.frombuffer(b"".join(t.column("content").to_pylist()) + bytes(GRAM), np.uint8)
    length = size + window - 1
    where = np.cumsum(length) - length
    # one copy of each distinct piece
    piece = piece_ids(raw, where, size, window)
    order = np.lexsort((least, size, piece))
    new = np.r_[True, (piece[order][1:] != piece[order][:-1]) | (size[order][1:] != size[order][:-1])]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    pick = order[new]
    n = size[pick]
    begin = np.cumsum(n) - n
    at = np.repeat(where[pick], n) + spread(n)
    found = np.repeat(least[pick], n)
    big = words64(raw, ">")
    depths = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]
    alive, group = radix_groups([lambda p, k=k: big[p + k] for k in depths], np.zeros(len(at), np.int64), at)
    if len(alive):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        lowest = np.minimum.reduceat(found[alive[order]], first)
        found[alive[order]] = np.repeat(lowest, np.diff(np.r_[first, len(order)]))
    # runs of one id inside a piece
    edge = np.zeros(len(found), bool)
    edge[begin] = True
    edge[1:] |= found[1:] != found[:-1]
    run_at = np.flatnonzero(edge)
    run_size = np.diff(np.r_[run_at, len(found)])
    run_piece = np.repeat(np.arange(len(pick)), n)[run_at]
    runs_of = np.bincount(run_piece, minlength=len(pick))
    run_begin = np.cumsum(runs_of) - runs_of
    lowest = np.minimum.reduceat(found[run_at], run_begin)
    send = np.flatnonzero(lowest[which] < most)
    key = np.zeros(len(pick), np.uint64)
    asked = np.unique(which[send])
    key[asked] = keys_at(raw, where[pick[asked]], window)
    cut = np.searchsorted(own[send], np.arange(len(part) + 1))
    rows = []
    for i, p in enumerate(part):
        if cut[i] < cut[i + 1]:
            s = send[cut[i] : cut[i + 1]]
            w = which[s]
            r = take_spans(np.arange(len(run_at)), run_begin[w], runs_of[w])
            rows.append(
                (p, key[w].tobytes(), piece[s].tobytes(), hot[s].tobytes(), runs_of[w].astype(np.uint8).tobytes(),
                 run_size[r].astype(np.uint8).tobytes(), found[run_at[r]].tobytes())
            )
    return table_of(FOUND, rows)


def repeated_spans(plan: Plan, window: int, carried: list[str], columns: tuple[str, ...]) -> DataFrame:
    """For every row, what is removed and what is left; copies of whole texts need no search."""
    groups = plan.groups

    def pieces(docs: pa.Table, back: pa.Table) -> pa.Table:
        give_back()
        if not docs.num_rows or not back.num_rows:
            return PIECES.empty_table()
        part = docs.column("part")[0].as_py()
        docs, back, _ = without_copies(docs, back)
        if not docs.num_rows:
            return PIECES.empty_table()
        of, seeds, times = seed_keys(back, groups)
        got = []
        for c in chunks(docs, byte_chunk):
            start, size, key, is_hot = candidates(c, window, GRAM, of, seeds, times)
            piece, doc = piece_ids(c.raw, start, size, window), c.ids[c.doc[start]]
            order = np.lexsort((doc, piece))
            first = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0]) if len(order) else order
            last = np.r_[first[1:], len(order)] - 1
            pick = order[first]
            content = take_spans(c.raw, start[pick], size[pick] + window - 1)
            got.append((piece[pick], key[pick], doc[pick], doc[order[last]] if len(order) else doc, size[pick], is_hot[pick], content))
        piece, key, least, most, size, is_hot, content = (np.concatenate(x) for x in zip(*got, strict=True))
        length = size + window - 1
        where = np.cumsum(length) - length
        order = np.argsort(piece, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0]) if len(order) else order
        if len(order):
            least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
        pick = order[first]
        route = mix64(np.where(is_hot[pick], piece[pick], key[pick]))
        bucket = ((route >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(groups + 1))
        rows = []
        for b in np.unique(bucket).tolist():
            k = by[cut[b] : cut[b + 1]]
            p = pick[k]
            rows.append(
                (b, part, least[k].tobytes(), most[k].tobytes(),
                 size[p].astype(np.uint8).tobytes(), is_hot[p].tobytes(), take_spans(content, where[p], length[p]).tobytes())
            )
        return table_of(PIECES, rows)

    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        everything, out, order_of = docs, {c: [] for c in columns}, []

        def add(at: int, **row) -> None:
            order_of.append(at)
            for c in columns:
                out[c].append(row[c]() if callable(row[c]) else row[c])

        docs, found, gone = without_copies(docs.append_column("row", pa.array(np.arange(docs.num_rows))), found)
        for i, _ in gone:
            text = (everything.column("text")[i].as_py() or "").encode()
            cut = len(text) if len(text) >= window else 0
            add(
                i, id=everything.column("id")[i].as_py(), n_bytes=len(text), n_removed=cut, span_start=[0] if cut else [],
                span_length=[cut] if cut else [], kept=text[cut:], kept_text=lambda: text[cut:].decode(),
            )
        key, piece = joined(found.column("key"), np.uint64), joined(found.column("piece"), np.uint64)
        hot, n = joined(found.column("hot"), np.bool_), joined(found.column("n"), np.uint8).astype(np.int64)
        run, least = joined(found.column("run"), np.uint8).astype(np.int64), joined(found.column("least"), np.int64)
        begin = np.cumsum(n) - n
        order = np.argsort(piece, kind="stable")
        known = piece[order]
        cold_keys, hot_keys = np.unique(key[~hot]), np.unique(key[hot])
        for c in chunks(docs, byte_chunk):
            low = window_keys(c, window, GRAM)
            start, size = runs(low, window // 2)
            cold, warm = member(low[start], cold_keys), member(low[start], hot_keys)
            single = np.repeat(start[warm], size[warm]) + spread(size[warm])
            start = np.r_[start[cold], single]
            size = np.r_[size[cold], np.ones(len(single), np.int64)]
            pid = piece_ids(c.raw, start, size, window)
            hit = member(pid, known)
            start, at = start[hit], order[np.searchsorted(known, pid[hit])]
            r = take_spans(np.arange(len(run)), begin[at], n[at])
            piece_no = np.repeat(np.arange(len(at)), n[at])
            before = np.cumsum(run[r]) - run[r]
            inside = before - before[np.cumsum(n[at]) - n[at]][piece_no] if len(at) else before
            place = start[piece_no] + inside
            gone = least[r] < c.ids[c.doc[place]]
            cover = np.zeros(len(c.doc) + 1, np.int32)
            np.add.at(cover, place[gone], 1)
            np.add.at(cover, place[gone] + run[r][gone] + window - 1, -1)
            mask = np.cumsum(cover[:-1]) > 0
            last = np.r_[c.first[1:], len(mask)]
            text = c.raw[: len(mask)]
            for i, (a, b) in enumerate(zip(c.first.tolist(), last.tolist(), strict=True)):
                m = mask[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
                spans = edge.reshape(-1, 2)
                kept = text[a:b].tobytes() if not len(spans) else text[a:b][~m].tobytes()
                size = spans[:, 1] - spans[:, 0]
                add(
                    docs.column("row")[c.rows.start + i].as_py(), id=docs.column("id")[c.rows.start + i].as_py(), n_bytes=b - a,
                    n_removed=int(size.sum()), span_start=spans[:, 0].tolist, span_length=size.tolist, kept=kept,
                    kept_text=lambda: kept.decode(errors="ignore"),
                )
        rest = everything.select([f"c{i}" for i in range(len(carried))]).take(pa.array(order_of, pa.int64()))
        return pa.Table.from_arrays(
            [*(pa.array(out.pop(c), OUT.field(c).type) for c in columns), *rest.columns], [*columns, *rest.column_names]
        )

    by_part = plan.docs.groupBy("part")
    sent = by_part.cogroup(plan.seeds.groupBy("part")).applyInArrow(pieces, _sql(PIECES))
    found = (
        sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(lambda t: least_ids(t, window), _sql(FOUND))
    )
    told = found.unionByName(plan.copies, allowMissingColumns=True)
    return by_part.cogroup(told.groupBy("part")).applyInArrow(
        remove,
        ", ".join(
            [f"{c} {OUT_SQL.get(c, 'long')}" for c in columns] + [f"c{i} {kind}" for i, kind in enumerate(carried)]
        ),
    )


OUT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
     ("span_start", pa.list_(pa.int64())), ("span_length", pa.list_(pa.int64())), ("kept", pa.binary()), ("kept_text", pa.string())]
)
OUT_SQL = {"span_start": "array<long>", "span_length": "array<long>", "kept": "binary", "kept_text": "string"}


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: tuple[str, ...] = (),
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """Remove every byte of a string of ``window`` bytes that also starts in a document with a smaller id.

    Returns per row of ``docs``: ``id``, ``n_bytes``, ``n_removed``,
    ``span_start`` and ``span_length`` (maximal removed runs), ``kept`` (the
    remaining bytes; a cut may part a character), ``kept_text`` (the same
    without parts of characters) and the columns named in ``carry``. With
    ``columns`` only these of the first seven are made and sent.

    Strings are judged on the input, matches never cross documents and overlaps
    count. Null text is empty. A null id counts as larger than all others. Rows
    with equal ids leave each other alone. Other columns are ignored, whatever
    their names; empty input gives no rows. ``window`` must be 32 to 255.
    """
    if not 32 <= window <= 255:
        raise ValueError("window must be 32 to 255 bytes")
    plan = recurring(docs, id_col, text_col, window, GRAM, byte_chunk, carry)
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    columns = tuple(OUT.names) if columns is None else columns
    got = repeated_spans(plan, window, kinds, columns)
    return got.select(*columns, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


__all__ = ["remove_repeats", "Chunk"]
