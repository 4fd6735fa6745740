"""Alignment of the token ids of two tokenizers.

A document is tokenised whole by both. Where a token of either that begins with
a space starts at the same byte, the ends before it are shared, so the document
falls into windows, about one a word, that can be aligned on their own. The
same pairs of id tuples come again and again: their alignment is kept, as the
text of its groups, its links and its bytes, and looked up.
"""

from __future__ import annotations

import base64
import gc
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import stored
from stockweave.llm.packing import OTHER_SCRIPTS
from stockweave.llm.seeds import take_spans

KEPT = 200_000  # windows a task keeps, at most; later ones are aligned each time
LONGEST = 16  # ids of a kept window, each side
TOGETHER = 1 << 15  # ids of documents aligned together, about
SEND = 8 << 20  # bytes of groups that travel together, about
PAIRS = 2_000_000  # counted id pairs that are broadcast, at most (about 100 bytes each there)


class Side:
    """Token bytes, lengths and space marks of a vocabulary by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        width = len(str(len(tokens) - 1)) + 1
        names = [str(i).encode().ljust(width, b"\0") for i in range(len(tokens))]
        self.names = np.frombuffer(b"".join(names), np.uint8).reshape(-1, width)  # ids as text, with a place for a mark
        self.end = (self.names > 0).sum(axis=1)

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ByteLevel:
    """Ids of a byte-level tokenizer file, special strings as plain text, and the bytes of its tokens.

    The rank file has the same vocabulary and is several times faster; it is
    used for the scripts it was compared for. The tokenizer file is read when
    a text needs it, or when there is no rank file.
    """

    def __init__(self, file: str, ranks: str | None):
        self.file, self.fast, self.exact = file, None, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
            self.tokens = [b""] * (max(table.values()) + 2)
            for token, i in table.items():
                self.tokens[i] = token
        else:
            vocabulary, of = self.tokenizer().get_vocab(), self.spelled()
            self.tokens = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.tokens[i] = bytes(of.get(c, 0) for c in token)

    @staticmethod
    def spelled() -> dict[str, int]:
        """Bytes by the characters of the vocabulary: printable Latin-1 is itself, the others in order from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokenizer(self):
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
            self.exact.encode_special_tokens = True
        return self.exact

    def ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or not OTHER_SCRIPTS.search(text)):
            return self.fast.encode_ordinary(text)
        return self.tokenizer().encode(text, add_special_tokens=False).ids


class Tokenizers:
    """Both tokenizers: ids of a text, and what the ids stand for."""

    def __init__(self, first: str, ranks: str | None, second: str):
        import sentencepiece

        encoder = ByteLevel(first, ranks)
        self.first_ids, self.first = encoder.ids, Side(encoder.tokens)
        pieces = sentencepiece.SentencePieceProcessor(model_file=second)
        self.second_ids = lambda text: pieces.encode(text, num_threads=1)
        self.second = Side(
            [
                bytes([int(pieces.id_to_piece(i)[3:5], 16)])
                if pieces.is_byte(i)
                else pieces.id_to_piece(i).replace("▁", " ").encode()
                for i in range(pieces.get_piece_size())
            ]
        )

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a space and the text, not compared with it."""
        return self.first_ids(" " + text), self.second_ids(text)

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a space and the text; None where the bytes of either are not these."""
        raw = (" " + text).encode()
        a, b = self.encoded(text)
        for ids, side in ((a, self.first), (b, self.second)):
            if side.spelled(ids) != raw:
                return None
        return a, b


def shared_ends(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the token lengths of both sides: which tokens end at a shared end."""
    x, y = np.cumsum(first), np.cumsum(second)
    at, to = np.searchsorted(y, x), np.searchsorted(x, y)
    return y[np.minimum(at, len(y) - 1)] == x, x[np.minimum(to, len(x) - 1)] == y


class Aligner:
    """Aligns documents window by window; windows of the same ids are aligned once.

    Some documents are taken together, end to end: the windows of each are its
    own, and arrays of a few words cost more to call for than to work on.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.kept: dict[bytes, tuple[bytes, bytes, bytes]] = {}  # groups as text, links and bytes by the ids of both sides

    def cuts(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers on both sides where windows begin, and the ends; documents begin at ``first_a`` and ``first_b``."""

        def marks(side, ids, begin):
            spaced = side.spaced[ids]
            spaced[begin] = True
            at = np.flatnonzero(spaced)
            length = side.length[ids]
            return at, (np.cumsum(length) - length)[at]

        (ia, at), (ib, to) = marks(self.of.first, a, first_a), marks(self.of.second, b, first_b)
        k = np.minimum(np.searchsorted(to, at), len(to) - 1)
        shared = to[k] == at
        return np.r_[ia[shared], len(a)], np.r_[ib[k[shared]], len(b)]

    def keys(self, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[bytes]:
        """Ids of each window in one run of bytes: of the first side, then of the second, numbered behind the first."""
        out = np.empty(len(a) + len(b), np.int32)
        out[np.arange(len(a)) + np.repeat(cb[:-1], np.diff(ca))] = a
        out[np.arange(len(b)) + np.repeat(ca[1:], np.diff(cb))] = b + np.int32(len(self.of.first.tokens))
        raw = out.tobytes()
        return [raw[i:j] for i, j in pairwise((4 * (ca + cb)).tolist())]

    def new_windows(self, found: list, keys: list[bytes], a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> None:
        """Align the windows that are not kept, end to end: both sides of a window are equally long.

        Windows whose sides have different bytes stay without an alignment.
        """
        new = [n for n, got in enumerate(found) if got is None]
        if not new:
            return
        first, second = self.of.first, self.of.second
        size_a, size_b = np.diff(ca)[new], np.diff(cb)[new]
        own_a, own_b = take_spans(a, ca[new], size_a), take_spans(b, cb[new], size_b)
        spelled = first.spelled(own_a.tolist())
        other = second.spelled(own_b.tolist())
        equal = spelled == other
        bytes_a, bytes_b = first.length[own_a], second.length[own_b]
        ends_a, ends_b = shared_ends(bytes_a, bytes_b)
        text = self.text(own_a, own_b, ends_a, ends_b)
        links = (own_a[ends_a].astype(np.int64) << 32 | own_b[ends_b]).tobytes()
        last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        ends = (
            (np.cumsum(first.end[own_a] + 1)[last_a] + np.cumsum(second.end[own_b] + 1)[last_b]).tolist(),
            (8 * np.cumsum(ends_a)[last_a]).tolist(),
            np.cumsum(bytes_a)[last_a].tolist(),
        )
        short = ((size_a <= LONGEST) & (size_b <= LONGEST)).tolist()
        i = j = k = 0
        for n, p, q, r, keep in zip(new, *ends, short):
            if equal or spelled[k:r] == other[k:r]:
                got = found[n] = text[i:p], links[j:q], spelled[k:r]
                if keep and len(self.kept) < KEPT:
                    self.kept[keys[n]] = got
            i, j, k = p, q, r

    def align(self, a: list[int], b: list[int]) -> tuple[str, np.ndarray] | None:
        """:meth:`align_all` of one document."""
        return self.align_all([(a, b, None)])[0]

    def align_all(self, docs: list[tuple[list[int], list[int], bytes | None]]) -> list[tuple[str, np.ndarray] | None]:
        """For each document (ids of both sides and its bytes) its groups as text and a link (both ids in one number)
        for each; None where the bytes of either side are not these, or not the same where none are given."""
        x, y = (np.concatenate([np.frombuffer(array("i", d[side]), np.int32) for d in docs]) for side in (0, 1))
        size_a, size_b = (np.array([len(d[side]) for d in docs]) for side in (0, 1))
        total = lambda length, size: np.diff(np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(size)]])
        bytes_a = total(self.of.first.length[x], size_a)
        fits = (bytes_a == total(self.of.second.length[y], size_b)) & (bytes_a > 0)
        if not fits.all():  # only documents of equally long sides can lie end to end
            rest = iter(self.align_all([d for d, fit in zip(docs, fits) if fit]) if fits.any() else [])
            return [next(rest) if fit else None for fit in fits]
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        ca, cb = self.cuts(x, y, first_a, first_b)
        keys = self.keys(x, y, ca, cb)
        found = list(map(self.kept.get, keys))
        self.new_windows(found, keys, x, y, ca, cb)
        edges = np.r_[np.searchsorted(ca, first_a), len(ca) - 1].tolist()
        out = []
        for (_, _, raw), i, j in zip(docs, edges, edges[1:]):
            own = found[i:j]
            if None in own or raw is not None and b"".join([f[2] for f in own]) != raw:
                out.append(None)
            else:
                links = np.frombuffer(b"".join([f[1] for f in own]), np.int64)
                out.append((b"".join([f[0] for f in own])[:-1].decode(), links))
        return out

    def text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2;``: ids in order of their groups, each followed by its mark."""
        last_a, last_b = np.flatnonzero(ends_a) + 1, np.flatnonzero(ends_b) + 1
        sizes_a, sizes_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        at_a = np.arange(len(a)) + np.repeat(last_b - sizes_b, sizes_a)
        at_b = np.arange(len(b)) + np.repeat(last_a, sizes_b)
        first, second = self.of.first, self.of.second
        out = np.zeros((len(a) + len(b), max(first.names.shape[1], second.names.shape[1])), np.uint8)
        out[at_a, : first.names.shape[1]] = first.names[a]
        out[at_b, : second.names.shape[1]] = second.names[b]
        out[at_a, first.end[a]] = np.where(ends_a, ord("|"), ord(","))
        out[at_b, second.end[b]] = np.where(ends_b, ord(";"), ord(","))
        return out[out > 0].tobytes()


def align(
    docs: DataFrame, first: str, second: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Both tokenizers' ids of each document in groups that end at the same byte.

    ``first`` is a byte-level tokenizer file, which encodes a space and the
    text (``ranks`` holds the same vocabulary and is faster); ``second`` a
    sentencepiece model that puts the space itself. Columns: the id,
    ``n_a``, ``n_b`` (tokens), ``n_groups``, ``groups`` (``a1,a2|b1;a3|b2``),
    and the document's distinct links, the last ids of a group as ``a << 32 | b``
    in ``links``, with how often each occurs in ``times``.

    Null and empty texts, and texts whose joined token bytes on either side are
    not a space and the text, have no tokens and groups ''. Strings of special
    tokens are plain text. Repeated rows are aligned each on their own. Rows
    stay where they are; other columns are ignored. A long text's ids are held
    at once, in the task that reads it. Empty input gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "groups", "links", "times"]

    def run(batches):
        aligner = None
        gc.disable()  # nothing here refers to itself, and scans of the kept windows take a tenth of the time
        for batch in batches:
            aligner = aligner or Aligner(Tokenizers(first, ranks, second))
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            rows, held, some, size = [], 0, [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                some.append((*aligner.of.encoded(text), (" " + text).encode()) if text else None)
                size += len(some[-1][0]) if text else 1
                if size < TOGETHER and i + 1 < batch.num_rows:
                    continue
                full = [d for d in some if d]
                got = iter(aligner.align_all(full) if full else [])
                for d in some:
                    groups, links = (d and next(got)) or ("", None)
                    if links is None:
                        rows.append((0, 0, 0, "", [], []))
                        continue
                    pairs, times = np.unique(links, return_counts=True)
                    rows.append((len(d[0]), len(d[1]), len(links), groups, pairs, times.astype(np.int32)))
                    held += len(groups)
                some, size = [], 0
                if held > SEND or i + 1 == batch.num_rows:
                    at = i + 1 - len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(rows)), *[pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]], names
                    )
                    rows, held = [], 0

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """Links of the whole corpus by id pair (``pair``, ``count``); each task adds up its own first."""

    def add(batches):
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            more = b.column(0).flatten().to_numpy(zero_copy_only=False)
            times = b.column(1).flatten().to_numpy(zero_copy_only=False)
            pairs, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times]), len(pairs)).astype(np.int64)
            if len(pairs) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])

    part = links.select("links", "times").mapInArrow(add, "pair long, count long")
    return part.groupBy("pair").agg(F.sum("count").alias("count"))


def link_scores(found: DataFrame, broadcast_pairs: int = PAIRS) -> DataFrame:
    """``n_links``, ``n_best`` and ``count_sum`` of each row of ``found`` (``row``, ``links``, ``times``).

    A pair's count is over the whole corpus; a link is best if no pair with its
    second id has a higher count. Up to ``broadcast_pairs`` pairs, as counted,
    are broadcast; more are joined by shuffle, where adaptive execution splits
    common pairs.
    """
    pairs = stored(pair_counts(found), "alignment-pairs")
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    scored = pairs.select("pair", "count", (F.col("count") == most).alias("best"))
    each = found.select("row", F.explode(F.arrays_zip("links", "times")).alias("link"))
    each = each.select("row", F.col("link.links").alias("pair"), F.col("link.times").cast("long").alias("times"))
    small = pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    joined = each.join(F.broadcast(scored) if small else scored, "pair")
    return joined.groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )


def aligned_documents(
    docs: DataFrame, first: str, second: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = PAIRS
) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    The cases of :func:`align` hold; rows without tokens have zeros and ''.
    """
    found = align(docs, first, second, ranks, id_col=id_col, text_col=text_col)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = found.withColumn("groups", sha).withColumnsRenamed({id_col: "id", "groups": "groups_sha256"})
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "alignment-links")
    scores = link_scores(found, broadcast_pairs)
    got = found.drop("links", "times").join(scores, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
