"""Packing token sequences into fixed windows by best-fit decreasing.

Documents are tokenised and packed inside the task that reads them, so no text
and no token leaves its partition: there is no shuffle. A task works in shards
of a bounded number of tokens.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SHARD_TOKENS = 4_000_000  # tokens a task holds at once
LOOSE = 64  # a window counts as loose when more than window / LOOSE places stay free
# Scripts for which the rank encoder was compared with the tokenizer file id by id.
OTHER_SCRIPTS = re.compile("[^\x00-ɏ‐-‧]")


class FreeSpace:
    """Open windows by remaining capacity, under a segment tree of counts.

    Leaf ``c`` counts the open windows with exactly ``c`` free places. The
    tightest window for ``n`` tokens is the first non-empty leaf from ``n``.
    """

    def __init__(self, window: int):
        self.base = 1 << (window + 1 - 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, free: int, by: int) -> None:
        i = self.base + free
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window_no: int, free: int) -> None:
        self.open[free].append(window_no)
        self._add(free, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """The fullest window with ``n`` free places and its free places, removed."""
        i, count = self.base + n, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i ^ 1]):
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.base
        self._add(free, -1)
        return self.open[free].pop(), free


def pack_lengths(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); every token in one piece.

    Overlong documents give full windows first. The rests go in falling length
    to the tightest open window. At the end the emptiest loose windows are cut
    to fill the other loose ones, which leaves one loose window at most.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full = n // window
        out.extend([(d, k * window, window)] for k in range(full))
        if n % window:
            rests.append((d, full * window, n % window))
    rests.sort(key=lambda p: -p[2])
    free, first, room = FreeSpace(window), len(out), []
    for piece in rests:
        got = free.take(piece[2])
        if got is None:
            out.append([piece])
            room.append(window - piece[2])
            no = len(out) - 1
        else:
            no = got[0]
            out[no].append(piece)
            room[no - first] = got[1] - piece[2]
        if room[no - first]:
            free.put(no, room[no - first])
    loose = sorted((i for i, r in enumerate(room) if r * LOOSE > window), key=lambda i: room[i])
    a, b = 0, len(loose) - 1
    while a < b:
        i, j = loose[a], loose[b]
        source = out[first + j]
        if not source:
            b -= 1
        elif not room[i]:
            a += 1
        else:
            d, start, n = source.pop()
            k = min(n, room[i])
            out[first + i].append((d, start, k))
            room[i] -= k
            room[j] += k
            if k < n:
                source.append((d, start + k, n - k))
    return [w for w in out if w]


class Encoder:
    """Token ids as the tokenizer file gives them.

    The rank file holds the same vocabulary and is several times faster. It is
    used for texts of the scripts compared; texts with other characters or with
    the string of a special token go through the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        plain = text.isascii() or not OTHER_SCRIPTS.search(text)
        if self.fast and plain and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    end_id: int = 0,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Sequences of at most ``window`` tokens with little padding; one row per piece.

    A document is its token ids and then ``end_id``. Columns: the id, ``start``
    (ids of the document before the piece), ``length``, ``doc_tokens``,
    ``sequence_id`` (unique, not consecutive), ``offset`` (gapless in the
    sequence) and ``ids`` (unsigned 32-bit, little-endian).

    Null and empty texts are one ``end_id``. Repeated rows are packed once
    each. Other columns are ignored, whatever their names. Empty input gives no
    rows. A text of any length is cut into windows; only its own ids are held.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder(tokenizer, ranks)
        task, sequence = TaskContext.get().partitionId() << 36, 0
        names: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush():
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for pieces in pack_lengths([len(x) for x in held], window):
                at = 0
                for d, start, n in pieces:
                    row = (names[d], start, n, len(held[d]), task + sequence, at, held[d][start : start + n].tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += n
                sequence += 1
                if len(cols[0]) >= 4000:
                    yield batch(cols)
                    cols = [[] for _ in range(7)]
            if cols[0]:
                yield batch(cols)

        def batch(cols):
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        id_type = pa.null()
        for b in batches:
            id_type = b.column(0).type
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                ids = encoder.ids(text) if text else []
                ids.append(end_id)
                held.append(np.array(ids, dtype="<u4"))
                names.append(b.column(0)[i].as_py())
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield from flush()
                    held, names, tokens = [], [], 0
        if held:
            yield from flush()

    plain = docs.select(docs[id_col], docs[text_col])
    return plain.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
