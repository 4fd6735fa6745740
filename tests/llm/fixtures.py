"""Small corpora with every awkward case, and plain versions of the operators."""

import hashlib
import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("part", "id", "shard", "n", "words")]
)


def corpus(seed=1, n=60):
    """(id, text): copies, near copies, shared passages, loops, short, empty and null texts, a long one."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 10
        if kind < 4 or not out:
            t = text(rng.randint(5, 120))
        elif kind == 4:
            t = rng.choice(out)[1] or ""
        elif kind == 5:
            w = (rng.choice(out)[1] or text(40)).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = "\n".join([" ".join(w[:7]), " ".join(w[7:])])
        elif kind == 6:
            t = text(rng.randint(0, 30)) + "\t" + passage + " " + text(rng.randint(0, 30))
        elif kind == 7:
            t = " ".join([rng.choice(vocab)] * rng.randint(1, 80))
        elif kind == 8:
            t = rng.choice(["", None, " \n ", "a", text(3), text(4).upper(), passage])
        else:
            t = text(12) + " " + passage.upper()
        out.append((i * 7 % 1000, t))
    out.append((5, text(4000)))
    out.append((10**12, out[-1][1]))
    return out


def frame(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "1", "w") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def passages_removed(rows, window):
    """Words left of each row, by trying every window in order of (id, start)."""
    first, out = {}, []
    top = [(float("inf") if i is None else i, words(t)) for i, t in rows]
    for i, w in top:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in top:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def strings_removed(rows, window):
    """Bytes left of each row, by trying every string of ``window`` bytes."""
    first, out = {}, []
    top = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in top:
        for s in range(len(b) - window + 1):
            key = b[s : s + window]
            first[key] = min(first.get(key, i), i)
    for i, b in top:
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = [True] * window
        out.append((len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text):
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows, percent=80):
    """Least id reachable by links, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [(len(sets[i]), least.get(find(i))) for i in range(len(rows))]
