"""Quality scores from a weak-label model.

Overlapping heuristic labellers vote good, bad or not at all. Expectation
maximisation over the counts of vote patterns estimates how often each labeller
is right, and gives every pattern a probability of good text. These posteriors
train a linear scorer on hashed word shapes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import mix64
from stockweave.llm.html_extract import STOP_WORDS
from stockweave.llm.phrase_dedup import gram_hash, word_hash, word_spans
from stockweave.llm.seeds import member

SLOTS = 1024  # hashed features
SAMPLE = 8_000  # documents the scorer is fitted on, at most
CHUNK_BYTES = 1 << 20
GRAM = 6
LOWER_BIT, OTHER_BIT, UPPER_BIT, DIGIT_BIT, MARK_BIT, SYMBOL_BIT = 1, 2, 4, 8, 16, 32
CLASS = np.full(256, SYMBOL_BIT, np.uint8)
CLASS[97:123], CLASS[128:], CLASS[65:91], CLASS[48:58] = LOWER_BIT, OTHER_BIT, UPPER_BIT, DIGIT_BIT
CLASS[[ord(c) for c in ".,;:!?()'\"-"]] = MARK_BIT
CLASS[[32, *range(9, 14)]] = 0
TRUST = 0.99  # share of votes on good text that are right, before any data
CLEAN = 0.999  # probability of good, before any data, of a pattern without a bad vote; junk rarer than the rest of it drowns
LABELLERS = ("capitals", "symbols", "stutter", "loops", "stop_words", "sentences", "word_length")


def _stop_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(sorted(STOP_WORDS)).encode(), np.uint8)
    return np.sort(word_hash(raw, *word_spans(raw)))


STOPS = _stop_hashes()


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document the number of words and its labellers' measures; per word its document and shape."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = word_spans(raw)
    n_docs = len(texts)
    first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))
    n = np.diff(np.r_[first, len(start)])
    doc = np.repeat(np.arange(n_docs), n)
    if not len(start):
        return n, np.zeros((n_docs, len(LABELLERS))), doc, np.zeros(0, np.int64)
    folded = raw.copy()
    folded[(raw >= 65) & (raw < 91)] += 32
    words = word_hash(folded, start, end)
    bits = np.bitwise_or.reduceat(CLASS[raw], start)
    stutter = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
    grams = gram_hash(words, GRAM)
    grams = np.r_[grams, np.zeros(len(words) - len(grams), np.uint64)]
    inside = np.r_[doc[GRAM - 1 :] == doc[: len(doc) - GRAM + 1], np.zeros(min(GRAM - 1, len(doc)), bool)]
    order = np.lexsort((np.arange(len(doc)), grams, doc))
    same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    loop = np.zeros(len(doc), bool)
    loop[order[1:]] = same
    loop &= inside
    capital = (bits & UPPER_BIT > 0) & (bits & LOWER_BIT == 0) & (end - start > 1)
    stop = raw[end - 1] == ord(".")
    per = [capital, bits & SYMBOL_BIT > 0, stutter, loop, member(words, STOPS), stop, end - start]
    share = np.stack([np.bincount(doc, weights=x, minlength=n_docs) for x in per], axis=1) / np.maximum(n, 1)[:, None]
    length = np.minimum(end - start, 15).astype(np.int64)
    tail = CLASS[raw[end - 1]].astype(np.int64)
    shape = bits.astype(np.int64) | tail << 6 | length << 12 | stutter.astype(np.int64) << 16 | loop.astype(np.int64) << 17
    return n, share, doc, shape


def vote_codes(n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Votes of all labellers as one number in base 3: 0 bad, 1 good, 2 no vote."""
    caps, symbols, stutter, loops, stops, sentences, length = share.T
    some, many = n >= 8, n >= 30
    votes = [
        np.where(caps > 0.5, 0, np.where(caps < 0.15, 1, 2)),
        np.where(symbols > 0.15, 0, np.where(symbols < 0.05, 1, 2)),
        np.where(some & (stutter > 0.2), 0, np.where(stutter < 0.03, 1, 2)),
        np.where(some & (loops > 0.3), 0, np.where(loops < 0.1, 1, 2)),
        np.where(some & (stops >= 0.12), 1, np.where(many & (stops < 0.04), 0, 2)),
        np.where(some & (sentences >= 0.02) & (sentences <= 0.3), 1, np.where(many & (sentences == 0), 0, 2)),
        np.where((length >= 3) & (length <= 10), 1, np.where(some & ((length < 2) | (length > 14)), 0, 2)),
    ]
    code = np.zeros(len(n), np.int64)
    for v in votes:
        code = code * 3 + v
    return np.where(n > 0, code, -1)


def decode(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1)


def expectation_maximisation(codes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for each vote pattern, each labeller's rates of a good vote, prior.

    Rates are for good and for bad text. A labeller that votes bad is taken to
    have seen a defect, so patterns without such a vote start as likely good,
    and false alarms on good text are expected to be rare (``TRUST`` counts as
    much as the data).
    """
    votes = decode(codes)
    cast = votes < 2
    good = np.where((votes == 0).any(axis=1), 0.1, CLEAN)
    for _ in range(rounds):
        w = np.stack([good * count, (1 - good) * count])
        prior = (w[0].sum() + 1) / (w.sum() + 2)
        rate = np.stack([((x[:, None] * (votes == 1)).sum(0) + 0.1) / ((x[:, None] * cast).sum(0) + 0.2) for x in w])
        rate[0] = (rate[0] + TRUST) / 2
        # defects: good text may not earn more bad votes than bad text does
        rate[0] = np.maximum(rate[0], rate[1])
        logs = [
            np.log(p) + (cast * np.where(votes == 1, np.log(r), np.log1p(-r))).sum(axis=1)
            for p, r in zip((prior, 1 - prior), rate, strict=True)
        ]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            good = new
            break
        good = new
    return good, rate, float(prior)


def features(n: np.ndarray, doc: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Shares of hashed word shapes and shape pairs, one row per document."""
    x = np.zeros((len(n), SLOTS), np.float32)
    if len(doc):
        one = mix64(shape.astype(np.uint64) + np.uint64(1))
        pair = mix64(one[1:] ^ (one[:-1] >> np.uint64(7)))
        slots = np.concatenate([one, pair[doc[1:] == doc[:-1]]]) % np.uint64(SLOTS)
        rows = np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]])
        x += np.bincount(rows * SLOTS + slots.astype(np.int64), minlength=x.size).reshape(x.shape)
    return np.sqrt(x / np.maximum(n, 1)[:, None])


def fit_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 250, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last one the constant) for soft labels, by adaptive gradient steps."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        e = ((p - good) / max(len(good), 1)).astype(np.float32)
        g = np.r_[e @ x + np.float32(decay) * w[:-1], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def text_batches(column, size: int = CHUNK_BYTES):
    """Texts of a column as bytes, in pieces of bounded size."""
    held, total = [], 0
    for v in column:
        held.append((v.as_py() or "").encode())
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def score_quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """Quality of every row of ``docs``: all its columns, and ``quality`` (0 to 1) and ``good``.

    Vote patterns are counted over all documents. The scorer is fitted on at
    most ``sample`` documents, those with the least hash of the text; their
    feature rows are made in tasks, and no text reaches the driver.

    Null and empty texts and texts of white space have quality 0. Repeated rows
    repeat. A quality equal to ``threshold`` is good. Columns that had the result's
    names are replaced; empty input gives no rows.
    """

    def cast(batches):
        for b in batches:
            codes = np.concatenate([vote_codes(*measures(t)[:2]) for t in text_batches(b.column(0))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(codes)], ["code"])

    def rows_of(batches):
        for b in batches:
            h, a = b.column(0), 0
            for texts in text_batches(b.column(1)):
                n, share, doc, shape = measures(texts)
                x = pa.array([r.tobytes() for r in features(n, doc, shape).astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([h.slice(a, len(texts)), pa.array(vote_codes(n, share)), x], ["h", "code", "x"])
                a += len(texts)

    patterns = docs.select(docs[text_col]).mapInArrow(cast, "code long").filter("code >= 0").groupBy("code").count()
    rows = patterns.orderBy("code").collect()  # at most 3 ** 7 patterns
    codes, count = (np.array([r[c] for r in rows], np.int64) for c in ("code", "count"))
    kept = [c for c in docs.columns if c.lower() not in ("quality", "good")]
    if len(codes):
        good, _, _ = expectation_maximisation(codes, count)
        some = docs.select(docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h")).filter("text is not null")
        last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        texts = some.filter(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text"))
        fit = texts.select("h", "text").mapInArrow(rows_of, "h long, code long, x binary").filter("code >= 0").toArrow().sort_by("h")
        x = np.concatenate([np.zeros(0, np.float32)] + [np.frombuffer(v.as_buffer(), np.float32) for v in fit["x"]])
        label = good[np.searchsorted(codes, fit["code"].to_numpy())]
        weights = fit_scorer(x.reshape(-1, SLOTS), label) if len(label) else np.zeros(SLOTS + 1)
    else:
        weights = np.zeros(SLOTS + 1)

    @F.pandas_udf("double")
    def quality(column: pd.Series) -> pd.Series:
        out = []
        for t in text_batches(pa.array(column, pa.string())):
            for k in range(0, len(t), 500):
                n, _, doc, shape = measures(t[k : k + 500])
                z = features(n, doc, shape) @ weights[:-1] + weights[-1]
                out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.select(*kept, quality(docs[text_col]).alias("quality"))
    return scored.withColumn("good", F.col("quality") >= threshold)
