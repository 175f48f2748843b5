"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words and word beginnings, which hold the stem of an inflected insult. The machine scores ``b + sum(w_i) + sum over pairs <v_i, v_j>``: the linear weights learn
single insults, the factors learn pairs, such as an insult together with a group's name. It is fitted in NumPy on a bounded sample
of labelled rows and applied to whole texts on the executors; only the model is broadcast, and its size is fixed by BUCKETS.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import ship

#: Hashed terms: bounds the model.
BUCKETS = 1 << 20
#: Labelled rows that the fit may use, those with the smallest hashes: bounds the driver's share.
SAMPLE_ROWS = 8_000
#: Factors of a term.
RANK = 4
#: Sample documents that must hold a term before it gets weights.
LEAST_DOCS = 5
#: Standard errors by which a term's share of labels must differ from the sample's: what is near 0 would only add noise to long texts.
LEAST_Z = 3.5
#: Pairs of terms that chance alone may be expected to keep.
FALSE_PAIRS = 0.05
EPOCHS = 150
#: The score in logits of a text without any term is at most this, if most texts have label 0.
NO_TERM = -0.25
#: Lengths of the word beginnings that are terms too.
BEGINNINGS = (3, 4, 5, 6)
#: Words that a worker remembers the bucket of; the memory is emptied beyond it.
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")


class Terms:
    """Distinct hashed terms of texts, with a bounded memory of words already hashed."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask = buckets - 1
        self.seen: dict[str, tuple[int, ...]] = {}

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & self.mask

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for w in words.difference(seen):
            seen[w] = (self.bucket(w), *(self.bucket(f"{w[:n]}*") for n in BEGINNINGS if len(w) > n))
        out: set[int] = set()
        out.update(*map(seen.__getitem__, words))
        return np.sort(np.fromiter(out, np.int64, len(out)))


@dataclass
class FactorizationMachine:
    """terms: sorted buckets with weights; w: their linear weights; v: their factors, one row each."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The rows of those buckets that have weights."""
        if not len(self.terms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
        return at[self.terms[at] == buckets]

    def score(self, buckets: np.ndarray) -> float:
        own = self.rows(buckets)
        v = self.v[own]
        y = self.bias + self.w[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def _divergence(k: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """n times the divergence of the share k / n from q: by Chernoff, chance gives k or further from n * q with at most exp of its negative."""
    q = np.clip(q, 1e-12, 1 - 1e-12)
    return k * np.log(np.maximum(k, 1e-300) / (n * q)) + (n - k) * np.log(np.maximum(n - k, 1e-300) / (n * (1 - q)))


def telling_pairs(doc: np.ndarray, term: np.ndarray, y: np.ndarray, df: np.ndarray, least_docs: int) -> np.ndarray:
    """Which terms stand in a pair whose documents' share of label 1 lies beyond those of the sample, of either term and of their sum in logits.

    All pairs of terms with ``least_docs`` documents are tested, on bit sets; passed over are only terms that hold too few documents
    for any pair to differ beyond chance. Documents of equal terms must be given once.
    """
    found = np.zeros(len(df), bool)
    share, m = y.mean(), int((df >= least_docs).sum())
    if m < 2 or not 0 < share < 1:  # no pair, or no label to tell
        return found
    needed = np.log(m * (m - 1) / 2 / FALSE_PAIRS)
    positive = np.bincount(term[(y > 0)[doc]], minlength=len(df))
    own_share = positive / np.maximum(df, 1)
    # of label 1, and of both: what a pair of one label only must have
    least_positive, least_both = max(least_docs, needed / -np.log(share)), max(least_docs, needed / -np.log(1 - share))
    able = np.flatnonzero((df >= least_docs) & ((positive >= least_positive) | (df >= least_both)))
    at = np.full(len(df), -1, np.int32)
    at[able] = np.arange(len(able))
    use = at[term] >= 0
    rows, cols = at[term[use]], doc[use]
    # label 1 first: their words of 64 bits stand before the others'
    order, n_first = np.argsort(-y, kind="stable"), int(y.sum())
    words = -(-n_first // 64)
    place = np.empty(len(y), np.int64)
    place[order] = np.concatenate((np.arange(n_first), words * 64 + np.arange(len(y) - n_first)))
    bits = np.zeros((len(able), words + -(-(len(y) - n_first) // 64)), np.uint64)
    for k in range(0, len(rows), 1 << 18):
        where = place[cols[k : k + (1 << 18)]]
        np.bitwise_or.at(bits, (rows[k : k + (1 << 18)], where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
    del use, rows, cols
    # terms of the same documents (a word and its beginnings) are tested once
    _, one, same = np.unique(bits.view(np.dtype((np.void, bits.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    bits, every, able = bits[one], able, able[one]
    across = np.ascontiguousarray(bits.T)
    d, q = df[able], own_share[able]
    logit = np.log((positive[able] + share) / (d - positive[able] + 1 - share))

    def both(i: int, part: np.ndarray) -> np.ndarray:
        """How many of those documents hold term i and each later one."""
        out = np.zeros(len(able) - i - 1, np.uint16)
        for w in part:
            if w[i]:
                out += np.bitwise_count(w[i + 1 :] & w[i])
        return out

    for i in range(len(able) - 1):
        k = both(i, across[:words])
        few = k + both(i, across[words : 2 * words])  # no more documents than hold both
        # one label above the share of either: the fewer documents, the further; below: the more
        high, low = np.maximum(np.maximum(q[i], q[i + 1 :]), share), np.minimum(np.minimum(q[i], q[i + 1 :]), share)
        j = np.flatnonzero((k >= least_positive) & (k > few * high) | (d[i + 1 :] >= least_both) & (d[i] >= least_both))
        most = np.minimum(d[i], d[j + i + 1])
        kj, fj = k[j].astype(float), few[j].astype(float)
        j = j[(kj > fj * high[j]) & (_divergence(kj, np.maximum(fj, 1), high[j]) >= needed) | (kj < most * low[j]) & (_divergence(kj, most, low[j]) >= needed)]
        if not len(j):
            continue
        n = np.maximum(few[j] + np.bitwise_count(bits[j + i + 1, 2 * words :] & bits[i, 2 * words :]).sum(1), 1)
        k = k[j].astype(float)
        j += i + 1
        sums = 1 / (1 + np.exp(-(logit[i] + logit[j] - np.log(share / (1 - share)))))
        alone = np.stack((np.full(len(j), q[i]), q[j], np.full(len(j), share), sums))
        high, low = alone.max(0), alone.min(0)
        beyond = np.flatnonzero((n >= least_docs) & ((k > n * high) | (k < n * low)))
        k, n, j = k[beyond], n[beyond], j[beyond]
        hit = _divergence(k, n, np.where(k > n * high[beyond], high[beyond], low[beyond])) >= needed
        if hit.any():
            found[able[j[hit]]] = found[able[i]] = True
    found[every] = found[able][same]
    return found


def fit(samples: list[np.ndarray], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, Adam on whole passes, then soft thresholds on the linear weights and on each term's factors.

    The thresholds set the weights of terms that carry no signal to exactly 0, so long texts do not add up noise. Without rows of
    both labels the machine is the constant share of label 1.
    """
    y = np.asarray(labels, np.float64)
    none = np.empty(0, np.int64)
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(none, np.empty(0), np.empty((0, rank)), -30.0 if not len(y) or y[0] == 0 else 30.0)
    # counts by bucket, document by document; only terms of enough documents are numbered
    df = np.zeros(1 + max((int(s[-1]) for s in samples if len(s)), default=0), np.int64)
    for s in samples:
        df[s] += 1
    terms, number = np.flatnonzero(df >= least_docs), np.full(len(df), -1, np.int32)
    number[terms] = np.arange(len(terms))
    held = [own[own >= 0] for own in (number[s] for s in samples)]
    inverse, doc = np.concatenate(held), np.repeat(np.arange(len(samples), dtype=np.int32), [len(s) for s in held])
    df, positive = df[terms], np.zeros(len(terms))
    for s in (s for s, label in zip(held, y, strict=True) if label):
        positive[s] += 1
    share = y.mean()
    often = (df >= least_docs) & (np.abs(positive - df * share) >= least_z * np.sqrt(df * share * (1 - share)))
    # pairs that tell more than their terms alone; documents of equal terms count once, for copies are no further evidence
    once = np.zeros(len(samples), bool)
    once[list({(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), label): i for i, (s, label) in enumerate(zip(samples, y, strict=True))}.values())] = True
    df_once = np.zeros(len(terms), np.int64)
    for s in (s for s, first in zip(held, once, strict=True) if first):
        df_once[s] += 1
    del held
    single = once[doc]
    often |= telling_pairs((np.cumsum(once) - 1).astype(np.int32)[doc[single]], inverse[single], y[once], df_once, least_docs)
    new = np.cumsum(often) - 1
    use = often[inverse]
    cols, rows, terms = new[inverse[use]], doc[use], terms[often]
    n, m = len(samples), len(terms)
    rng = np.random.default_rng(seed)
    # each label weighs half
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, v, bias = np.zeros(m), rng.normal(0, 0.05, (m, rank)), 0.0
    by_col = np.argsort(cols, kind="stable")
    col_rows, col_start = rows[by_col], np.searchsorted(cols[by_col], np.arange(m))
    starts = np.searchsorted(rows, np.arange(n))
    filled = np.diff(np.append(starts, len(rows))) > 0

    def per_doc(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *x.shape[1:]))
        if filled.any():
            out[filled] = np.add.reduceat(x, starts[filled], axis=0)
        return out

    moments = [np.zeros(m), np.zeros(m), np.zeros((m, rank)), np.zeros((m, rank)), 0.0, 0.0]
    lr, b1, b2, l1 = 0.1, 0.9, 0.99, 5e-5
    for t in range(1, epochs + 1):
        s = np.stack([per_doc(np.ascontiguousarray(f)[cols]) for f in v.T], 1)  # factor by factor: the arrays are as long as all documents' terms
        q = per_doc((v**2).sum(1)[cols])
        z = bias + per_doc(w[cols]) + 0.5 * ((s**2).sum(1) - q)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.add.reduceat(g[col_rows], col_start) if m else np.zeros(0)
        gv = (np.stack([np.add.reduceat((g * f)[col_rows], col_start) for f in s.T], 1) - gw[:, None] * v) if m else v
        gb = g.sum()
        for i, grad in ((0, gw), (2, gv), (4, gb)):
            moments[i] = b1 * moments[i] + (1 - b1) * grad
            moments[i + 1] = b2 * moments[i + 1] + (1 - b2) * grad**2
        step = lambda i: lr * (moments[i] / (1 - b1**t)) / (np.sqrt(moments[i + 1] / (1 - b2**t)) + 1e-4)
        w = w - step(0)
        v = v - step(2)
        bias = float(bias - step(4))
        shrink = lambda i: lr * l1 / (np.sqrt(moments[i + 1] / (1 - b2**t)) + 1e-4)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink(0), 0)
        norm = np.sqrt((v**2).sum(1, keepdims=True))
        v = v * np.maximum(1 - shrink(2).mean(1, keepdims=True) / np.maximum(norm, 1e-12), 0)
    if share < 0.5:  # equal weights of the labels must not leave a text without any term in doubt
        bias = min(bias, NO_TERM)
    live = (np.abs(w) > 0) | (np.abs(v).sum(1) > 0)
    return FactorizationMachine(terms[live].astype(np.int64), w[live], v[live], bias)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on labelled rows that are not held out, at most ``sample_rows`` of them: those whose ids hash lowest.

    Rows with null ids or labels teach nothing; an id labelled more than once counts with its largest label. A whole text of the sample,
    however long, reaches the driver as its distinct terms: at most 4 bytes for each of BUCKETS.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "_f": [terms(t).astype(np.int32).tobytes() for t in b["_text"]]})

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # at most sample_rows rows
    # one row an id: a repeated one counts once
    got = texts.mapInPandas(hashed, "_id long, _y int, _f binary").dropDuplicates(["_id"]).toPandas().sort_values("_id")
    return fit([np.frombuffer(f, np.int32) for f in got["_f"]], got["_y"].to_numpy())


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts score as the machine's bias; null ids are held out; repeated rows are scored each; very long texts are taken
    whole. A score of exactly 0.5 is predicted 1. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, machine = Terms(), shared.value
        for b in batches:
            s = np.array([machine.score(terms(t)) for t in b["_text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    # ids pass through pandas as text: with a null among them it would make long integers floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    done = rows.mapInPandas(scored, "doc_id string, held_out boolean, score double, predicted int")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns.

    Null and empty texts score as the machine's bias; a score at the threshold goes; repeated rows go or stay together. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, machine = Terms(), shared.value
        for t in texts:
            yield pd.Series([machine.score(terms(x)) for x in t], dtype=float)

    return docs.where(score(F.col(f"`{text_col}`")) < threshold)
