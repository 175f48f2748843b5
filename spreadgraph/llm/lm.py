"""Language-model scores by a weighted backoff automaton.

Every n-gram of the training texts is counted, whatever its frequency. The states of the automaton are contexts; an arc of a state
reads a word that followed the context and weighs its smoothed log-probability; a failure arc leads to the context without its first
word and weighs the mass kept for words that did not follow. One traversal of a text from left to right carries the state and adds up.

Smoothing interpolates each order with the one below: P(w | h) = (c(hw) + m * P(w | h')) / (c(h) + m), down to the add-0.1 unigram;
c(h) is the context's own count and m, the pseudo-counts it leaves to the order below, is RATIO * c(h) but MASS at most: a rare context
keeps a fixed share for words not seen after it, a frequent one less and less. The model is never gathered anywhere: documents are scored in chunks, and a chunk builds the
part of the automaton that its texts can reach from the counts of its own n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadgraph.llm.chunks import bucket_bits, first_bits, in_chunks, key_bytes, open_answers, split_sides, tally, text_bytes
from spreadgraph.llm.hashing import LOWER, joined, mix, word_hashes, word_spans
from spreadgraph.storage import ship

ORDER = 2
#: Pseudo-counts that a context leaves to the order below: so many for each of its own, and at most.
RATIO = 3.0
MASS = 2000.0
#: Added to a unigram's count.
ADDED = 0.1
CHUNK_BYTES = 4 << 20
#: About how many n-grams a counting bucket holds.
BUCKET = 1_500_000

END = np.uint64(0xE0F0_1234_5678_9ABD)
START = np.uint64(0x5A5A_0F0F_1357_9BDF)
_GOLD = np.uint64(0x100000001B3)


class Tokens:
    """The tokens of a chunk's texts: each text's words and an end, with a start before it that is context only."""

    def __init__(self, texts: list[bytes], order: int):
        raw, begins = joined(texts)
        buf = LOWER[raw]
        starts, ends = word_spans(buf)
        w = word_hashes(buf, starts, ends)
        words = np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=len(texts))
        self.lengths = words + 1
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))  # of each text's tokens
        self.hashes = np.insert(w, np.cumsum(words), END)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        self.place = np.arange(len(self.hashes)) - self.first[self.owner]
        self.grams = [self.hashes]  # by order: the n-gram that ends at each token; one that would begin before the start is 0
        for n in range(2, order + 1):
            self.grams.append(np.where(self.place >= n - 2, mix(np.where(self.place >= n - 1, self._before(n - 1), START ^ np.uint64(n)) * _GOLD + self.grams[-1] + np.uint64(n)), np.uint64(0)))

    def _before(self, k: int) -> np.ndarray:
        return np.concatenate((np.zeros(min(k, len(self.hashes)), np.uint64), self.hashes[:-k] if k < len(self.hashes) else np.empty(0, np.uint64)))


def numbered_grams(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct words (and the end) and the distinct longer n-grams, both ascending, and by order the number of the n-gram that ends at each token.

    Words are numbered before longer n-grams; -1 stands for none.
    """
    words, first = np.unique(tokens.hashes, return_inverse=True)
    ids = [first]
    if len(tokens.grams) == 1:
        return words, np.empty(0, np.uint64), ids
    longer, at = np.unique(np.concatenate(tokens.grams[1:]), return_inverse=True)
    none = int(len(longer) > 0 and longer[0] == 0)  # n-grams that would begin before the start
    for part in np.split(at, len(tokens.grams) - 1):
        ids.append(np.where(part >= none, len(words) + part - none, -1))
    return words, longer[none:], ids


def taught_counts(tokens: Tokens, ids: list[np.ndarray], n: int, taught: np.ndarray) -> np.ndarray:
    """How often each n-gram ends in a text that the model learns from."""
    learn = taught[tokens.owner]
    return sum(np.bincount(i[learn & (i >= 0)], minlength=n) for i in ids)


def left_mass(seen: np.ndarray, mass: float, ratio: float) -> np.ndarray:
    """Pseudo-counts that contexts of these counts leave to the order below."""
    return np.minimum(mass, ratio * np.maximum(seen, 1))


class Automaton:
    """The part of the backoff automaton that one chunk can reach.

    States are the root (0), the start (1) and every context of the chunk's texts that the training texts hold. ``arc_key`` (state times
    words plus word, ascending) has an arc for each n-gram that they hold, and one at the root for every word; ``fail`` leads to the
    context without its first word.
    """

    def __init__(self, tokens: Tokens, ids: list[np.ndarray], counts: np.ndarray, words: int, total: int, distinct: int, starts: int, mass: float = MASS, ratio: float = RATIO):
        order = len(ids)
        self.width, self.word, self.order = words, ids[0], order
        self.count = counts[:words]
        self.base = np.log10((self.count + ADDED) / (total + ADDED * (distinct + 1)))
        state = np.full(len(counts) + 1, -1, np.int64)  # of an n-gram; the last entry stands for none
        contexts = np.unique(np.concatenate([i[i >= 0] for i in ids[: order - 1]] or [np.empty(0, np.int64)]))
        contexts = contexts[counts[contexts] > 0]
        state[contexts] = np.arange(2, 2 + len(contexts))
        seen = np.concatenate(([total, starts], counts[contexts])).astype(float)  # by state
        self.fail = np.zeros(len(seen), np.int64)
        below = left_mass(seen, mass, ratio)
        self.fail_weight = np.log10(below / (seen + below))
        p = 10 ** self.base[self.word]  # of each token, by contexts of rising length
        root = np.arange(words)
        keys, weights, to = [root], [self.base], [state[:words].clip(0)]
        self.before = np.zeros(len(self.word), np.int64)  # the state that reads each token
        for n in range(2, order + 1):
            source = state[np.concatenate(([-1], ids[n - 2][:-1]))]
            if n == 2:
                source = np.where(tokens.place == 0, 1 if starts else -1, source)
            source = np.where(tokens.place >= n - 2, source, -1)
            has = source >= 0
            self.before = np.where(has, source, self.before)
            own = np.where(ids[n - 1] >= 0, counts[ids[n - 1]], 0)
            p = np.where(has, (own + below[source] * p) / (seen[source] + below[source]), p)
            at = np.flatnonzero(has & (own > 0))
            key, one = np.unique(source[at] * words + self.word[at], return_index=True)
            at = at[one]
            target = np.zeros(len(at), np.int64)
            for k in range(min(n, order - 1)):  # the longest context that the n-gram ends in
                longer = state[ids[k][at]]
                target = np.where(longer >= 0, longer, target)
            keys.append(key)
            weights.append(np.log10(p[at]))
            to.append(target)
            if n < order:  # a longer context falls back to itself without its first word
                inner = np.where(ids[n - 1] >= 0, state[ids[n - 1]], -1)
                ok = np.flatnonzero(inner >= 0)
                shorter = np.zeros(len(ok), np.int64)
                for k in range(n - 1):
                    found = state[ids[k][ok]]
                    shorter = np.where(found >= 0, found, shorter)
                self.fail[inner[ok]] = shorter
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        self.arc_key, self.arc_weight, self.arc_to = key[by], np.concatenate(weights)[by], np.concatenate(to)[by]
        self.begin = 1 if order > 1 and starts else 0

    def walk(self, words: list[int]) -> float:
        """One text from left to right: follow failure arcs until the state reads the word, then its arc, and carry the state on."""
        total, state = 0.0, self.begin
        for w in words:
            while True:
                arc = int(np.searchsorted(self.arc_key, state * self.width + w))
                if arc < len(self.arc_key) and self.arc_key[arc] == state * self.width + w:
                    break
                total += float(self.fail_weight[state])
                state = int(self.fail[state])
            total += float(self.arc_weight[arc])
            state = int(self.arc_to[arc])
        return total

    def weights(self) -> np.ndarray:
        """What each token adds on the walk through its text, all texts of the chunk at once.

        The state that a walk carries to a token is the longest known context before it, whatever arcs led there; from those states
        the failure arcs are followed until every token has its arc.
        """
        out = np.zeros(len(self.word))
        left, state = np.arange(len(self.word)), self.before.copy()
        while len(left):
            key = state * self.width + self.word[left]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            reads = self.arc_key[arc] == key
            out[left[reads]] += self.arc_weight[arc[reads]]
            left, state = left[~reads], state[~reads]
            out[left] += self.fail_weight[state]
            state = self.fail[state]
        return out


def _fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 10 is 0. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def score_texts(docs: DataFrame, order: int = ORDER, mass: float = MASS, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text with a model of those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Null texts are empty: their one token is the end.
    Without training texts every probability is 1 for the unseen word. Rows repeated are counted and scored each; very long texts are
    taken whole, each in one chunk. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    total = text_bytes(docs, text_col)
    bits = bucket_bits(total / 7 * order, BUCKET)
    first, width = first_bits(bits), key_bytes()
    parts = in_chunks(docs, id_col, text_col, total, CHUNK_BYTES, _fold(F.col(id_col)).alias("held_out"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(list(rows["raw"]), order)
        taught = ~rows["held_out"].to_numpy(bool)
        words, longer, ids = numbered_grams(tokens)
        counts = taught_counts(tokens, ids, len(words) + len(longer), taught)
        out = split_sides([(words, counts[: len(words)]), (longer, counts[len(words) :])], first, width)
        return pd.DataFrame({"unit": int(rows["chunk"].iat[0]), "bucket": [b for b, _ in out], "blob": [x for _, x in out]})

    texts = docs.where(~_fold(F.col(id_col))).count()
    added = tally(parts.groupBy("chunk").applyInPandas(count, "unit long, bucket long, blob binary"), bits, 2)
    sums = added.where("unit < 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    answers = added.where("unit >= 0").select(F.col("unit").cast("int").alias("chunk"), "bucket", "blob").join(F.broadcast(sums))  # one row

    def score(rows: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=names)
        tokens = Tokens(list(rows["raw"]), order)
        words, longer, ids = numbered_grams(tokens)
        by_bucket = answer.sort_values("bucket")
        counts = np.concatenate(open_answers(list(by_bucket["blob"]), 2))
        total, distinct = int(answer["n"].iat[0]), int(answer["v"].iat[0])
        model = Automaton(tokens, ids, counts, len(words), total, distinct, texts, mass, ratio)
        begins = tokens.first[:-1]
        return pd.DataFrame({
            "doc_id": rows["doc_id"],
            "held_out": rows["held_out"].to_numpy(),
            "n_tokens": tokens.lengths,
            "n_known": np.add.reduceat((model.count > 0)[model.word].astype(np.int64), begins),
            "train_tokens": total,
            "base_score": np.add.reduceat(model.base[model.word], begins),
            "score": np.add.reduceat(model.weights(), begins),
        })

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    scored = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
