import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spreadgraph.llm import chunks, lm
from spreadgraph.llm.lm import ADDED, Automaton, Tokens, numbered_grams, score_texts, taught_counts
from spreadgraph.storage import keep

TEXTS = ["the cat sat on the mat", "The cat sat", None, "", "   ", "a b a b a b a", "the dog sat on the cat\nthe cat", "ü ö Ü", "zz " * 3000, "the cat sat on the mat"] * 3


def tokens(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def brute(rows, order, mass=40.0, ratio=3.0):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    starts = 0
    for i, t in rows:
        if not held[i]:
            seq = ["<s>", *tokens(t)]
            starts += 1
            for j in range(1, len(seq)):
                for n in range(1, order + 1):
                    if j - n + 1 >= 0:
                        c[tuple(seq[j - n + 1 : j + 1])] += 1
    total = sum(v for k, v in c.items() if len(k) == 1)
    distinct = sum(len(k) == 1 for k in c)
    out = {}
    for i, t in rows:
        seq = ["<s>", *tokens(t)]
        base = score = 0.0
        for j in range(1, len(seq)):
            p = (c[seq[j],] + ADDED) / (total + ADDED * (distinct + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                if j - n + 1 >= 0:
                    h = tuple(seq[j - n + 1 : j])
                    ch = starts if h == ("<s>",) else c[h]
                    if ch:
                        m = min(mass, ratio * ch)
                        p = (c[(*h, seq[j])] + m * p) / (ch + m)
            score += math.log10(p)
        out[i] = (held[i], len(seq) - 1, sum(c[w,] > 0 for w in seq[1:]), total, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    want = brute(rows, order)
    got = score_texts(docs, order=order, mass=40.0, ratio=3.0).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, k, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("chunk_bytes, keys", [(200, 8), (60, 2), (3000, 1)])
def test_levels_of_buckets_make_no_difference(spark, monkeypatch, chunk_bytes, keys):
    monkeypatch.setattr(chunks, "LEVEL_BITS", 2)
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(lm, "BUCKET", keys)
    rows = [(i, f"{t} t{i % 17} u{i}") for i, t in enumerate(["the cat sat on the mat", "a b a b", "the dog"] * 20)]
    want = brute(rows, 2)
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), mass=40.0, ratio=3.0).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, k, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_rows_of_the_exchange_are_in_proportion_to_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "LEVEL_BITS", 3)
    rng = np.random.default_rng(1)
    kept = []
    monkeypatch.setattr(chunks, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    rows = {}
    for units, bits in ((16, 4), (64, 6), (256, 8)):  # as many buckets as units: one row each would be the square
        keys = [np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(units)]
        sent = [(u, b, blob) for u, k in enumerate(keys) for b, blob in chunks.split_sides([(k, np.ones(len(k), np.int64)), (k[:0], np.empty(0, np.int64))], chunks.first_bits(bits), chunks.key_bytes())]
        kept.clear()
        answer = chunks.tally(spark.createDataFrame(sent, "unit long, bucket long, blob binary"), bits, 2).collect()
        assert sum(r["n"] for r in answer) == sum(map(len, keys))
        assert sum(r["unit"] >= 0 for r in answer) == len(sent)
        rows[units] = len(sent) + sum(k.count() for k in kept)
    for units, levels in ((16, 2), (64, 2), (256, 3)):
        assert rows[units] <= 2 * levels * 8 * units


def test_base_counts_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in score_texts(docs).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 1)
    assert len(got) == len(want)
    for i, (h, n, k, total, base, _) in want.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (h, n, k, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-12)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    got = score_texts(nulls).collect()
    assert [r["held_out"] for r in got] == [True, True]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_side_by_side_equals_one_walk_after_the_other(order):
    texts = [(t or "").encode() for t in TEXTS]
    tokens = Tokens(texts, order)
    words, longer, ids = numbered_grams(tokens)
    taught = np.arange(len(texts)) % 3 != 0
    counts = taught_counts(tokens, ids, len(words) + len(longer), taught)
    model = Automaton(tokens, ids, counts, len(words), int(counts[: len(words)].sum()), int((counts[: len(words)] > 0).sum()), int(taught.sum()), 3.0)
    added = model.weights()
    for i in range(len(texts)):
        own = slice(tokens.first[i], tokens.first[i + 1])
        assert added[own].sum() == pytest.approx(model.walk(model.word[own].tolist()), rel=1e-9)
