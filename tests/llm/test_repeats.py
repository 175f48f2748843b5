import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadgraph.llm import repeats
from spreadgraph.llm.repeats import find_repeats, merge_transforms, repeated_starts, shard_transform


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def sample():
    rng = random.Random(3)
    passage = [words(rng, 120) for _ in range(4)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "ab" * 700, "xyz" * 1000 + words(rng, 100)]
    for i in range(60):
        t = words(rng, rng.randrange(20, 300))
        for p in rng.sample(passage, rng.randrange(0, 3)):
            cut = rng.randrange(len(t))
            lo = rng.randrange(0, 200)
            t = t[:cut] + p[lo : lo + rng.randrange(300, 700)] + t[cut:]
        texts.append(t)
    return texts + texts[20:24] + [texts[30] + "tail", "head" + texts[31]]


def compare(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["span_starts"]), r["kept_sha256"]) for r in find_repeats(docs).collect()}
    want = brute(texts, repeats.WIDTH)
    assert [i for i in got if got[i] != want[i]] == []
    assert len(got) == len(texts)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 20_000)
    compare(spark, sample())


def test_spread_minimizers_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "HOT", 1)
    compare(spark, sample())


def test_crowds_in_a_chunk_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(repeats, "CROWD", 1)
    compare(spark, sample())


def test_rows_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 20_000)
    texts = sample()
    docs = spark.createDataFrame([(i + 2**60, t) for i, t in enumerate(texts)] + [(None, "nothing")], "doc_id long, text string")
    shuffled = docs.withColumn("r", F.rand()).repartition(7, "r").drop("r")  # another order each time it is read
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["span_starts"]), r["kept_sha256"]) for r in find_repeats(shuffled).collect()}
    want = brute([*texts, "nothing"], repeats.WIDTH)
    assert got == {**{i + 2**60: w for i, w in enumerate(want[:-1])}, None: want[-1]}


def test_minimizers_spread_over_the_counting_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 40_000)
    kept, keep = {}, repeats.keep
    monkeypatch.setattr(repeats, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    rng = random.Random(8)
    find_repeats(spark.createDataFrame([(i, words(rng, 400)) for i in range(100)], "doc_id long, text string"))
    sizes = [r["n"] for r in kept["runs"].where("kind = 'entries'").groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).collect()]
    assert len(sizes) == 64 and max(sizes) < 0.1 * sum(sizes)


def test_very_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "AT_ONCE", 1500)
    compare(spark, sample())


def test_empty_table_and_null_ids(spark):
    assert find_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nulls = spark.createDataFrame([(None, "q" * 500), (None, "hello")], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in find_repeats(nulls).collect()) == [(5, 0), (500, 500)]


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_order_and_prefixes(seed):
    rng = random.Random(seed)
    shards = [[bytes(rng.choices(b"ab", k=rng.randrange(4, 30))) for _ in range(rng.randrange(1, 5))] for _ in range(4)]
    made = [shard_transform(t, 2) for t in shards]
    place, common = merge_transforms(made, 3)
    assert sorted(place.tolist()) == list(range(len(place)))
    # suffixes with at least six bytes: neighbours share six exactly when the prefix says so
    flat, base = [], 0
    for texts, (order, _, _, _) in zip(shards, made):
        where = [(t, i) for t in texts for i in range(len(t) + 1)]
        flat += [where[o] for o in order]
    suffix = [flat[p][0][flat[p][1] :] for p in place]
    groups = np.cumsum(common < 3)
    same = {}
    for s, g in zip(suffix, groups):
        if len(s) >= 6:
            same.setdefault(s[:6], set()).add(int(g))
    assert all(len(g) == 1 for g in same.values())
    assert len({next(iter(g)) for g in same.values()}) == len(same)


def test_repeated_starts_of_shards():
    flags = repeated_starts([([b"abcdefgh", b"xxabcdxx"], np.array([0, 0])), ([b"zzabcdefz"], np.array([0]))], width=4, block=2)
    assert flags[0][0].tolist() == [True, True, True, False, False]
    assert flags[0][1].tolist() == [False, False, True, False, False]
    assert flags[1][0].tolist() == [False, False, True, True, True, False]
