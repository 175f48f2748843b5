import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadgraph.llm import near
from spreadgraph.llm.exact import drop_copies, exact_dedup, misra_gries
from spreadgraph.llm.near import drop_near_duplicates, near_duplicates, suffix_bound


def low(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return {(rows[i][0], len(sets[i]), min(members[find(i)])) for i in range(len(rows))}


def corpus(seed, n=120, vocabulary=200):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "One two", "one TWO", "a b c d", "a b c d e", "É b c d e f", "é b c d e f"]
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if rng.random() < 0.3:
            w += base[0][:20]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int")


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_short_listed_prefixes_make_no_difference(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(near, "LISTED", 2)
    assert {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()} == near_brute(rows)


def passages(seed, n):
    """Documents of popular passages in a row, some with words of their own: many share long stretches and do not link."""
    rng = random.Random(seed)
    popular = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(8)]
    return [(i, " ".join([*rng.sample(popular, rng.randrange(3, 6)), *(f"own{i}x{j}" for j in range(rng.choice((0, 0, 1, 2, 9))))])) for i in range(n)]


@pytest.mark.parametrize("seed, named", [(1, 8), (2, 2), (3, 10**9)])
def test_popular_passages_equal_brute_force(spark, monkeypatch, seed, named):
    # as frequent shingles by the broadcast, and through the buckets only
    monkeypatch.setattr(near, "NAMED", named)
    rows = passages(seed, 150)
    assert {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()} == near_brute(rows)


def met_rows(spark, rows):
    counted = near.count_shared(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").cast("string"), "text")
    sets = near.candidate_sets(counted)
    heads = near.keep(near.prefixes(sets), "heads")
    links = near.verify(near.star_pairs(heads), sets)
    classes = near.keep(near.connected_components(links, "a", "b"), "classes")
    return sets.count(), near.meeting_places(heads, classes).count(), near.cross_pairs(heads, sets, classes).count()


def test_a_common_passage_does_not_pair_its_documents(spark):
    # 46 shared words and 8 of their own: Jaccard 0.72; with a phrase of two documents in place of own words: the same
    shared = " ".join(f"s{i}" for i in range(46))
    own = lambda n: [(i, f"{shared} " + " ".join(f"o{i}x{j}" for j in range(8))) for i in range(n)]
    phrase = lambda n: [(i, f"{shared} " + " ".join(f"o{i // 2}x{j}" for j in range(8)) + f" t{i}") for i in range(n)]
    for make in (own, phrase):
        (few, places, pairs), (many, more, still) = met_rows(spark, make(400)), met_rows(spark, make(1600))
        assert few == 400 and many == 1600
        assert pairs <= 400 and still <= 4 * max(pairs, 1) + 400  # not 16 times
        assert places <= 12 * few and more <= 12 * many


def test_frequent_shingles_are_bounded(spark):
    docs = spark.createDataFrame(passages(4, 300), "doc_id long, text string")
    tokens, ranks = near.frequent_shingles(docs, "text", limit=150)
    assert 0 < len(tokens) <= 150 and len(ranks) == len(tokens)
    everything = sum(len(shingles(t)) for _, t in passages(4, 300))
    counts = Counter(s for _, t in passages(4, 300) for s in shingles(t))
    assert len(tokens) >= sum(120 * n >= everything for n in counts.values()) > 0


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    other = [w if rng.random() > 0.02 else "other" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000])), (4, " ".join(words[:60_000])), (5, "short text of five words")]
    assert {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()} == near_brute(rows)
    got = exact_dedup(frame(spark, [*rows, (9, " ".join(words).upper())])).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == [2, 3, 4, 5, 9]


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (2**60 + 1, "a b c d e f"), (5, None), (5, None)]
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 2**60 + 1)] * 2 + [(2**60 + 1, 2, 2**60 + 1)] + [(5, 0, 5)] * 2, key=str)


def test_one_row_of_each_component_stays(spark):
    rows = corpus(2) + [(3, "a b c d e"), (10**6, None)]
    docs = frame(spark, rows + rows[20:25])
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    found = near_brute(rows)
    assert sorted(i for i, t in kept if shingles(t)) == sorted({c for _, n, c in found if n})
    assert sum(not shingles(t) for _, t in kept) == sum(not shingles(t) for _, t in rows)


def test_suffix_bound_never_underestimates():
    rng = random.Random(1)
    import numpy as np

    for _ in range(300):
        a = np.array(sorted(rng.sample(range(60), rng.randrange(30))), "u8")
        b = np.array(sorted(rng.sample(range(60), rng.randrange(30))), "u8")
        assert len(np.intersect1d(a, b)) <= suffix_bound(a, b) <= min(len(a), len(b))


def test_exact_dedup_equals_brute_force(spark):
    rows = corpus(5) + [(10_000 + i, "Hot Copy") for i in range(200)] + [(20_000 + i, "hot copy") for i in range(200)]
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = {(i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}
    for counters in (1, 3, 1024):
        assert {tuple(r) for r in exact_dedup(frame(spark, rows), counters=counters).collect()} == want
    kept = drop_copies(frame(spark, rows), counters=2)
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert kept.columns == ["doc_id", "text", "digest", "n"]


def test_exact_dedup_edge_cases(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
    rows = frame(spark, [(None, "a"), (4, "A"), (4, "A"), (None, "b"), (1, None), (2, "")])
    got = sorted((tuple(r)[:4] for r in exact_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True)], key=str)
    assert sorted(drop_copies(rows).select("doc_id").collect(), key=str) == sorted([(4,), (None,), (2,)], key=str)


def test_misra_gries_bound():
    rng = random.Random(4)
    values = ["hot"] * 400 + [f"v{rng.randrange(300)}" for _ in range(600)]
    rng.shuffle(values)
    held = misra_gries((pd.Series(values[i : i + 37]) for i in range(0, 1000, 37)), 5)
    assert len(held) <= 5 and 400 - 1000 / 6 <= held["hot"] <= 400
    assert all(n <= Counter(values)[v] for v, n in held.items())


def test_sql_oracles(spark, sf):
    from oracle import same
    from spreadgraph.llm import queries

    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, sf), sql, sf)


def test_ids_survive_shuffles(spark):
    rows = corpus(7)
    docs = frame(spark, rows).withColumn("r", F.rand()).repartition(5, "r").drop("r")
    assert {tuple(r) for r in near_duplicates(docs).collect()} == near_brute(rows)
