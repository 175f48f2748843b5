import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadgraph.llm import neighbours, packing
from spreadgraph.llm.mixing import mix_sources, poisson_cdf, poisson_span
from spreadgraph.llm.neighbours import hilbert_keys, search_neighbours
from spreadgraph.llm.packing import WordEncoder, best_config, best_fit, pack_documents, solve
from spreadgraph.llm.shard import shard_records
from spreadgraph.operators.numbering import number_within
from spreadgraph.storage import keep

ODD = ["", "  ", None, "Áb ΣΑΣ İstanbul", "a b c it's I'LL don't x1234,,..", "日本語 テスト 😀😀!!", "é é Å K ﬁ ß ẞ", "<|endoftext|> hi", "tab\tnl\nvt\x0bff\x0ccr\r\x1c\x85x", "word, word. (word) w-w", "long " * 3000]


# ------------------------------------------------------------------------------------------------------------- sharding


def test_shards(spark):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 50), "s") for i in range(3000)] + [(None, "x", "s")] * 3 + [(5, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard_records(docs, 40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        raw = ("" if r["doc_id"] is not None and r["doc_id"] % 9 == 0 else None)
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        if raw is not None:
            assert (r["size"], r["text_crc32"]) == (16, 0)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 30 < moved < 130
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_id.values())
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 40 and max(counts.values()) < 2 * len(rows) / 40
    grown = {r["doc_id"]: r["shard"] for r in shard_records(docs, 41).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    one = next(r for r in got if r["doc_id"] == 7)
    assert (one["size"], one["text_crc32"]) == (16 + 14, zlib.crc32(("é" * 7).encode()))


def brute_shard(key, weights):
    """The shard of the least -ln(u) / weight, u from two chained xxHash64 of the shard and the key."""
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64(struct.pack("<i", shard), seed=42).intdigest()
        h = h if key is None else xxhash.xxh64(struct.pack("<q", key), seed=h).intdigest()
        score = -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight if weight > 0 else math.inf
        if best is None or score < best[0]:
            best = (score, shard)
    return best[1]


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 2.0, 0.5, 3.0], [2.0, 0.0, 1.0]])
def test_winners_equal_brute_force(spark, weights):
    ids = [None, 0, -1, 2**62, *range(1, 400)]
    docs = spark.createDataFrame([(i, "t " * 100_000 if i == 7 else None) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in shard_records(docs, len(weights), weights).collect()}
    assert got == {i: (brute_shard(i, weights), brute_shard(i, [*weights, 1.0])) for i in ids}


def test_weighted_shards_and_empty_table(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r["shard"] for r in shard_records(docs, 3, [1.0, 2.0, 1.0]).collect())
    assert n[1] / 20000 == pytest.approx(0.5, abs=0.03)
    assert shard_records(docs.limit(0)).collect() == []


def test_numbers_within_groups(spark):
    t = keep(spark.range(0, 1000, 1, 5).select((F.col("id") % 3).alias("g"), F.lit("z").alias("_x")), "n")
    got = number_within(t, "g", "at").collect()
    assert sorted((r["g"], r["at"]) for r in got) == sorted((i % 3, i // 3) for i in range(1000))


# --------------------------------------------------------------------------------------------------------------- mixing


def test_mixing_hits_target_shares_and_poisson_counts(spark):
    rng = random.Random(1)
    rows = [(i, "t" * 20, "big" if rng.random() < 0.8 else "small", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mix_sources(docs, weights={"big": 1.0, "small": 1.0})
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_copy", "n_copies", "rate", "shuffle_key"]
    n = Counter()
    for r in out.collect():
        n[r["source"]] += 1
    assert n["big"] / n["small"] == pytest.approx(1, abs=0.12)
    small = [r for r in out.collect() if r["source"] == "small"]
    rate = small[0]["rate"]
    times = Counter(r["doc_id"] for r in small)
    ids = [i for i, _, s, _ in rows if s == "small"]
    share0 = sum(i not in times for i in ids) / len(ids)
    assert share0 == pytest.approx(math.exp(-rate), abs=0.03)
    assert sum(n.values()) == pytest.approx(6000, rel=0.06)
    again = mix_sources(docs.repartition(7), weights={"big": 1.0, "small": 1.0}, ordered=False)
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in out.collect())
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    got = mix_sources(spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], schema)).collect()
    assert all(r["n_copies"] >= 1 for r in got)
    only = mix_sources(spark.createDataFrame([(i, "x", "a" if i % 2 else "b") for i in range(200)], schema), weights={"a": 1.0}).collect()
    assert {r["source"] for r in only} == {"a"} and len(only) > 120


def test_columns_with_the_names_of_the_result(spark):
    rows = [(i, "t" * 30, "a", 1, 2, "x", 0.5) for i in range(50)] + [(99, "long " * 200_000, "b", 1, 2, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, mix_copy int, Rate string, n_copies double")
    out = mix_sources(docs, weights={"a": 1.0, "b": 1.0})
    assert out.columns == [*docs.columns, "mix_mix_copy", "mix_n_copies", "mix_rate", "shuffle_key"]
    got = out.collect()
    assert {(r["copy"], r["mix_copy"], r["n_copies"]) for r in got} == {(1, 2, 0.5)} and sum(r["doc_id"] == 99 for r in got) <= 3


def test_copies_are_poisson_quantiles_at_large_rates(spark):
    # one document of 1 byte of mass beside large sources: its source's rate is far above 745, where exp(-rate) is 0
    schema = "doc_id long, text string, source string"
    for length, sources, least in ((1_200, 1, 20), (3_000_000, 1, 1700), (4_000_000, 3, 600), (36_000_000, 1, 5900)):
        rows = [(-1 - i, "", f"tiny{i}") for i in range(4)] + [(i, "t" * length, f"big{i}") for i in range(sources)]
        got = mix_sources(spark.createDataFrame(rows, schema), ordered=False).where("doc_id < 0").groupBy("doc_id").agg(F.max("rate").alias("rate"), F.max("n_copies").alias("n"), F.count("*").alias("rows"), F.countDistinct("copy").alias("copies")).collect()
        assert len(got) == 4
        for r in got:
            rate, u = r["rate"], int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
            assert rate > least
            below = j = 0
            while (below := below + math.exp(j * math.log(rate) - rate - math.lgamma(j + 1))) <= u:
                j += 1
            assert r["n"] == r["rows"] == r["copies"] == j and abs(j - rate) < 6 * math.sqrt(rate)


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 40.0, 700.0, 1000.0, 6000.0, 170000.0])
def test_poisson_law(rate):
    low, far = poisson_span(rate)
    cdf = poisson_cdf(rate)
    assert len(cdf) == far - low + 1 and cdf[-1] == 1 and (np.diff(cdf) >= 0).all()
    want = np.cumsum([math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) if rate else float(j == 0) for j in range(low, far + 1)])
    assert np.abs(cdf - want).max() < 1e-8


# -------------------------------------------------------------------------------------------------------------- packing


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    path = public_tokenizers.path(packing.TOKENIZER)
    whole, mine = Tokenizer.from_file(path), WordEncoder(path)
    assert mine.by_word
    rng = random.Random(2)
    alphabet = "abcXYZéßñ日Σ09 \t\n.,!?'\"-()%$#<|>"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    for limit in (10**6, 5):
        monkeypatch.setattr(packing, "REMEMBERED", limit)
        for at in range(0, len(texts), 50):
            got = mine([t.encode() for t in texts[at : at + 50]])
            assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts[at : at + 50]]


def check_packing(rows, docs, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_places_every_piece(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(["alpha", "beta,", "Gamma."], k=rng.randrange(1, 1500)))) for i in range(150)] + [(100, "repeat"), (None, "no id"), (2**61, "big id")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, offset int")
    rows = pack_documents(frame, 2048, with_ids=True).collect()
    used = check_packing(rows, docs, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert pack_documents(frame.limit(0)).collect() == []
    small = pack_documents(frame, 64).collect()
    check_packing(small, docs, 64)


def test_solver_holds_every_piece_and_is_near_the_bound():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 20000):
        lengths = np.clip(rng.lognormal(4.5, 1.2, n).astype(int), 1, 512)
        demand = dict(Counter(lengths.tolist()))
        plan = solve(demand, 512)
        held = Counter()
        for config, times in plan:
            assert sum(x * k for x, k in config) <= 512 and times > 0
            for x, k in config:
                held[x] += k * times
        assert held == Counter(demand)
        used, bound = sum(t for _, t in plan), -(-int(lengths.sum()) // 512)
        assert used <= max(1.01 * bound, bound + 2)
        assert used <= sum(t for _, t in best_fit(demand, 512)) + 1


def test_the_program_prices_small_histograms_too(monkeypatch):
    priced = []
    real = packing.best_config
    monkeypatch.setattr(packing, "best_config", lambda *a: priced.append(1) or real(*a))
    demand = dict(Counter(np.clip(np.exp(np.random.default_rng(1).normal(5.8, 1, 200)).astype(int), 1, 2047).tolist()))
    plan = solve(demand)
    assert priced
    held = Counter()
    for config, n in plan:
        for length, k in config:
            held[length] += n * k
    assert held == Counter(demand)
    assert set(packing.fractional(demand, 2048)) & {c for c, _ in plan}
    assert sum(n for _, n in plan) <= sum(n for _, n in best_fit(demand, 2048))


def test_the_program_covers_the_demand_and_leaves_a_little_to_best_fit(monkeypatch):
    rng = np.random.default_rng(1)
    dense = dict(Counter(np.clip(np.exp(rng.normal(4.5, 1, 20_000)).astype(int), 1, 511).tolist()))
    even = dict.fromkeys(range(1, 512), 40)
    few = dict.fromkeys(range(100, 250), 20)  # lengths that fill a sequence badly
    left = []
    monkeypatch.setattr(packing, "best_fit", lambda rest, c: left.append(sum(x * n for x, n in rest.items())) or best_fit(rest, c))
    for demand, most in ((dense, 2), (even, 0), (few, 70)):
        tokens = sum(x * n for x, n in demand.items())
        held = Counter()
        for config, n in packing.fractional(demand, 512).items():
            assert n > 0 and sum(x * k for x, k in config) <= 512
            for x, k in config:
                held[x] += n * k
        assert all(n <= demand[x] for x, n in held.items())
        assert sum(x * n for x, n in held.items()) >= 0.99 * tokens
        left.clear()
        used = sum(n for _, n in solve(demand, 512))
        assert left and max(left) <= 0.01 * tokens
        assert used <= -(-tokens // 512) + most
        assert used <= sum(n for _, n in best_fit(demand, 512))


def test_knapsack_with_counts_equals_brute_force():
    prices, lengths, most = np.array([3.0, 4.5, 7.9]), np.array([2, 3, 5]), np.array([1, 3, 2])
    table = packing.Knapsack(prices, lengths, most, 23)
    worth = lambda config: sum(prices[lengths.tolist().index(x)] * k for x, k in config.items())
    for room in range(24):
        config = best_config(prices, lengths, room, table)
        best = max(a * 3 + b * 4.5 + c * 7.9 for a in range(2) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= room)
        assert worth(config) == pytest.approx(best)
        assert sum(x * k for x, k in config.items()) <= room and all(config[x] <= m for x, m in zip(lengths.tolist(), most.tolist(), strict=True))


def test_best_config_equals_brute_force():
    prices, lengths = np.array([3.0, 4.5, 7.9]), np.array([2, 3, 5])
    config = best_config(prices, lengths, 11)
    best = max((a * 3 + b * 4.5 + c * 7.9) for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert sum(prices[list(lengths).index(x)] * k for x, k in config.items()) == pytest.approx(best)


# ----------------------------------------------------------------------------------------------------------- neighbours


def test_hilbert_curve_visits_neighbouring_cells():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        v = np.array(rows[q], float)
        scored = sorted((-float((v * np.array(w, float)).sum()), i) for i, w in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = {i: (rng.normal(size=16) * rng.uniform(0.5, 2)).tolist() for i in range(3000)}
    table = spark.createDataFrame([(i, v, "x") for i, v in rows.items()], "vec_id long, embedding array<double>, rank string")
    got = search_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    want = brute_neighbours(rows, range(0, 3000, 20), 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, expected in want.items():
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert i != q and s == pytest.approx(float(np.dot(rows[q], rows[i])), abs=1e-12)
        hit += len({i for _, i, _ in mine} & {i for i, _ in expected})
    assert hit / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("rows", [500, 2000, 6000])
def test_recall_at_three_sizes_and_less_work_on_clusters(spark, rows, monkeypatch):
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(rows // 50, 32))
    points = centres[rng.integers(0, len(centres), rows)] + 0.05 * rng.normal(size=(rows, 32))
    points /= np.sqrt((points**2).sum(1))[:, None]
    looked = []
    real = neighbours.cheapest_window
    monkeypatch.setattr(neighbours, "cheapest_window", lambda far, target, n: looked.append((real(far, target, n), n)) or real(far, target, n))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in search_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = points[::20] @ points.T
    scores[np.arange(len(scores)), np.arange(0, rows, 20)] = -9
    want = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len(got[20 * q] & set(w.tolist())) for q, w in enumerate(want)) / want.size >= 0.9
    ((curves, reach), n) = looked[0]
    assert neighbours.LEAST_CURVES <= curves <= neighbours.CURVES
    if rows >= 2000:
        assert curves * 2 * reach < n  # fewer comparisons than brute force


def test_cheapest_window():
    far = np.array([[1, 90, 90], [90, 2, 90], [1, 2, 3], [5, 5, 5]])
    assert neighbours.cheapest_window(far, 1.0, 1000) == (2, 5)
    assert neighbours.cheapest_window(far, 0.75, 1000) == (2, 2)


def test_most_frequent_length_takes_part(spark):
    rows = [(i, [1.0, float(i)]) for i in range(10)] + [(20, [1.0, 2.0, 3.0])]
    got = search_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3)]


def test_small_tables_ties_and_unusable_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(i, [1.0, 0.0]) for i in range(30)]
    odd = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, None]), (120, [float("inf"), 0.0]), (140, []), (160, [1.0]), (None, [1.0, 0.0])]
    got = search_neighbours(spark.createDataFrame(same + odd, schema), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20}
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 21))
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == list(range(20))
    few = search_neighbours(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(1, 5.0)]
    assert search_neighbours(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert search_neighbours(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).collect() == []
