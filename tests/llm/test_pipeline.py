import re
from collections import Counter

import corpus_pipeline
import pyarrow.parquet as pq
from test_dedup import near_brute, shingles

from spreadgraph.llm.toxicity import score_toxicity, train
from spreadgraph.storage import keep


def test_stages_against_brute_force(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    made = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, sf), name)
        made[name] = now
        if name != "packing":
            assert now.columns == columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    everything = rows(docs)

    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r["doc_id"] for r in score_toxicity(docs, model).collect() if r["predicted"]}
    clean = rows(made["toxicity"])
    assert set(clean) == set(everything) - rejected

    best = {}
    for i, t in clean.items():
        key = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
        best[key] = max(best.get(key, -1), i)
    single = rows(made["exact_dedup"])
    assert set(single) == set(best.values())

    component = near_brute(list(single.items()))
    left = rows(made["near_dedup"])
    assert set(left) == {i for i, _, c in component if i == c}
    assert all(left[i] == everything[i] for i in left)
    assert any(not shingles(t) for t in left.values()) or all(shingles(t) for t in single.values())

    mixed = Counter(r["doc_id"] for r in made["mixing"].collect())
    assert set(mixed) <= set(left)
    packed = Counter(r["doc_id"] for r in made["packing"].collect() if r["piece"] == 0)
    assert packed == mixed
    once = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert once == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in made["packing"].collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id int, copy int, mix_copy int, digest string, _name string"


def odd_rows(docs):
    extra = ("r", 1, 2, 3, "d", "n")
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *extra) for r in docs.limit(60).collect()]
    long = " ".join(f"w{i}" for i in range(40_000))
    nulls = [(None, None, None, None, None, *[None] * 6), (None, "Only one, with no id at all.", None, None, None, *extra), (None, "Only one, with no id at all.", None, None, None, *extra)]
    own = [(900, None, "en", "s", None, *extra), (901, "", "en", None, 0, *extra), (902, long, None, "s", 1, *extra), (903, long.upper(), None, "s", 1, *extra), (904, long + " more", None, "s", 1, *extra)]
    return [*base, *base[:5], *nulls, *own, own[2]]


def test_stages_on_nulls_repeats_long_texts_and_clashing_names(spark, sf):
    rows = odd_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = now = keep(spark.createDataFrame(rows, ODD).repartition(3), "odd")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, sf), name)
        made[name] = now
        assert name == "packing" or now.columns == docs.columns
    text = lambda r: re.sub(r"[A-Z]", lambda m: m[0].lower(), r["text"] or "")
    clean = made["toxicity"].collect()
    assert len([r for r in clean if r["doc_id"] is None]) == 3 and len([r for r in clean if r["doc_id"] == 902]) == 2
    single = made["exact_dedup"].collect()
    assert sorted(map(text, single)) == sorted({text(r) for r in clean})
    for r in single:
        alike = [q["doc_id"] for q in clean if text(q) == text(r) and q["doc_id"] is not None]
        assert r["doc_id"] == max(alike, default=None)
    near = made["near_dedup"].collect()
    assert {r["doc_id"] for r in near} >= {901, 903} and 904 not in {r["doc_id"] for r in near}
    assert set(map(tuple, near)) <= set(map(tuple, single))
    mixed = Counter(map(tuple, made["mixing"].collect()))
    assert set(mixed) <= set(map(tuple, near))
    packed = Counter(r["doc_id"] for r in made["packing"].collect() if r["piece"] == 0)
    assert packed == Counter({i: sum(n for row, n in mixed.items() if row[0] == i) for i in {row[0] for row in mixed}})


def test_stages_on_an_empty_table(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, sf), "empty")
        assert now.collect() == []


def test_labels_of_the_tables_are_held_out(sf):
    assert pq.read_schema(f"{sf}/labels.parquet").names == ["doc_id", "quality", "toxic"]
