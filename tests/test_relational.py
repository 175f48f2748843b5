import datetime as dt

import pytest
from pyspark.sql import functions as F

from spreadgraph.functions import scalar
from spreadgraph.operators import edges, hosts, ranking, series, urlstats
from spreadgraph.sources import store, tables
from spreadgraph.operators.graph import SpreadGraph

T = dt.datetime


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(1, T(2024, 1, 1)), (2, T(2024, 1, 2)), (3, T(2024, 1, 3)), (4, T(2023, 12, 31, 23, 59))]
    return spark.createDataFrame(rows, "tweet_id long, datetime_est timestamp_ntz")


@pytest.fixture(scope="module")
def interactions(spark):
    rows = [("retweet", 1, 10, 11), ("retweet", 1, 10, 11), ("quote", 1, 10, 11), ("reply", 2, 12, 11), ("retweet", 3, 10, 13), ("retweet", 4, 9, 13)]
    return spark.createDataFrame(rows, "kind string, tweet_id long, src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_period_is_half_open(posts, interactions):
    got = edges.interaction_edges(interactions, "retweet", tweets=posts, start="2024-01-01", stop="2024-01-03")
    assert rows(got) == [(10, 11, 1), (10, 11, 1)]


def test_one_kind_keeps_duplicates_several_do_not(interactions):
    assert len(rows(edges.interaction_edges(interactions, "retweet"))) == 4
    assert rows(edges.interaction_edges(interactions, ["retweet", "quote"])) == [(9, 13, 4), (10, 11, 1), (10, 13, 3)]
    with pytest.raises(ValueError):
        edges.interaction_edges(interactions, "likes")


def test_groups_to_exclude_without_include(spark, interactions):
    tags = spark.createDataFrame([(1, "h", "g1"), (3, "h", "g2")], "tweet_id long, hashtag string, ht_group string")
    run = lambda **k: rows(edges.interaction_edges(interactions, "retweet", hashtag_rows=tags, **k))
    assert run(groups_exclude=["g1"]) == [(9, 13, 4), (10, 13, 3)]
    assert len(run(groups_exclude=["g1"], exclude_needs_include=True)) == 4
    assert run(groups_include=["g1", "g2"], groups_exclude=["g1"]) == [(10, 13, 3)]
    assert run(hashtags=[]) == []


def test_client_join_keeps_every_edge(spark, interactions):
    tweets = spark.createDataFrame([(1, "web"), (2, "app"), (3, None)], "tweet_id long, source_content string")
    got = edges.with_client(edges.interaction_edges(interactions, "retweet"), tweets, edges.client_ids(tweets))
    assert sorted((r["tweet_id"], r["source_id"]) for r in got.collect() if r["source_id"] is not None) == [(1, 1), (1, 1)]
    assert got.count() == 4


def test_lag_over_all_equals_one_window(spark, sf):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    got = tables.previous(e, "user_id", ("ts", "event_id"), F.date_trunc("hour", "ts"), "src").select("event_id", "src")
    want = e.select("event_id", F.lag("user_id").over(Window.orderBy("ts", "event_id")).alias("src"))
    key = lambda df: sorted(((r[0], -1 if r[1] is None else r[1]) for r in df.collect()))
    assert key(got) == key(want)


def test_host_sets(spark):
    stat = spark.createDataFrame([("far_right", "a.com", 0.01), ("far_right", "b.com", 0.5), ("far_right", "c.com", 1.0), ("far_left", "l.com", 1.0), ("fake", "b.com", 0.9)], "category string, hostname string, perccum double")
    sets = hosts.study_sets("c.com", ("l.com",))
    assert len(sets) == 17
    got = {}
    for k, h in rows(hosts.bridge(stat, sets)):
        got.setdefault(k, []).append(h)
    assert got["far_right"] == ["b.com", "c.com"]  # the threshold is strict
    assert got["outlet_right"] == ["c.com"] and got["not_outlet_right"] == ["b.com"]
    assert got["fake_far_right"] == ["b.com", "c.com"]
    assert "not_outlet_left" not in got


def test_null_hosts(spark):
    url = spark.createDataFrame([(1, 1, "x.com"), (2, 1, None), (3, 2, "twitter.com")], "tweet_id long, user_id long, final_hostname string")
    assert urlstats.url_totals(url).collect()[0].asDict() == {"n_tweets": 3, "n_users": 2, "n_tweets_other": 1, "n_users_other": 1}


def test_zero_denominators(spark):
    counts = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 4, 2, 1, 2)], "key string, n_t long, n_u long, n_t_official long, n_u_official long")
    got = {r["key"]: r for r in urlstats.client_proportions(counts).collect()}
    assert got["a"]["share_t"] is None and got["b"]["per_user"] is None and got["b"]["share_t"] == 0.75


def test_rankings(spark):
    k = spark.createDataFrame([(1, 3), (2, 1), (3, 3)], "user_id long, k_out long")
    assert rows(ranking.ordinal_rank(k, "k_out").select("user_id", "rank")) == [(1, 0), (2, 2), (3, 1)]
    assert [r["user_id"] for r in ranking.top(k, "k_out", 2).orderBy("rank").collect()] == [1, 3]
    accounts = spark.createDataFrame([(1, "one", True), (3, None, False)], "user_id long, screenname string, is_verified boolean")
    named = ranking.with_accounts(ranking.top(k, "k_out", 3).withColumn("media_type", F.lit("m")), accounts)
    assert ranking.account_status(named, 100).collect()[0].asDict() == {"media_type": "m", "verified": 1, "deleted": 2, "unverified": 97}
    assert {r["marked"] for r in ranking.marked_names(named).collect()} == {r"\textbf{one}", r"\sout{@???????}"}
    assert ranking.ranking_table(k.withColumn("k_in", -F.col("k_out")), "k_out", 1, ["k_in"]).collect()[0]["rank_k_in"] == 1


def test_bins_days_and_gaps(spark):
    posts = spark.createDataFrame([(1, 7, T(2024, 1, 1, 0, 2)), (1, 7, T(2024, 1, 1, 0, 17)), (2, 7, T(2024, 1, 1, 0, 17))], "tweet_id long, user_id long, datetime_est timestamp_ntz").withColumn("retweeted_status", F.lit(0)).withColumn("is_official", F.lit(False))
    got = series.binned_counts(posts, 5, "tweet_id").orderBy("bin").collect()
    assert [r["n_all"] for r in got] == [1, 0, 0, 2] and {r["n_official"] for r in got} == {0}
    products = series.count_products(posts, 5)
    assert products["users"].where("n_all > 0").count() == 2 and products["overall"].collect()[0]["tweets_all"] == 2
    days = spark.createDataFrame([(T(2024, 1, 2, 3, 59, 59),), (T(2024, 1, 2, 4),)], "t timestamp_ntz").select(series.day_start("t").alias("d"))
    assert [r["d"] for r in days.collect()] == [T(2024, 1, 1, 4), T(2024, 1, 2, 4)]
    hours = [T(2024, 1, 1, 4) + dt.timedelta(hours=h) for h in range(72) if h != 30]
    kept = series.drop_days_with_gaps(spark.createDataFrame([(h, 1) for h in hours], "bin timestamp_ntz, n int"), 60)
    assert {r["bin"].day for r in kept.where("hour(bin) = 12").collect()} == {1, 3}


def test_scalar_functions(spark):
    cases = [(2.0, "1 ± 2"), (0.5, "1.2 ± 0.5"), (0.03, "1.23 ± 0.03"), (0.00001, "1.2340 ± 0.0000")]
    got = spark.createDataFrame([(1.234, e) for e, _ in cases], "a double, b double").select(scalar.round_uncertain(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [s for _, s in cases]
    row = spark.range(1).select(scalar.lighter(F.array(F.lit(0.0), F.lit(0.5)), F.lit(0.5)).alias("l"), scalar.darker(F.array(F.lit(1.0)), F.lit(0.25)).alias("d"), scalar.without_suffix(F.lit("a_target.gt")).alias("n"), scalar.host_of(F.lit("http://x.y/z")).alias("h"), scalar.fixed(F.lit(None)).alias("f")).collect()[0]
    assert (row["l"], row["d"], row["n"], row["h"], row["f"]) == ([0.5, 0.75], [0.75], "a_target", "x.y", "")


def test_labels_layout_and_blanks(spark):
    row = spark.range(1).select(scalar.relabel(F.lit("a"), {"a": "A"}).alias("x"), scalar.relabel(F.lit("b"), {"a": "A"}).alias("y"), scalar.relabel(F.lit("b"), {}).alias("z")).collect()[0]
    assert tuple(row) == ("A", "b", "b")
    from spreadgraph.operators.graph import with_layout

    v = with_layout(spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(1, 0.5, 2.0)], "user_id long, x double, y double"), mirror_x=True)
    assert rows(v.where("x is not null")) == [(1, -0.5, 2.0)] and v.count() == 2
    wide = spark.createDataFrame([(1, None, 5), (2, 3, 6)], "bin int, tot int, a int")
    assert {tuple(r) for r in series.blank_where_missing(wide, "tot").collect()} == {(1, None, None), (2, 3, 6)}


def test_store(spark, tmp_path):
    g = SpreadGraph.of(spark.createDataFrame([(1, 2)], "src long, dst long"))
    root = f"file://{tmp_path}/g"
    store.save_graph(g, root, "com", "simple", "june")
    store.save_graph(g, root, "net", "simple", "june")
    assert store.load_graph(spark, root, media_type="com").edges.count() == 1
    with pytest.raises(FileExistsError):
        store.save_graph(g, root, "com", "simple", "june", mode="errorifexists")
    store.save_graph(g, root, "com", "simple", "june", mode="ignore")
    assert store.list_files(spark, f"{root}/edges", prefix="media_type=c") == ["media_type=com"]
    assert [r["line"] for r in store.graphml(g).collect()][-1] == "</graph></graphml>"
    assert r"a\_b" in store.latex(spark.createDataFrame([(1.0, "x")], "a_b double, c string"))
    store.update_table(spark.createDataFrame([(1, "p")], "x int, k string"), f"{root}/t", "k")
    store.update_table(spark.createDataFrame([(2, "q")], "x int, k string"), f"{root}/t", "k")
    assert spark.read.parquet(f"{root}/t").count() == 2
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (a int)")
        db.execute("insert into t values (1), (2)")
    assert store.read_sqlite(str(tmp_path / "x.db"), "select a from t", spark, "a int").count() == 2


def test_graphml_holds_attributes_in_order(spark):
    from xml.dom.minidom import parseString

    v = spark.createDataFrame([(2, "a<b&c", 0.5), (1, None, 1.5)], "user_id long, name string, katz double")
    e = spark.createDataFrame([(2, 1, True), (1, 2, None)], "src long, dst long, is_official boolean")
    lines = [r["line"] for r in store.graphml(SpreadGraph(v, e)).collect()]
    doc = parseString("".join(lines))
    assert [n.getAttribute("id") for n in doc.getElementsByTagName("node")] == ["n1", "n2"]
    data = [(n.getAttribute("key"), n.firstChild.data) for n in doc.getElementsByTagName("data")]
    assert data == [("node_katz", "1.5"), ("node_name", "a<b&c"), ("node_katz", "0.5"), ("edge_is_official", "true")]
    assert {(k.getAttribute("id"), k.getAttribute("attr.type")) for k in doc.getElementsByTagName("key")} == {("node_name", "string"), ("node_katz", "double"), ("edge_is_official", "boolean")}


def test_attached_stores_and_client_maps(spark, tmp_path):
    import sqlite3

    for name, value in (("a", 1), ("b", 2)):
        with sqlite3.connect(tmp_path / f"{name}.db") as db:
            db.execute("create table t (x int)")
            db.execute("insert into t values (?)", (value,))
    got = store.read_sqlite(str(tmp_path / "a.db"), "select t.x + o.x as s from t, other.t o", spark, "s int", {"other": str(tmp_path / "b.db")})
    assert [r["s"] for r in got.collect()] == [3]
    with pytest.raises(ValueError):
        store.read_sqlite(str(tmp_path / "a.db"), "select 1", spark, "s int", {"x; drop": "b"})
    for rows in ([(0, "web")], [(0, "web"), (1, "phone")]):
        store.write_client_map(spark.createDataFrame(rows, "source_id long, source_content string"), f"file://{tmp_path}/map/clients.parquet")
    store.attach(spark, "urls", f"file://{tmp_path}/map", ["clients"])
    assert spark.sql("select count(*) as n from urls_clients").first()["n"] == 2


def test_official_clients_and_joined_series(spark):
    from spreadgraph.sources import tables

    assert len(set(tables.OFFICIAL_CLIENTS)) == 18
    rows = spark.createDataFrame([("iOS",), ("bot",), (None,)], "c string")
    assert [r["o"] for r in rows.select(tables.is_official(F.col("c")).alias("o")).collect()] == [True, False, False]
    one = spark.createDataFrame([(1, 2, 3)], "bin int, a int, b int")
    two = spark.createDataFrame([(9, 1, 1)], "bin int, a int, b int")
    both = series.with_total(series.join_periods(one, two), ("a", "b"))
    assert {tuple(r) for r in series.wide_frame(both, one.select("bin", F.col("a").alias("m"))).collect()} == {(1, 2, 3, 5, 2), (9, 1, 1, 2, 0)}


def test_streamed_counts(spark, tmp_path):
    from spreadgraph.streaming.counts import windowed_counts

    rows = spark.createDataFrame([(1, 7, T(2024, 1, 1, 0, 2)), (1, 7, T(2024, 1, 1, 0, 2)), (2, 8, T(2024, 1, 1, 0, 3))], "tweet_id long, user_id long, datetime_est timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    got = spark.table("counted").collect()
    assert [(r["tweets"], r["users"]) for r in got] == [(2, 2)]
