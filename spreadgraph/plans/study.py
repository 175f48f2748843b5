"""The study's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadgraph.operators import association as assoc
from spreadgraph.operators import centrality, decompose, edges, graph, hosts, influence, ranking, series, traverse, urlstats
from spreadgraph.operators.graph import SpreadGraph
from spreadgraph.sources import tables as t
from spreadgraph.storage import keep

START, MIDDLE, STOP = "2024-01-01", "2024-01-15", "2024-02-01"
MEDIA = ("com", "net", "org")
THRESHOLD = 0.01
#: The named sets of the driver's hosts: categories, a lower threshold, mobile hosts as single outlets, and unions.
BASE_KEYS = MEDIA
Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_all)


# ------------------------------------------------------------------------------------------------------------------ pieces


def _retweets(spark: SparkSession, d: str) -> DataFrame:
    return edges.interaction_edges(t.interactions(spark, d), "retweet")


def _retweet_graph(spark: SparkSession, d: str) -> SpreadGraph:
    return SpreadGraph.of(_retweets(spark, d))


def _simple(spark: SparkSession, d: str) -> SpreadGraph:
    """The simple retweet graph, its edges written once: searches and power iterations read them again and again."""
    g = _retweet_graph(spark, d).simple()
    return SpreadGraph(g.vertices, keep(g.edges, "edges"))


def _all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all kinds with their client."""
    e = edges.interaction_edges(t.interactions(spark, d), "all")
    return e.join(t.tweets(spark, d).select("tweet_id", "source_content", "is_official"), "tweet_id", "left")


def _stat(url: DataFrame) -> DataFrame:
    return hosts.host_stat(url)


def _bridge(url: DataFrame) -> DataFrame:
    stat = _stat(url)
    base = [hosts.HostSet(c, (c,), THRESHOLD) for c in MEDIA]
    more = [hosts.HostSet("com_low", ("com",), 0.005), hosts.HostSet("com_high", ("com",), 0.08), hosts.HostSet("com_net", ("com", "net"), THRESHOLD), hosts.HostSet("com_net_org", MEDIA, THRESHOLD)]
    mobile = F.col("hostname").startswith("m.")
    only = stat.where((F.col("category") == "com") & mobile).select(F.lit("com_mobile").alias("key"), "hostname")
    rest = stat.where((F.col("category") == "com") & (F.col("perccum") > THRESHOLD) & ~mobile).select(F.lit("com_not_mobile").alias("key"), "hostname")
    return hosts.bridge(stat, base + more).unionByName(only).unionByName(rest)


def _media_tweets(url: DataFrame, category: str, aggregators: bool) -> DataFrame:
    stat = _stat(url)
    chosen = stat.where((F.col("category") == category) & (F.col("perccum") > THRESHOLD)).select("hostname")
    return edges.linking_to(url, chosen if aggregators else hosts.without(chosen, t.aggregators(stat)))


def _media_edges(spark: SparkSession, d: str, category: str, aggregators: bool = False) -> DataFrame:
    url = t.urls(spark, d)
    return edges.interaction_edges(t.interactions(spark, d), "retweet", tweets=t.tweets(spark, d), start=START, stop=STOP, tweet_filter=_media_tweets(url, category, aggregators))


def _rankings(spark: SparkSession, d: str, depth: int) -> DataFrame:
    """``media_type, rank, user_id, k_out, screenname, is_verified`` of the best users by k_out in each media's simple graph."""
    url = t.urls(spark, d)
    stat = _stat(url)
    chosen = hosts.without(stat.where(F.col("perccum") > THRESHOLD), t.aggregators(stat)).select(F.col("hostname").alias("final_hostname"))
    media = url.join(chosen, "final_hostname", "left_semi").select("tweet_id", F.col("category").alias("media_type"))
    e = _retweets(spark, d).join(media, "tweet_id").where("src <> dst").select("media_type", "src", "dst").distinct()
    k = e.groupBy("media_type", F.col("src").alias("user_id")).agg(F.count("*").alias("k_out"))
    return ranking.with_accounts(ranking.top(k, "k_out", depth, ("media_type",)), t.accounts(spark, d))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """``bin`` and distinct posts an hour: of each media category, and of even and odd users; every hour of the calendar."""
    url = t.urls(spark, d).withColumn("bin", series.floor_time("datetime_est", 60))
    one = lambda c: F.count_distinct(F.when(c, F.col("tweet_id")))
    counts = url.groupBy("bin").agg(*[one(F.col("category") == m).alias(m) for m in MEDIA], one(F.col("user_id") % 2 == 0).alias("pro_even"), one(F.col("user_id") % 2 == 1).alias("pro_odd"))
    return series.fill_bins(counts, 60)


SERIES = (*MEDIA, "pro_even", "pro_odd")

# ------------------------------------------------------------------------------------------------------------- edges, graphs


@query
def edges_retweet(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), "retweet", tweets=t.tweets(spark, d), start=START, stop=MIDDLE)


@query
def edges_all_types(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), "all")


@query
def edges_hashtag(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), ["retweet", "quote"], hashtag_rows=t.hashtags(spark, d), hashtags=["h1", "h3", "h7"])


@query
def edges_keyword(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), "reply", keyword_rows=t.keywords(spark, d), keywords=["w2", "w5"])


@query
def edges_group_incl_excl(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), "all", hashtag_rows=t.hashtags(spark, d), groups_include=["g0", "g1"], groups_exclude=["g1"])


@query
def edges_query(spark, d):
    return edges.interaction_edges(t.interactions(spark, d), "mention", query_rows=t.tweet_queries(spark, d), named_queries=t.named_queries(spark), queries=["q1", "q4"])


@query
def edges_media(spark, d):
    return _media_edges(spark, d, "net", aggregators=True)


@query
def edges_media_not_aggr(spark, d):
    return _media_edges(spark, d, "net")


@query
def edges_with_source(spark, d):
    tweets = t.tweets(spark, d)
    return edges.with_client(_retweets(spark, d), tweets, edges.client_ids(tweets))


@query
def edges_two_periods(spark, d):
    parts = [edges.interaction_edges(t.interactions(spark, d), "retweet", tweets=t.tweets(spark, d), start=a, stop=b).withColumn("period", F.lit(p)) for p, a, b in (("first", START, MIDDLE), ("second", MIDDLE, STOP))]
    return parts[0].unionByName(parts[1]).groupBy("period").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"))


@query
def client_map_merged(spark, d):
    tweets = t.tweets(spark, d)
    first = edges.client_ids(edges.in_period(tweets, "datetime_est", START, MIDDLE).where("source_content <> 'view'"))
    return edges.merge_client_maps(first, edges.client_ids(tweets))


@query
def edges_global_client(spark, d):
    tweets = t.tweets(spark, d)
    own = edges.client_ids(tweets)
    merged = edges.merge_client_maps(edges.client_ids(tweets.where("source_content <> 'view'")), own)
    return edges.to_global_clients(edges.with_client(edges.interaction_edges(t.interactions(spark, d), "all"), tweets, own), own, merged)


@query
def graph_simple(spark, d):
    return _retweet_graph(spark, d).simple().edges


@query
def degrees(spark, d):
    return _retweet_graph(spark, d).degrees()


@query
def network_stats(spark, d):
    g = _retweet_graph(spark, d)
    out = graph.network_stats(g).withColumn("graph_type", F.lit("complete")).unionByName(graph.network_stats(g.simple()).withColumn("graph_type", F.lit("simple")))
    return out.withColumn("mean_k", F.round("mean_k", 9))


@query
def official_ratio(spark, d):
    e = _all_edges(spark, d)
    parts = [graph.official_ratio(e, way).select("user_id", F.lit(way).alias("direction"), F.round("ratio", 9).alias("ratio")) for way in ("in", "out")]
    return parts[0].unionByName(parts[1])


@query
def main_client(spark, d):
    e = _all_edges(spark, d)
    v = SpreadGraph.of(e).vertices
    parts = [graph.main_client(v, e, way).select("user_id", F.lit(way).alias("direction"), "client") for way in ("in", "out")]
    return parts[0].unionByName(parts[1])


@query
def ccdf_out(spark, d):
    return graph.ccdf(_retweet_graph(spark, d).simple().degrees(), "k_out").withColumn("p", F.round("p", 9))


@query
def ccdf_in(spark, d):
    return graph.ccdf(_retweet_graph(spark, d).simple().degrees(), "k_in").withColumn("p", F.round("p", 9))


# ---------------------------------------------------------------------------------------------------------------- rankings


@query
def top_users(spark, d):
    k = SpreadGraph.of(_media_edges(spark, d, "com")).simple().degrees()
    return ranking.top(k.where("k_out > 0"), "k_out", 25).select("rank", "user_id", "k_out")


@query
def ranking_table(spark, d):
    k = _retweet_graph(spark, d).simple().degrees()
    return ranking.ranking_table(k, "k_out", 200, ["k_in"])


@query
def top_rank_table(spark, d):
    measures = influence.static_vertices(_simple(spark, d)).withColumn("katz_rev", F.round("katz_rev", 9)).drop("katz")
    out = ranking.top_rank_table(measures, "k_out", 200, ["ci_out", "ci_in", "katz_rev", "k_in"], main_client(spark, d), t.accounts(spark, d))
    return out.select("rank", "user_id", "screenname", "is_verified", "k_out", "k_in", "rank_ci_out", "rank_ci_in", "rank_katz_rev", "rank_k_in", "client_in", "client_out")


@query
def influencer_pivot(spark, d):
    return ranking.influencer_pivot(_rankings(spark, d, 25), MEDIA)


@query
def account_status(spark, d):
    return ranking.account_status(_rankings(spark, d, 100))


# --------------------------------------------------------------------------------------------------------------- URL counts


@query
def url_totals(spark, d):
    return urlstats.url_totals(t.urls(spark, d), "thth.example.com")


@query
def host_counts(spark, d):
    return urlstats.host_counts(t.urls(spark, d))


@query
def host_perccum(spark, d):
    return _stat(t.urls(spark, d)).select("category", "hostname", "n", F.round("perccum", 9).alias("perccum"))


@query
def category_counts(spark, d):
    url = t.urls(spark, d)
    return urlstats.category_counts(url, _bridge(url)).select("key", "n_t", "n_u")


@query
def category_counts_official(spark, d):
    url = t.urls(spark, d)
    return urlstats.category_counts(url, _bridge(url)).select("key", "n_t_official", "n_u_official")


@query
def category_shares(spark, d):
    url = t.urls(spark, d)
    out = urlstats.shares(urlstats.category_counts(url, _bridge(url)), BASE_KEYS)
    return out.select("key", "n_t", F.round("r_t", 9).alias("r_t"), "n_u", F.round("r_u", 9).alias("r_u"), F.round("per_user", 9).alias("per_user"))


@query
def count_tables(spark, d):
    url = t.urls(spark, d)
    lists = {"base": MEDIA, "paired": ("com_net", "org"), "low": ("com_low", "net", "org"), "split": ("com_mobile", "com_not_mobile", "net", "org")}
    out = urlstats.count_tables(urlstats.category_counts(url, _bridge(url)), lists, ("base", "split"))
    return out.select("table", "key", "n_t", F.round("r_t", 9).alias("r_t"), "n_u", F.round("r_u", 9).alias("r_u"), F.round("per_user", 9).alias("per_user"))


@query
def study_host_sets(spark, d):
    """The study's 17 sets, over hosts dealt to its categories by the length of their names."""
    url = t.urls(spark, d).withColumn("category", F.element_at(F.array(*map(F.lit, hosts.BASE)), ((F.length("final_hostname") + 5) % len(hosts.BASE) + 1).cast("int")))
    every = url.unionByName(url.where("category = 'fake'").withColumn("category", F.lit("fake_all")))
    return hosts.bridge(hosts.host_stat(every), hosts.study_sets("m.ththth.example.net", ("thther.example.org", "ththed.example.org")))


@query
def client_proportions(spark, d):
    url = t.urls(spark, d)
    out = urlstats.client_proportions(urlstats.category_counts(url, _bridge(url)))
    return out.select("key", *[F.round(c, 9).alias(c) for c in ("share_t", "share_u", "per_user")])


@query
def user_sets(spark, d):
    url = t.urls(spark, d)
    return urlstats.user_sets(url, _bridge(url))


# ------------------------------------------------------------------------------------------------------------- time series


@query
def tweets_5min(spark, d):
    return series.binned_counts(t.tweets(spark, d), 5, "tweet_id")


@query
def users_5min(spark, d):
    return series.binned_counts(t.tweets(spark, d), 5, "user_id")


@query
def global_counts(spark, d):
    return series.global_counts(t.tweets(spark, d))


@query
def downsample_15min(spark, d):
    return series.downsample(series.binned_counts(t.tweets(spark, d), 5, "tweet_id"), 15)


@query
def influencer_activity(spark, d):
    best = ranking.top(_retweet_graph(spark, d).simple().degrees(), "k_out", 100)
    return series.activity_of(t.tweets(spark, d), best, 60)


@query
def masked_days(spark, d):
    binned = t.tweets(spark, d).withColumn("bin", series.floor_time("datetime_est", 60)).groupBy("bin").agg(F.count_distinct("tweet_id").alias("tot"))
    return series.drop_days_with_gaps(binned, 60)


@query
def category_hourly(spark, d):
    url = t.urls(spark, d)
    keyed = url.join(_bridge(url).select("key", F.col("hostname").alias("final_hostname")), "final_hostname")
    return series.binned_counts_by_key(keyed, 60, "tweet_id")


@query
def standardised_series(spark, d):
    return series.standardised(series.long_form(_hourly(spark, d))).withColumn("value", F.round("value", 6))


@query
def wide_series(spark, d):
    return _hourly(spark, d)


@query
def series_two_periods(spark, d):
    tweets = t.tweets(spark, d)
    return series.join_periods(*[series.binned_counts(edges.in_period(tweets, "datetime_est", a, b), 60, "tweet_id") for a, b in ((START, "2024-01-10"), (MIDDLE, STOP))])


@query
def wide_frame(spark, d):
    """Total activity, the camps, posts without retweets of each media category, and all posts of its influencers."""
    camps = series.with_total(_hourly(spark, d).select("bin", "pro_even", "pro_odd"), ("pro_even", "pro_odd"))
    url = t.urls(spark, d).where("retweeted_status = 0").withColumn("bin", series.floor_time("datetime_est", 60))
    media = url.groupBy("bin").agg(*[F.count_distinct(F.when(F.col("category") == m, F.col("tweet_id"))).alias(m) for m in MEDIA])
    best = _rankings(spark, d, 100).select("user_id", "media_type")
    posts = t.tweets(spark, d).withColumn("bin", series.floor_time("datetime_est", 60)).join(best, "user_id")
    infl = posts.groupBy("bin").agg(*[F.count_distinct(F.when(F.col("media_type") == m, F.col("tweet_id"))).alias(f"infl_{m}") for m in MEDIA])
    return series.wide_frame(camps, media, infl)


# ------------------------------------------------------------------------------------------------- searches and centralities


@query
def ball_r2(spark, d):
    g = _simple(spark, d)
    return traverse.ball(g.edges, g.vertices, 2)


@query
def boundary_r2(spark, d):
    g = _simple(spark, d)
    return traverse.boundary(g.edges, g.vertices, 2)


@query
def bfs_tree_r2(spark, d):
    g = _simple(spark, d)
    return traverse.bfs_tree(g.edges, g.vertices, 2)


@query
def ci_static_out(spark, d):
    return influence.static_ci(_simple(spark, d), 2, "out")


@query
def ci_static_in(spark, d):
    return influence.static_ci(_simple(spark, d), 2, "in")


@query
def ci_static_undir(spark, d):
    return influence.static_ci(_simple(spark, d), 2, "undir")


@query
def static_vertices(spark, d):
    out = influence.static_vertices(_simple(spark, d))
    return out.withColumn("katz", F.round("katz", 9)).withColumn("katz_rev", F.round("katz_rev", 9))


@query
def enriched_vertices(spark, d):
    return influence.enriched_vertices(_simple(spark, d))


@query
def enriched_katz(spark, d):
    """Of the enriched vertices what SQL can express: degrees and the converged centralities."""
    g = _simple(spark, d)
    both = [centrality.katz(x, 0.01, 1.0, 100, epsilon=1e-9).select("user_id", F.round("katz", 6).alias(n)) for x, n in ((g, "katz"), (g.reverse(), "katz_rev"))]
    return g.degrees().join(both[0], "user_id").join(both[1], "user_id")


@query
def ci_adaptive(spark, d):
    return influence.adaptive_ci(_retweet_graph(spark, d).simple().edges.withColumn("graph_id", F.lit("retweet_simple")), 2, "out")


@query
def largest_wcc(spark, d):
    return centrality.largest_component(_retweet_graph(spark, d)).withColumn("share", F.round("share", 9))


@query
def katz_fixed_iter(spark, d):
    return centrality.katz(_simple(spark, d), 0.01, 1.0, 4).withColumn("katz", F.round("katz", 9))


@query
def katz_rev_fixed_iter(spark, d):
    return centrality.katz(_simple(spark, d).reverse(), 0.01, 1.0, 4).withColumn("katz", F.round("katz", 9))


@query
def pagerank_rev(spark, d):
    return centrality.pagerank(_simple(spark, d).reverse(), 0.85, 3).withColumn("pagerank", F.round("pagerank", 9))


@query
def eigenvec(spark, d):
    return centrality.eigenvector(_simple(spark, d), 3).withColumn("eigenvec", F.round("eigenvec", 9))


# ------------------------------------------------------------------------------------------------------------ associations


@query
def corr_matrix(spark, d):
    return assoc.correlation_matrix(series.long_form(_hourly(spark, d))).withColumn("corr", F.round("corr", 6))


@query
def corr_graph(spark, d):
    out = assoc.threshold_graph(assoc.correlation_matrix(series.long_form(_hourly(spark, d))), 0.1)
    return out.select("i", "j", F.round("corr", 6).alias("corr"), F.round("width", 6).alias("width"))


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """Lagged correlations with a bound on their p-value, exp(-n r^2 / 2): the independence tests that the study takes as given."""
    long = series.long_form(_hourly(spark, d))
    a = long.select(F.col("series").alias("i"), "bin", F.col("value").alias("x"))
    lags = a.withColumn("tau", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("bin", F.expr("bin + make_interval(0, 0, 0, 0, tau, 0, 0)"))
    b = long.select(F.col("series").alias("j"), "bin", F.col("value").alias("y"))
    return lags.join(b, "bin").groupBy("i", "j", "tau").agg(F.corr("x", "y").alias("value"), F.count("*").alias("n")).withColumn("p", F.exp(-F.col("n") * F.col("value") * F.col("value") / 2))


@query
def fdr_bh(spark, d):
    return assoc.benjamini_hochberg(_tests(spark, d)).select("i", "j", "tau", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query
def fdr_two_stage(spark, d):
    return assoc.two_stage_bh(_tests(spark, d)).select("i", "j", "tau", F.round("q", 6).alias("q"))


@query
def partial_correlations(spark, d):
    out = assoc.partial_correlations(series.long_form(_hourly(spark, d)), 3, "interval 1 hour")
    return out.select("i", "j", "tau", F.round("value", 6).alias("value"), "n")


@query
def independence_tests(spark, d):
    return assoc.independence_tests(assoc.partial_correlations(series.long_form(_hourly(spark, d)), 3, "interval 1 hour"))


@query
def significant_parents(spark, d):
    return assoc.significant_parents(assoc.benjamini_hochberg(_tests(spark, d)), 0.2).select("j", "i", "tau", "place")


@query
def stl_components(spark, d):
    return decompose.stl_components(series.long_form(_hourly(spark, d)), 24)


@query
def ce_max(spark, d):
    residual = stl_components(spark, d).select("bin", "series", F.col("residual").alias("value"))
    wide = keep(series.wide_form(residual, list(SERIES)), "residuals")
    tests = assoc.significant_parents(assoc.benjamini_hochberg(_tests(spark, d)), 0.5).collect()  # at most lags * series ** 2 rows
    parents = {j: [(r["i"], r["tau"]) for r in tests if r["j"] == j] for j in SERIES}
    return assoc.causal_effects(wide, SERIES, parents, 3)


@query
def causal_graph(spark, d):
    return assoc.causal_graph(ce_max(spark, d), 0.0)


@query
def degree_bootstrap(spark, d):
    k = _retweet_graph(spark, d).simple().degrees()
    return assoc.bootstrap_degrees(k, "k_out", 78_911, 1_000)
