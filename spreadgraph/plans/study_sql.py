"""DuckDB SQL for the study's queries."""

from __future__ import annotations

#: Logical tables; each query takes those that it names.
_CTES = {
    "ev": "SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, lag(user_id) OVER (ORDER BY ts, event_id) AS prev FROM events",
    "tw": "SELECT event_id AS tweet_id, ts AS datetime_est, user_id, event_type AS source_content, event_type IN ('click', 'view') AS is_official, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS retweeted_status, k FROM ev",
    "it": "SELECT CASE event_type WHEN 'view' THEN 'retweet' WHEN 'click' THEN 'reply' WHEN 'purchase' THEN 'mention' WHEN 'signup' THEN 'quote' END AS kind, event_id AS tweet_id, prev AS src, user_id AS dst, ts, k, event_type FROM ev WHERE prev IS NOT NULL AND event_type IN ('view', 'click', 'purchase', 'signup')",
    "url": "SELECT tweet_id, user_id, regexp_extract(p.url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(regexp_extract(p.url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+)$', 1) AS category, datetime_est, retweeted_status, is_official FROM tw JOIN pages p ON tw.tweet_id % (SELECT count(*) FROM pages) = p.page_id",
    "hc": "SELECT category, host AS hostname, count(*)::BIGINT AS n FROM url GROUP BY 1, 2",
    "stat": "SELECT *, sum(n) OVER (PARTITION BY category ORDER BY n, hostname ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY category)::DOUBLE AS perccum FROM hc",
    "aggr": "SELECT DISTINCT host AS hostname FROM url WHERE host LIKE 'blog.%'",
    "rt": "SELECT src, dst, tweet_id FROM it WHERE kind = 'retweet'",
    "se": "SELECT DISTINCT src, dst FROM rt WHERE src <> dst",
    "vx": "SELECT src AS user_id FROM rt UNION SELECT dst FROM rt",
    "br": """SELECT category AS key, hostname FROM stat WHERE perccum > 0.01
      UNION SELECT 'com_low', hostname FROM stat WHERE category = 'com' AND perccum > 0.005
      UNION SELECT 'com_high', hostname FROM stat WHERE category = 'com' AND perccum > 0.08
      UNION SELECT 'com_net', hostname FROM stat WHERE category IN ('com', 'net') AND perccum > 0.01
      UNION SELECT 'com_net_org', hostname FROM stat WHERE category IN ('com', 'net', 'org') AND perccum > 0.01
      UNION SELECT 'com_mobile', hostname FROM stat WHERE category = 'com' AND hostname LIKE 'm.%'
      UNION SELECT 'com_not_mobile', hostname FROM stat WHERE category = 'com' AND perccum > 0.01 AND hostname NOT LIKE 'm.%'""",
    "cc": """SELECT key, count(DISTINCT tweet_id)::BIGINT AS n_t, count(DISTINCT user_id)::BIGINT AS n_u, count(DISTINCT CASE WHEN is_official THEN tweet_id END)::BIGINT AS n_t_official,
      count(DISTINCT CASE WHEN is_official THEN user_id END)::BIGINT AS n_u_official FROM url JOIN br ON host = hostname GROUP BY key""",
    "rk": """SELECT media_type, k_out, user_id, row_number() OVER (PARTITION BY media_type ORDER BY k_out DESC, user_id) - 1 AS rank FROM (
      SELECT category AS media_type, src AS user_id, count(*) AS k_out FROM (
        SELECT DISTINCT u.category, rt.src, rt.dst FROM rt JOIN url u USING (tweet_id) WHERE src <> dst AND u.host IN (SELECT hostname FROM stat WHERE perccum > 0.01) AND u.host NOT IN (SELECT hostname FROM aggr)
      ) GROUP BY 1, 2)""",
    "rn": "SELECT rk.*, CASE WHEN user_id % 11 = 0 THEN '@???????' ELSE 'u' || user_id END AS screenname, user_id % 5 = 0 AS is_verified FROM rk",
    "al": "SELECT DISTINCT src, dst, tweet_id, event_type AS source_content, event_type IN ('click', 'view') AS is_official FROM it",
    "b5": """SELECT time_bucket(INTERVAL 5 MINUTE, datetime_est) AS bin, count(DISTINCT tweet_id) AS t_all, count(DISTINCT CASE WHEN retweeted_status = 0 THEN tweet_id END) AS t_no, count(DISTINCT CASE WHEN is_official THEN tweet_id END) AS t_off,
      count(DISTINCT user_id) AS u_all, count(DISTINCT CASE WHEN retweeted_status = 0 THEN user_id END) AS u_no, count(DISTINCT CASE WHEN is_official THEN user_id END) AS u_off FROM tw GROUP BY 1""",
    "cal5": "SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 5 MINUTE)) AS bin FROM b5",
    "f5": "SELECT cal5.bin, coalesce(t_all, 0)::BIGINT AS t_all, coalesce(t_no, 0)::BIGINT AS t_no, coalesce(t_off, 0)::BIGINT AS t_off, coalesce(u_all, 0)::BIGINT AS u_all, coalesce(u_no, 0)::BIGINT AS u_no, coalesce(u_off, 0)::BIGINT AS u_off FROM cal5 LEFT JOIN b5 USING (bin)",
    "hb": """SELECT time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, count(DISTINCT CASE WHEN category = 'com' THEN tweet_id END) AS com, count(DISTINCT CASE WHEN category = 'net' THEN tweet_id END) AS net,
      count(DISTINCT CASE WHEN category = 'org' THEN tweet_id END) AS org, count(DISTINCT CASE WHEN user_id % 2 = 0 THEN tweet_id END) AS pro_even, count(DISTINCT CASE WHEN user_id % 2 = 1 THEN tweet_id END) AS pro_odd FROM url GROUP BY 1""",
    "hcal": "SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM hb",
    "hr": "SELECT hcal.bin, coalesce(com, 0)::BIGINT AS com, coalesce(net, 0)::BIGINT AS net, coalesce(org, 0)::BIGINT AS org, coalesce(pro_even, 0)::BIGINT AS pro_even, coalesce(pro_odd, 0)::BIGINT AS pro_odd FROM hcal LEFT JOIN hb USING (bin)",
    "lg": "UNPIVOT hr ON com, net, org, pro_even, pro_odd INTO NAME series VALUE value",
    "cm": "SELECT a.series AS i, b.series AS j, corr(a.value::DOUBLE, b.value::DOUBLE) AS corr FROM lg a JOIN lg b USING (bin) GROUP BY 1, 2",
    "ts": """SELECT a.series AS i, b.series AS j, l.tau::INTEGER AS tau, corr(a.value::DOUBLE, b.value::DOUBLE) AS value, count(*) AS n, exp(-count(*) * corr(a.value::DOUBLE, b.value::DOUBLE) ^ 2 / 2) AS p
      FROM range(1, 4) l(tau), lg a, lg b WHERE b.bin = a.bin + INTERVAL 1 HOUR * l.tau GROUP BY 1, 2, 3""",
    "bh": "SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM ts)",
    "ko": "SELECT src AS user_id, count(*) AS k FROM se GROUP BY 1",
    "ki": "SELECT dst AS user_id, count(*) AS k FROM se GROUP BY 1",
    "ue": "SELECT src, dst FROM se UNION ALL SELECT dst, src FROM se",
    "ku": "SELECT src AS user_id, count(*) AS k FROM ue GROUP BY 1",
    "l1": "SELECT DISTINCT src AS root, dst AS node FROM se",
    "l2": "SELECT DISTINCT l1.root, se.dst AS node FROM l1 JOIN se ON se.src = l1.node WHERE se.dst <> l1.root AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.root = l1.root AND x.node = se.dst)",
}
_NEEDS = {
    "tw": "ev", "it": "ev", "url": "tw", "hc": "url", "stat": "hc", "aggr": "url", "rt": "it", "se": "rt", "vx": "rt", "br": "stat", "cc": "url br", "rk": "rt url stat aggr", "rn": "rk", "al": "it", "b5": "tw", "cal5": "b5", "f5": "cal5 b5",
    "hb": "url", "hcal": "hb", "hr": "hcal hb", "lg": "hr", "cm": "lg", "ts": "lg", "bh": "ts", "ko": "se", "ki": "se", "ue": "se", "ku": "ue", "l1": "se", "l2": "l1 se",
}


def _with(names: str, body: str, extra: str = "") -> str:
    """The body with the tables that it names and those that they need."""
    wanted: set[str] = set()
    todo = names.split()
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += _NEEDS.get(n, "").split()
    listed = ", ".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in _CTES if n in wanted)
    return f"WITH {listed}{', ' + extra if extra else ''} {body}"


def _static(k: str, e: str) -> str:
    """Static influence on edges ``e`` with degrees ``k``: exact distance two."""
    one = f"a1 AS MATERIALIZED (SELECT DISTINCT src AS root, dst AS node FROM {e}), a2 AS MATERIALIZED (SELECT DISTINCT a1.root, e.dst AS node FROM a1 JOIN {e} e ON e.src = a1.node WHERE e.dst <> a1.root AND NOT EXISTS (SELECT 1 FROM a1 x WHERE x.root = a1.root AND x.node = e.dst))"
    body = f"SELECT v.user_id, coalesce(max(CASE WHEN k.k > 1 THEN k.k - 1 ELSE 0 END) * sum(f.k - 1), 0)::BIGINT AS ci FROM vx v LEFT JOIN {k} k USING (user_id) LEFT JOIN a2 ON a2.root = v.user_id LEFT JOIN {k} f ON f.user_id = a2.node GROUP BY 1"
    return _with(f"vx {k} se" + (" ue" if e == "ue" else ""), body, ("re AS (SELECT dst AS src, src AS dst FROM se), " if e == "re" else "") + one)


def _power(e: str, rounds: int, step: str, first: str, last: str) -> str:
    parts = [f"x0 AS MATERIALIZED ({first})"]
    for i in range(1, rounds + 1):
        parts.append(f"x{i} AS MATERIALIZED ({step.format(p=f'x{i - 1}')})")
    head = "re AS (SELECT dst AS src, src AS dst FROM se), " if e == "re" else ""
    return _with("vx se", last.format(x=f"x{rounds}"), head + ", ".join(parts))


def _katz(e: str, rounds: int = 4, places: int = 9) -> str:
    return _power(e, rounds, f"SELECT v.user_id, 1.0 + 0.01 * coalesce(sum(p.x), 0) AS x FROM vx v LEFT JOIN {e} e ON e.dst = v.user_id LEFT JOIN {{p}} p ON p.user_id = e.src GROUP BY 1", "SELECT user_id, 0.0::DOUBLE AS x FROM vx", f"SELECT user_id, round(x, {places}) AS katz FROM {{x}}")


_PAGERANK = """SELECT v.user_id, 0.15 / any_value(n.n) + 0.85 * (coalesce(sum(p.x / k.k), 0) + any_value(l.lost) / any_value(n.n)) AS x FROM vx v CROSS JOIN (SELECT count(*) AS n FROM vx) n
  CROSS JOIN (SELECT coalesce(sum(x), 0) AS lost FROM {p} WHERE user_id NOT IN (SELECT src FROM re)) l LEFT JOIN re e ON e.dst = v.user_id LEFT JOIN {p} p ON p.user_id = e.src LEFT JOIN (SELECT src, count(*) AS k FROM re GROUP BY 1) k ON k.src = e.src GROUP BY 1"""
_EIGEN = "SELECT user_id, x / (sqrt(sum(x * x) OVER ())) AS x FROM (SELECT v.user_id, coalesce(sum(p.x), 0) AS x FROM vx v LEFT JOIN se e ON e.dst = v.user_id LEFT JOIN {p} p ON p.user_id = e.src GROUP BY 1)"
_PERIOD = "EXISTS (SELECT 1 FROM tw WHERE tw.tweet_id = rt.tweet_id AND datetime_est >= TIMESTAMP '2024-01-01' AND datetime_est < TIMESTAMP '2024-02-01')"
_K = "SELECT user_id, coalesce(o.k, 0)::BIGINT AS k_out, coalesce(i.k, 0)::BIGINT AS k_in FROM vx LEFT JOIN {o} o USING (user_id) LEFT JOIN {i} i USING (user_id)"
_COMPLETE = _K.format(o="(SELECT src AS user_id, count(*) AS k FROM rt GROUP BY 1)", i="(SELECT dst AS user_id, count(*) AS k FROM rt GROUP BY 1)")
_SIMPLE = _K.format(o="ko", i="ki")


def _ccdf(col: str) -> str:
    return _with("vx ko ki", f"SELECT {col} AS value, round(sum(count(*)) OVER (ORDER BY {col} DESC)::DOUBLE / sum(count(*)) OVER ()::DOUBLE, 9) AS p FROM ({_SIMPLE}) GROUP BY {col}")


def _media(category: str, aggr: bool) -> str:
    but = "" if aggr else " AND host NOT IN (SELECT hostname FROM aggr)"
    return f"tweet_id IN (SELECT tweet_id FROM url WHERE host IN (SELECT hostname FROM stat WHERE category = '{category}' AND perccum > 0.01){but})"


_STATS = "SELECT count(*)::BIGINT AS n_nodes, sum(k_out)::BIGINT AS n_edges, round(avg(k_out), 9) AS mean_k, max(k_out) AS max_k_out, max(k_in) AS max_k_in, '{t}' AS graph_type FROM ({k})"
_CLIENT = "SELECT v.user_id, '{w}' AS direction, coalesce(c.source_content, 'NA') AS client FROM va v LEFT JOIN (SELECT * FROM (SELECT {e} AS user_id, source_content, row_number() OVER (PARTITION BY {e} ORDER BY count(*) DESC, source_content) AS r FROM al GROUP BY 1, 2) WHERE r = 1) c USING (user_id)"


def _set(key: str, where: str) -> str:
    return f"SELECT '{key}' AS key, hostname FROM st WHERE {where}"


_OVER = "perccum > 0.01"
_STUDY_SETS = " UNION ".join([
    *[_set(c, f"category = '{c}' AND {_OVER}") for c in ("fake", "far_right", "right", "lean_right", "center", "lean_left", "left", "far_left")],
    _set("fake_0p05perccum", "category = 'fake_all' AND perccum > 0.005"),
    _set("outlet_right", "category = 'far_right' AND hostname = 'm.ththth.example.net'"),
    _set("not_outlet_right", f"category = 'far_right' AND {_OVER} AND hostname IS DISTINCT FROM 'm.ththth.example.net'"),
    _set("outlet_left", "category = 'far_left' AND hostname IN ('thther.example.org', 'ththed.example.org')"),
    _set("not_outlet_left", f"category = 'far_left' AND {_OVER} AND hostname IS DISTINCT FROM 'thther.example.org' AND hostname IS DISTINCT FROM 'ththed.example.org'"),
    _set("fake_far_right", f"category IN ('fake', 'far_right') AND {_OVER}"),
    _set("fake_far_right_far_left", f"category IN ('fake', 'far_right', 'far_left') AND {_OVER}"),
    _set("right_lean_right", f"category IN ('right', 'lean_right') AND {_OVER}"),
    _set("left_lean_left", f"category IN ('left', 'lean_left') AND {_OVER}"),
])


def oracle_sql() -> dict[str, str]:
    return {
        "edges_retweet": _with("rt tw", "SELECT src, dst, tweet_id FROM rt WHERE tweet_id IN (SELECT tweet_id FROM tw WHERE datetime_est >= TIMESTAMP '2024-01-01' AND datetime_est < TIMESTAMP '2024-01-15')"),
        "edges_all_types": _with("it", "SELECT DISTINCT src, dst, tweet_id FROM it"),
        "edges_hashtag": _with("it", "SELECT DISTINCT src, dst, tweet_id FROM it WHERE kind IN ('retweet', 'quote') AND k % 10 IN (1, 3, 7)"),
        "edges_keyword": _with("it", "SELECT src, dst, tweet_id FROM it WHERE kind = 'reply' AND k % 7 IN (2, 5)"),
        "edges_group_incl_excl": _with("it", "SELECT DISTINCT src, dst, tweet_id FROM it WHERE k % 3 = 0"),
        "edges_query": _with("it", "SELECT src, dst, tweet_id FROM it WHERE kind = 'mention' AND k % 5 IN (1, 4)"),
        "edges_media": _with("rt tw url stat", f"SELECT src, dst, tweet_id FROM rt WHERE {_PERIOD} AND {_media('net', True)}"),
        "edges_media_not_aggr": _with("rt tw url stat aggr", f"SELECT src, dst, tweet_id FROM rt WHERE {_PERIOD} AND {_media('net', False)}"),
        "edges_with_source": _with("rt tw", "SELECT src, dst, tweet_id, source_id::INTEGER AS source_id FROM rt LEFT JOIN tw USING (tweet_id) LEFT JOIN (SELECT source_content, row_number() OVER (ORDER BY source_content) - 1 AS source_id FROM (SELECT DISTINCT source_content FROM tw)) USING (source_content)"),
        "edges_two_periods": _with("rt tw", "SELECT CASE WHEN datetime_est < TIMESTAMP '2024-01-15' THEN 'first' ELSE 'second' END AS period, count(*)::BIGINT AS n_edges, count(DISTINCT src)::BIGINT AS n_src FROM rt JOIN tw USING (tweet_id) WHERE datetime_est >= TIMESTAMP '2024-01-01' AND datetime_est < TIMESTAMP '2024-02-01' GROUP BY 1"),
        "client_map_merged": _with("tw", "SELECT source_id::INTEGER AS source_id, source_content FROM a UNION ALL SELECT ((SELECT max(source_id) FROM a) + row_number() OVER (ORDER BY source_content))::INTEGER, source_content FROM (SELECT DISTINCT source_content FROM tw WHERE source_content NOT IN (SELECT source_content FROM a))",
            "a AS (SELECT source_content, row_number() OVER (ORDER BY source_content) - 1 AS source_id FROM (SELECT DISTINCT source_content FROM tw WHERE source_content <> 'view' AND datetime_est >= TIMESTAMP '2024-01-01' AND datetime_est < TIMESTAMP '2024-01-15'))"),
        "edges_global_client": _with("it tw", "SELECT src, dst, tweet_id, (CASE WHEN source_content = 'view' THEN (SELECT count(DISTINCT source_content) - 1 FROM tw) ELSE i END)::INTEGER AS source_id FROM (SELECT DISTINCT src, dst, tweet_id FROM it) JOIN tw USING (tweet_id) LEFT JOIN (SELECT source_content, row_number() OVER (ORDER BY source_content) - 1 AS i FROM (SELECT DISTINCT source_content FROM tw WHERE source_content <> 'view')) USING (source_content)"),
        "static_vertices": f"SELECT user_id, k_out, k_in, o.ci AS ci_out, i.ci AS ci_in, k.katz AS katz, r.katz AS katz_rev FROM ({_with('vx ko ki', _SIMPLE)}) JOIN ({_static('ko', 'se')}) o USING (user_id) JOIN ({_static('ki', 're')}) i USING (user_id) JOIN ({_katz('se')}) k USING (user_id) JOIN ({_katz('re')}) r USING (user_id)",
        "category_hourly": _with("url br", "SELECT k.key, c.bin, coalesce(n_all, 0)::BIGINT AS n_all, coalesce(n_no, 0)::BIGINT AS n_no_retweet, coalesce(n_off, 0)::BIGINT AS n_official FROM (SELECT DISTINCT key FROM g) k CROSS JOIN (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM g) c LEFT JOIN g ON g.key = k.key AND g.bin = c.bin",
            "g AS (SELECT key, time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, count(DISTINCT tweet_id) AS n_all, count(DISTINCT CASE WHEN retweeted_status = 0 THEN tweet_id END) AS n_no, count(DISTINCT CASE WHEN is_official THEN tweet_id END) AS n_off FROM url JOIN br ON host = hostname GROUP BY 1, 2)"),
        "standardised_series": _with("lg", "SELECT bin, series, round((value - avg(value) OVER (PARTITION BY series)) / nullif(stddev_pop(value) OVER (PARTITION BY series), 0), 6) AS value FROM lg"),
        "graph_simple": _with("se", "SELECT src, dst FROM se"),
        "degrees": _with("vx rt", _COMPLETE),
        "network_stats": _with("vx rt ko ki", _STATS.format(t="complete", k=_COMPLETE) + " UNION ALL " + _STATS.format(t="simple", k=_SIMPLE)),
        "official_ratio": _with("al", " UNION ALL ".join(f"SELECT {e} AS user_id, '{w}' AS direction, round(avg(is_official::INTEGER), 9) AS ratio FROM al GROUP BY 1" for w, e in (("in", "dst"), ("out", "src")))),
        "main_client": _with("al", " UNION ALL ".join(_CLIENT.format(w=w, e=e) for w, e in (("in", "dst"), ("out", "src"))), "va AS (SELECT src AS user_id FROM al UNION SELECT dst FROM al)"),
        "ccdf_out": _ccdf("k_out"),
        "ccdf_in": _ccdf("k_in"),
        "top_users": _with("rt tw url stat aggr", f"SELECT (row_number() OVER (ORDER BY count(*) DESC, src) - 1)::INTEGER AS rank, src AS user_id, count(*)::BIGINT AS k_out FROM (SELECT DISTINCT src, dst FROM rt WHERE src <> dst AND {_PERIOD} AND {_media('com', False)}) GROUP BY src ORDER BY k_out DESC, user_id LIMIT 25"),
        "ranking_table": _with("vx ko ki", f"SELECT * FROM (SELECT user_id, k_out, k_in, (row_number() OVER (ORDER BY k_in DESC, user_id) - 1)::INTEGER AS rank_k_in, (row_number() OVER (ORDER BY k_out DESC, user_id) - 1)::INTEGER AS rank FROM ({_SIMPLE})) WHERE rank < 200"),
        "influencer_pivot": _with("rn", "SELECT rank::INTEGER AS rank, max(CASE WHEN media_type = 'com' THEN screenname END) AS com, max(CASE WHEN media_type = 'net' THEN screenname END) AS net, max(CASE WHEN media_type = 'org' THEN screenname END) AS org FROM rn WHERE rank < 25 GROUP BY 1"),
        "account_status": _with("rn", "SELECT media_type, sum(is_verified::INTEGER)::BIGINT AS verified, sum((screenname = '@???????')::INTEGER)::BIGINT AS deleted, (100 - sum(is_verified::INTEGER) - sum((screenname = '@???????')::INTEGER))::BIGINT AS unverified FROM rn WHERE rank < 100 GROUP BY 1"),
        "url_totals": _with("url", "SELECT count(DISTINCT tweet_id)::BIGINT AS n_tweets, count(DISTINCT user_id)::BIGINT AS n_users, count(DISTINCT CASE WHEN host <> 'thth.example.com' THEN tweet_id END)::BIGINT AS n_tweets_other, count(DISTINCT CASE WHEN host <> 'thth.example.com' THEN user_id END)::BIGINT AS n_users_other FROM url"),
        "host_counts": _with("url", "SELECT host AS hostname, count(*)::BIGINT AS n FROM url GROUP BY 1"),
        "host_perccum": _with("stat", "SELECT category, hostname, n, round(perccum, 9) AS perccum FROM stat"),
        "category_counts": _with("cc", "SELECT key, n_t, n_u FROM cc"),
        "category_counts_official": _with("cc", "SELECT key, n_t_official, n_u_official FROM cc"),
        "category_shares": _with("cc", "SELECT key, n_t, round(n_t::DOUBLE / sum(n_t) OVER ()::DOUBLE, 9) AS r_t, n_u, round(n_u::DOUBLE / sum(n_u) OVER ()::DOUBLE, 9) AS r_u, round(n_t::DOUBLE / n_u, 9) AS per_user FROM cc WHERE key IN ('com', 'net', 'org')"),
        "client_proportions": _with("cc", "SELECT key, round((n_t - n_t_official)::DOUBLE / nullif(n_t, 0), 9) AS share_t, round((n_u - n_u_official)::DOUBLE / nullif(n_u, 0), 9) AS share_u, round((n_t - n_t_official)::DOUBLE / nullif(n_u - n_u_official, 0), 9) AS per_user FROM cc"),
        "user_sets": _with("url br", "SELECT DISTINCT key, user_id FROM url JOIN br ON host = hostname"),
        "tweets_5min": _with("f5", "SELECT bin, t_all AS n_all, t_no AS n_no_retweet, t_off AS n_official FROM f5"),
        "users_5min": _with("f5", "SELECT bin, u_all AS n_all, u_no AS n_no_retweet, u_off AS n_official FROM f5"),
        "global_counts": _with("tw", "SELECT " + ", ".join(f"count(DISTINCT CASE WHEN {m} THEN {c} END)::BIGINT AS {n}_{v}" for c, n in (("tweet_id", "tweets"), ("user_id", "users")) for v, m in (("all", "true"), ("no_retweet", "retweeted_status = 0"), ("official", "is_official"))) + " FROM tw"),
        "downsample_15min": _with("f5", "SELECT time_bucket(INTERVAL 15 MINUTE, bin) AS bin, sum(t_all)::BIGINT AS n_all, sum(t_no)::BIGINT AS n_no_retweet, sum(t_off)::BIGINT AS n_official FROM f5 GROUP BY 1"),
        "influencer_activity": _with("tw vx ko", """SELECT c.bin, coalesce(n_all, 0)::BIGINT AS n_all, coalesce(n_no, 0)::BIGINT AS n_no_retweet, coalesce(n_off, 0)::BIGINT AS n_official FROM (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM g) c LEFT JOIN g USING (bin)""",
            """g AS (SELECT time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, count(DISTINCT tweet_id) AS n_all, count(DISTINCT CASE WHEN retweeted_status = 0 THEN tweet_id END) AS n_no, count(DISTINCT CASE WHEN is_official THEN tweet_id END) AS n_off
            FROM tw WHERE user_id IN (SELECT user_id FROM vx LEFT JOIN ko USING (user_id) ORDER BY coalesce(k, 0) DESC, user_id LIMIT 100) GROUP BY 1)"""),
        "masked_days": _with("tw", "SELECT c.bin, tot FROM c LEFT JOIN g USING (bin) WHERE date_trunc('day', c.bin - INTERVAL 4 HOUR) NOT IN (SELECT date_trunc('day', c.bin - INTERVAL 4 HOUR) FROM c LEFT JOIN g USING (bin) WHERE tot IS NULL)",
            "g AS (SELECT time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, count(DISTINCT tweet_id)::BIGINT AS tot FROM tw GROUP BY 1), c AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM g)"),
        "wide_series": _with("hr", "SELECT * FROM hr"),
        "ball_r2": _with("l1 l2", "SELECT root, node FROM l1 UNION SELECT root, node FROM l2"),
        "boundary_r2": _with("l2", "SELECT root, node FROM l2"),
        "bfs_tree_r2": _with("l1 l2 se", "SELECT root, root AS src, node AS dst FROM l1 UNION ALL SELECT l2.root, min(se.src) AS src, l2.node AS dst FROM l2 JOIN se ON se.dst = l2.node JOIN l1 ON l1.root = l2.root AND l1.node = se.src GROUP BY l2.root, l2.node"),
        "ci_static_out": _static("ko", "se"),
        "ci_static_in": _static("ki", "re"),
        "ci_static_undir": _static("ku", "ue"),
        "largest_wcc": _with("rt vx", "SELECT min(c) AS component, size::BIGINT AS size, round(size::DOUBLE / (SELECT count(*) FROM vx), 9) AS share FROM (SELECT c, count(*) AS size FROM comp GROUP BY c) GROUP BY size ORDER BY size DESC LIMIT 1",
            "sym AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM rt UNION SELECT dst, src FROM rt), comp AS (WITH RECURSIVE r(a, b) AS (SELECT user_id, user_id FROM vx UNION SELECT r.a, sym.b FROM r JOIN sym ON sym.a = r.b) SELECT a, min(b) AS c FROM r GROUP BY a)"),
        "enriched_katz": f"SELECT user_id, k_out, k_in, k.katz AS katz, r.katz AS katz_rev FROM ({_with('vx ko ki', _SIMPLE)}) JOIN ({_katz('se', 16, 6)}) k USING (user_id) JOIN ({_katz('re', 16, 6)}) r USING (user_id)",
        "top_rank_table": "SELECT rank::INTEGER AS rank, user_id, CASE WHEN user_id % 11 = 0 THEN '@???????' ELSE 'u' || user_id END AS screenname, user_id % 5 = 0 AS is_verified, k_out, k_in, rank_ci_out::INTEGER AS rank_ci_out, rank_ci_in::INTEGER AS rank_ci_in, rank_katz_rev::INTEGER AS rank_katz_rev, rank_k_in::INTEGER AS rank_k_in, ci.client AS client_in, co.client AS client_out FROM (SELECT *, "
        + ", ".join(f"row_number() OVER (ORDER BY {c} DESC, user_id) - 1 AS {n}" for c, n in (("k_out", "rank"), ("ci_out", "rank_ci_out"), ("ci_in", "rank_ci_in"), ("katz_rev", "rank_katz_rev"), ("k_in", "rank_k_in")))
        + f" FROM (SELECT user_id, k_out, k_in, o.ci AS ci_out, i.ci AS ci_in, r.katz AS katz_rev FROM ({_with('vx ko ki', _SIMPLE)}) JOIN ({_static('ko', 'se')}) o USING (user_id) JOIN ({_static('ki', 're')}) i USING (user_id) JOIN ({_katz('re')}) r USING (user_id)))"
        + "".join(f" LEFT JOIN ({_with('al', _CLIENT.format(w=w, e=e), 'va AS (SELECT src AS user_id FROM al UNION SELECT dst FROM al)')}) {a} USING (user_id)" for w, e, a in (("in", "dst", "ci"), ("out", "src", "co"))) + " WHERE rank < 200",
        "count_tables": _with("cc", "SELECT t.name AS table, key, n_t, round(n_t::DOUBLE / sum(n_t) OVER (PARTITION BY t.name)::DOUBLE, 9) AS r_t, n_u, round(n_u::DOUBLE / sum(n_u) OVER (PARTITION BY t.name)::DOUBLE, 9) AS r_u, round(n_t::DOUBLE / nullif(n_u, 0), 9) AS per_user FROM t JOIN both_c USING (key, off)",
            "both_c AS (SELECT key, n_t, n_u, false AS off FROM cc UNION ALL SELECT key, n_t_official, n_u_official, true FROM cc), t AS (SELECT * FROM (VALUES ('base', 'com', false), ('base', 'net', false), ('base', 'org', false), ('paired', 'com_net', false), ('paired', 'org', false), ('low', 'com_low', false), ('low', 'net', false), ('low', 'org', false), ('split', 'com_mobile', false), ('split', 'com_not_mobile', false), ('split', 'net', false), ('split', 'org', false), ('base_official', 'com', true), ('base_official', 'net', true), ('base_official', 'org', true), ('split_official', 'com_mobile', true), ('split_official', 'com_not_mobile', true), ('split_official', 'net', true), ('split_official', 'org', true)) v(name, key, off))"),
        "study_host_sets": _with("url", _STUDY_SETS, "dealt AS (SELECT host, ['fake', 'far_right', 'right', 'lean_right', 'center', 'lean_left', 'left', 'far_left'][(length(host) + 5) % 8 + 1] AS category FROM url), every AS (SELECT * FROM dealt UNION ALL SELECT host, 'fake_all' FROM dealt WHERE category = 'fake'), "
            "st AS (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY n, hostname ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY category)::DOUBLE AS perccum FROM (SELECT category, host AS hostname, count(*)::BIGINT AS n FROM every GROUP BY 1, 2))"),
        "series_two_periods": _with("tw", "SELECT c.bin, coalesce(n_all, 0)::BIGINT AS n_all, coalesce(n_no, 0)::BIGINT AS n_no_retweet, coalesce(n_off, 0)::BIGINT AS n_official FROM (SELECT p, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM g GROUP BY p) c LEFT JOIN g USING (p, bin)",
            "g AS (SELECT CASE WHEN datetime_est < TIMESTAMP '2024-01-10' THEN 1 ELSE 2 END AS p, time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, count(DISTINCT tweet_id) AS n_all, count(DISTINCT CASE WHEN retweeted_status = 0 THEN tweet_id END) AS n_no, count(DISTINCT CASE WHEN is_official THEN tweet_id END) AS n_off FROM tw "
            "WHERE datetime_est >= TIMESTAMP '2024-01-01' AND datetime_est < TIMESTAMP '2024-01-10' OR datetime_est >= TIMESTAMP '2024-01-15' AND datetime_est < TIMESTAMP '2024-02-01' GROUP BY 1, 2)"),
        "wide_frame": _with("hr url rk tw", "SELECT hr.bin, pro_even, pro_odd, pro_even + pro_odd AS tot, " + ", ".join(f"coalesce(m.{c}, 0)::BIGINT AS {c}, coalesce(f.{c}, 0)::BIGINT AS infl_{c}" for c in ("com", "net", "org")) + " FROM hr LEFT JOIN m USING (bin) LEFT JOIN f USING (bin)",
            "m AS (SELECT time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, " + ", ".join(f"count(DISTINCT CASE WHEN category = '{c}' THEN tweet_id END) AS {c}" for c in ("com", "net", "org")) + " FROM url WHERE retweeted_status = 0 GROUP BY 1), "
            "f AS (SELECT time_bucket(INTERVAL 1 HOUR, datetime_est) AS bin, " + ", ".join(f"count(DISTINCT CASE WHEN media_type = '{c}' THEN tweet_id END) AS {c}" for c in ("com", "net", "org")) + " FROM tw JOIN (SELECT * FROM rk WHERE rank < 100) k USING (user_id) GROUP BY 1)"),
        "partial_correlations": _with("lg", "SELECT i, j, tau, round(CASE WHEN i <> j OR tau <> 1 THEN (xy - xz * yz) / nullif(sqrt((1 - xz ^ 2) * (1 - yz ^ 2)), 0) END, 6) AS value, n FROM r",
            "r AS (SELECT a.series AS i, b.series AS j, l.tau::INTEGER AS tau, corr(a.value::DOUBLE, b.value::DOUBLE) AS xy, corr(a.value::DOUBLE, z.value::DOUBLE) AS xz, corr(b.value::DOUBLE, z.value::DOUBLE) AS yz, count(*)::BIGINT AS n FROM range(1, 4) l(tau), lg a, lg b, lg z WHERE b.bin = a.bin + INTERVAL 1 HOUR * l.tau AND z.series = b.series AND b.bin = z.bin + INTERVAL 1 HOUR GROUP BY 1, 2, 3)"),
        "katz_fixed_iter": _katz("se"),
        "katz_rev_fixed_iter": _katz("re"),
        "pagerank_rev": _power("re", 3, _PAGERANK, "SELECT user_id, 1.0::DOUBLE / (SELECT count(*) FROM vx) AS x FROM vx", "SELECT user_id, round(x, 9) AS pagerank FROM {x}"),
        "eigenvec": _power("se", 3, _EIGEN, "SELECT user_id, 1.0::DOUBLE AS x FROM vx", "SELECT user_id, round(x, 9) AS eigenvec FROM {x}"),
        "corr_matrix": _with("cm", "SELECT i, j, round(corr, 6) AS corr FROM cm"),
        "corr_graph": _with("cm", "SELECT i, j, round(corr, 6) AS corr, round(corr / max(corr) OVER (), 6) AS width FROM cm WHERE i < j AND corr > 0.1"),
        "fdr_bh": _with("bh", "SELECT i, j, tau, round(p, 6) AS p, round(q, 6) AS q FROM bh"),
        "fdr_two_stage": _with("bh", "SELECT i, j, tau, round(least(1.0, q * (count(*) OVER () - sum((q <= 0.05 / 1.05)::INTEGER) OVER ())::DOUBLE / count(*) OVER () * 1.05), 6) AS q FROM bh"),
        "significant_parents": _with("bh", "SELECT j, i, tau, (row_number() OVER (PARTITION BY j ORDER BY abs(value) DESC, i, tau) - 1)::INTEGER AS place FROM bh WHERE q <= 0.2"),
    }
