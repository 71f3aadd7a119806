"""Aggregates, windows, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering
from ..operators.merge import latest
from ..plans import dataset
from ..plans.entities import keyword_retrieval, numeric_claims, weighted_mean
from ..plans.facts import METRICS, cagr, fiscal_rank, first_value_wins, wide_years, year
from ..plans.models import cv_metrics, fold_baselines, fold_errors, gram, scoreboard, vocabulary
from ..plans.outcomes import outcomes, sessions
from ..plans.risks import dedupe_max, heatmap, penalty_score, severity_counts, specificity
from ..plans.analysis import growth_steps, ratios
from .base import (GAPPED, LISTINGS, PAGES, PRICES, SUBSCRIPTION, WIDE, day, facts, fiscal_series, gapped_pages,
                   listings, prices, query, subscription, table, texts)


@query("outcomes", f"""
WITH {PRICES}, {LISTINGS},
s AS (SELECT p.*, l.listing_date, l.offer, l.listing_gain,
    row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS session
  FROM prices p JOIN listings l USING (symbol) WHERE session_date >= listing_date - 1),
a AS (SELECT symbol, listing_date, offer, listing_gain, count(*) AS n, arg_min(close, session_date) AS day1,
    min(session_date) AS first_day, arg_max(close, session_date) AS last_close, max(session_date) AS last_day,
    count(*) FILTER (session_date <= listing_date + 14) AS n12,
    max(session_date) FILTER (session_date <= listing_date + 14) AS last12,
    min((close, session, session_date)) FILTER (session_date <= listing_date + 14) AS bot,
    max((session_date, close)) FILTER (session_date <= listing_date + 7) AS h6,
    max((session_date, close)) FILTER (session_date <= listing_date + 14) AS h12,
    max((session_date, close)) FILTER (session_date <= listing_date + 28) AS h24 FROM s GROUP BY 1, 2, 3, 4),
f AS (SELECT *, coalesce(1 + listing_gain / 100, day1 / offer) AS base,
    last_day < least(listing_date + 32, DATE '2024-01-31') - 3 AS delisted, n12 >= 5 AS has_bottom
  FROM a WHERE n >= 5 AND offer > 0 AND first_day - listing_date <= 4),
g AS (SELECT *, has_bottom AND (delisted OR last12 >= listing_date + 12) AS final_bottom FROM f),
pk AS (SELECT s.symbol, max((s.close, -s.session)) AS peak FROM s JOIN g ON s.symbol = g.symbol AND g.final_bottom
    AND s.session_date >= g.bot[3] AND s.session_date <= s.listing_date + 28 GROUP BY 1)
SELECT symbol, strftime(listing_date, '%Y-%m-%d') AS listing_date, offer AS issue_price,
  round((base * (day1 / day1) - 1) * 100, 6) AS ret_1d,
  CASE WHEN h6[1] >= listing_date + 5 OR delisted THEN round((base * (h6[2] / day1) - 1) * 100, 6) END AS ret_6m,
  CASE WHEN h12[1] >= listing_date + 12 OR delisted THEN round((base * (h12[2] / day1) - 1) * 100, 6) END AS ret_12m,
  CASE WHEN h24[1] >= listing_date + 26 OR delisted THEN round((base * (h24[2] / day1) - 1) * 100, 6) END AS ret_24m,
  round((base * (last_close / day1) - 1) * 100, 6) AS current_ret, delisted,
  strftime(last_day, '%Y-%m-%d') AS last_date,
  CASE WHEN has_bottom THEN round((base * (bot[1] / day1) - 1) * 100, 6) END AS bottom_so_far_pct,
  CASE WHEN has_bottom THEN bot[2] END AS bottom_so_far_session,
  CASE WHEN final_bottom THEN round((base * (bot[1] / day1) - 1) * 100, 6) END AS bottom_12m_pct,
  CASE WHEN final_bottom THEN bot[2] END AS sessions_to_bottom,
  round((base * (peak[1] / day1) - 1) * 100, 6) AS peak_24m_pct, -peak[2] AS sessions_to_peak
FROM g LEFT JOIN pk USING (symbol)""")
def outcomes_q(spark, sf):
    out = outcomes(prices(spark, sf), listings(spark, sf), F.lit("2024-01-31").cast("date"),
                   {"ret_6m": 7, "ret_12m": 14, "ret_24m": 28}, tolerance=2, lead=1, min_closes=5, max_gap=4,
                   bottom_days=14, bottom_min=5, bottom_final=12, peak_days=28, delisted_gap=3, window_days=32,
                   decimals=6)
    return out.withColumns({"listing_date": day("listing_date"), "last_date": day("last_date")})


@query("sessions", f"""
WITH {PRICES} SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date,
  row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS session FROM prices""")
def sessions_q(spark, sf):
    return sessions(prices(spark, sf)).select("symbol", day("session_date").alias("session_date"), "session")


@query("bottom_peak", f"""
WITH {PRICES}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS i FROM prices)
SELECT symbol, min((close, i))[1] AS bottom, min((close, i))[2] AS bottom_session, max((close, -i))[1] AS peak,
  -max((close, -i))[2] AS peak_session FROM s GROUP BY 1""")
def bottom_peak(spark, sf):
    s = sessions(prices(spark, sf))
    out = s.groupBy("symbol").agg(
        F.min(F.struct("close", "session")).alias("b"),
        F.max(F.struct(F.col("close").alias("c"), (-F.col("session")).alias("s"))).alias("p"))
    return out.select("symbol", F.col("b.close").alias("bottom"), F.col("b.session").alias("bottom_session"),
                      F.col("p.c").alias("peak"), (-F.col("p.s")).alias("peak_session"))


@query("value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def value_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("medians", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'all', 'all', round(median(l_extendedprice), 4) FROM lineitem""")
def medians(spark, sf):
    li = table(spark, sf, "lineitem")
    by = ordering.exact_quantile(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.5, "mid")
    whole = ordering.exact_quantile(li, [], "l_extendedprice", 0.5, "mid") \
        .select(F.lit("all").alias("l_returnflag"), F.lit("all").alias("l_linestatus"), "mid")
    return by.unionByName(whole).withColumn("mid", F.round("mid", 4))


@query("win_rate", f"""
WITH {SUBSCRIPTION} SELECT o_orderpriority, round(avg(CASE WHEN net > o_totalprice THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  count(*) AS n FROM subscription WHERE net IS NOT NULL GROUP BY 1""")
def win_rate(spark, sf):
    s = subscription(spark, sf).filter(F.col("net").isNotNull())
    return s.groupBy("o_orderpriority").agg(
        F.round(F.avg(F.when(F.col("net") > F.col("o_totalprice"), 1.0).otherwise(0.0)), 6).alias("win_rate"),
        F.count("*").alias("n"))


_BOARD = f"""{SUBSCRIPTION}, c AS (SELECT CASE WHEN qib > retail THEN 'BUY-CANDIDATE' WHEN qib <= retail THEN 'no' END AS says,
  CASE WHEN nii > 20 THEN net / o_totalprice - 1 END AS ret_6m, CASE WHEN nii > 40 THEN net / o_totalprice - 1.1 END AS ret_12m
  FROM subscription),
u AS (SELECT says, 'ret_6m' AS horizon, ret_6m AS r FROM c UNION ALL SELECT says, 'ret_12m', ret_12m FROM c)"""


@query("scoreboard", f"""
WITH {_BOARD}, g AS (SELECT horizon, count(*) FILTER (says = 'BUY-CANDIDATE') AS n_rule, count(*) FILTER (says = 'no') AS n_rest,
    median(r) FILTER (says = 'BUY-CANDIDATE') AS rm, median(r) FILTER (says = 'no') AS sm,
    avg((r > 0)::INT) FILTER (says = 'BUY-CANDIDATE') AS rw, avg((r > 0)::INT) FILTER (says = 'no') AS sw
  FROM u WHERE r IS NOT NULL GROUP BY 1)
SELECT horizon, n_rule, n_rest, round(rm, 6) AS rule_median, round(sm, 6) AS rest_median, round(rw, 6) AS rule_win_rate,
  round(sw, 6) AS rest_win_rate, round(rm - sm, 6) AS edge_pp FROM g WHERE n_rule >= 5""")
def scoreboard_q(spark, sf):
    s = subscription(spark, sf)
    ratio = F.col("net") / F.nullif("o_totalprice", F.lit(0.0))
    calls = s.select(
        F.when(F.col("qib") > F.col("retail"), "BUY-CANDIDATE").when(F.col("qib") <= F.col("retail"), "no").alias("rule_says"),
        F.when(F.col("nii") > 20, ratio - 1).alias("ret_6m"), F.when(F.col("nii") > 40, ratio - 1.1).alias("ret_12m"))
    out = scoreboard(calls, ["ret_6m", "ret_12m"])
    return out.select("horizon", "n_rule", "n_rest", *[F.round(c, 6).alias(c) for c in (
        "rule_median", "rest_median", "rule_win_rate", "rest_win_rate", "edge_pp")])


@query("weighted_mean", """
SELECT l_orderkey, CASE WHEN sum(l_quantity) FILTER (l_returnflag <> 'R') > 0 OR max(l_linenumber) = 7 THEN
  CAST(round(CAST(coalesce(max(l_tax * 100) FILTER (l_linenumber = 7), sum(l_discount * 100 * l_quantity) FILTER (l_returnflag <> 'R')
  / sum(l_quantity) FILTER (l_returnflag <> 'R')) AS DECIMAL(38,8)), 2) AS DOUBLE) END AS value FROM lineitem GROUP BY 1""")
def weighted_mean_q(spark, sf):
    li = table(spark, sf, "lineitem")
    fiscal = F.col("l_returnflag") != "R"
    return weighted_mean(li, ["l_orderkey"], F.when(F.col("l_linenumber") == 7, F.col("l_tax") * 100),
                         F.when(fiscal, F.col("l_discount") * 100), F.when(fiscal, F.col("l_quantity")))


_SEV = "CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END"


def _findings(spark, sf):
    q = F.col("l_quantity")
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("class_"), "l_returnflag").alias("risk_type"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(q > 45, "critical").when(q > 30, "high").when(q > 10, "medium").otherwise("low").alias("severity"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_quantity")).cast("bigint").alias("ord"))


_FIND = f"""f AS (SELECT l_suppkey AS doc_id, 'class_' || l_returnflag AS risk_type, 'line ' || l_linenumber AS title,
  {_SEV} AS severity, CAST(l_orderkey * 1000000 + l_partkey * 100 + l_quantity AS BIGINT) AS ord FROM lineitem),
fr AS (SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS r FROM f)"""


@query("dedupe_max", f"""
WITH {_FIND} SELECT doc_id, risk_type, title, arg_max(severity, (r, -ord)) AS severity, arg_max(ord, (r, -ord)) AS ord
FROM fr GROUP BY 1, 2, 3""")
def dedupe_max_q(spark, sf):
    return dedupe_max(_findings(spark, sf), ["doc_id", "risk_type"], "title", "severity", "ord") \
        .select("doc_id", "risk_type", "title", "severity", "ord")


@query("heatmap", f"""
WITH {_FIND}, k AS (SELECT unnest(['class_A', 'class_N', 'class_R', 'class_X']) AS risk_type),
g AS (SELECT doc_id, risk_type, max(r) AS r, count(*) AS c FROM fr GROUP BY 1, 2)
SELECT s_suppkey AS doc_id, k.risk_type, CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium'
  WHEN 0 THEN 'low' ELSE 'none' END AS severity, coalesce(c, 0) AS count
FROM supplier, k LEFT JOIN g ON g.doc_id = s_suppkey AND g.risk_type = k.risk_type""")
def heatmap_q(spark, sf):
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    return heatmap(_findings(spark, sf), docs, ["class_A", "class_N", "class_R", "class_X"])


@query("penalty_score", """
WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_quantity > 45 THEN 18 WHEN l_quantity > 30 THEN 10 WHEN l_quantity > 10 THEN 4 ELSE 1 END) AS p
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, greatest(0.0, 100.0 - coalesce(p, 0))::DOUBLE AS risk_score FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def penalty_score_q(spark, sf):
    q = F.col("l_quantity")
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(q > 45, "critical").when(
        q > 30, "high").when(q > 10, "medium").otherwise("low").alias("severity"))
    return penalty_score(f, table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")))


@query("severity_pivot", f"""
WITH {_FIND} SELECT doc_id, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM f GROUP BY 1""")
def severity_pivot(spark, sf):
    return severity_counts(_findings(spark, sf))


@query("margin_stability", f"""
WITH {WIDE}, m AS (SELECT doc_id, pat / nullif(revenue, 0) AS nm FROM wide)
SELECT doc_id, CASE WHEN count(nm) >= 2 THEN round(stddev_pop(nm) * 100, 4) END AS spread FROM m GROUP BY 1""")
def margin_stability(spark, sf):
    from ..functions.scalars import array_pstdev

    r = ratios(fiscal_series(spark, sf))
    net = F.filter(F.transform("margin_series", lambda m: m["net_margin"]), lambda x: x.isNotNull())
    return r.select("doc_id", F.when(F.size(net) >= 2, F.round(array_pstdev(net) * 100, 4)).alias("spread"))


@query("specificity", r"""
WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\n'), lambda x: length(trim(x)) > 200) AS paras FROM documents),
c AS (SELECT doc_id, len(paras) AS total_factors, len(list_filter(paras, lambda x: regexp_matches(x, '[0-9]+|%'))) AS specific FROM p)
SELECT doc_id, total_factors, specific, CAST(round(CAST(specific / nullif(total_factors::DOUBLE, 0) AS DECIMAL(38,8)), 2) AS DOUBLE) AS specificity_ratio FROM c""")
def specificity_q(spark, sf):
    return texts(spark, sf).select("doc_id", *specificity(F.col("text"), r"\n", 200, "[0-9]+|%"))


@query("hit_rate", """
WITH d AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS lang), s AS (SELECT DISTINCT source FROM documents),
h AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 9000)
SELECT source, round(avg(CASE WHEN h.lang IS NULL THEN 0.0 ELSE 1.0 END), 4) AS section_hit_rate
FROM s CROSS JOIN d LEFT JOIN h USING (source, lang) GROUP BY 1""")
def hit_rate_q(spark, sf):
    from ..plans.sections import hit_rate

    langs = ["en", "fr", "de", "es"]
    d = table(spark, sf, "documents")
    has = d.groupBy("source").agg(*[F.max(((F.col("lang") == c) & (F.col("n_chars") > 9000)).cast("int")).alias(c) for c in langs])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), (F.col(c) == 1).alias("found")) for c in langs]))
    sections = has.select(F.col("source").alias("doc_id"), cells.alias("c")).select("doc_id", "c.*")
    return hit_rate(sections, langs).select(F.col("doc_id").alias("source"), F.round("section_hit_rate", 4).alias("section_hit_rate"))


@query("mention_counts", r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, 'the ')) AS mentions,
  list_distinct(list_filter(list_transform(regexp_extract_all(text, '([0-9]{1,3})[^0-9]', 1), lambda x: CAST(x AS INT)), lambda x: x >= 3)) AS c
  FROM documents)
SELECT doc_id, mentions, array_to_string(list_slice(list_reverse_sort(c), 1, 6), ',') AS claims FROM d""")
def mention_counts(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"([0-9]{1,3})[^0-9]"), 1)
    return texts(spark, sf).select(
        "doc_id", F.regexp_count("text", F.lit("the ")).cast("bigint").alias("mentions"),
        F.array_join(F.transform(numeric_claims(found, 3, 6), lambda x: x.cast("string")), ",").alias("claims"))


_QUESTION = "What does the company mention about tion, ment, elle and ing, and how often does it mention tion?"
_TERMS = ["mention", "about", "tion", "ment", "elle", "ing", "often", "mention", "tion"]
_SCORE = " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) / {len(w)}" for w in _TERMS)


@query("keyword_retrieval", f"""
WITH d AS (SELECT doc_id, source, text, lower(text) AS low FROM documents),
s AS (SELECT *, CAST(round({_SCORE}) AS BIGINT) AS score, coalesce(list_min(list_filter(list_transform(
    {sorted(set(_TERMS))}, lambda w: instr(low, w)), lambda p: p > 0)), 1) AS spot FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT source, doc_id, score, rank, md5(substr(text, greatest(spot - 500, 1), 4000)) AS excerpt FROM r WHERE rank <= 4""")
def keyword_retrieval_q(spark, sf):
    d = texts(spark, sf).select("doc_id", "source", "text")
    out = keyword_retrieval(d, _QUESTION, ["source"], "doc_id")
    return out.select("source", "doc_id", "score", "rank", F.md5(F.encode("excerpt", "UTF-8")).alias("excerpt"))


@query("growth_steps", f"""
WITH {WIDE}, l AS (SELECT doc_id, revenue, cfo, lag(revenue) OVER (PARTITION BY doc_id ORDER BY fy) AS prev, rk FROM ranked)
SELECT doc_id, CASE WHEN count(*) >= 2 THEN count(*) FILTER (revenue > prev) END AS ups,
  count(*) FILTER (cfo > 0) AS cfo_positive FROM l GROUP BY 1""")
def growth_steps_q(spark, sf):
    s = fiscal_series(spark, sf)
    return s.select("doc_id", growth_steps("revenue").cast("bigint").alias("ups"),
                    F.size(F.filter("years", lambda y: y["cfo"] > 0)).cast("bigint").alias("cfo_positive"))


_CV = f"""{SUBSCRIPTION}, e AS (SELECT (o_orderkey * 7 % 6)::INT AS fold, net / o_totalprice AS y,
    0.8 + qib / 400 AS p FROM subscription WHERE net IS NOT NULL AND qib IS NOT NULL),
b AS (SELECT k.fold, (SELECT avg(y) FROM e WHERE e.fold < k.fold) AS base FROM (SELECT DISTINCT fold FROM e WHERE fold > 0) k),
fe AS (SELECT e.fold, count(*) AS n, avg(abs(p - y)) AS mae, avg(abs(base - y)) AS base_mae FROM e JOIN b USING (fold) GROUP BY 1)"""


def _cv(spark, sf):
    s = subscription(spark, sf).filter(F.col("net").isNotNull() & F.col("qib").isNotNull())
    e = s.select((F.col("o_orderkey") * 7 % 6).cast("int").alias("fold"),
                 (F.col("net") / F.nullif("o_totalprice", F.lit(0.0))).alias("y"), (0.8 + F.col("qib") / 400).alias("p"))
    return fold_errors(e, fold_baselines(e, "fold", "y"), "fold", "y", "p")


@query("cv_metrics", f"""
WITH {_CV} SELECT round(sum(mae * n) / sum(n), 6) AS error, round(avg(base_mae), 6) AS baseline,
  round(stddev_samp(mae) / sqrt(count(*)), 6) AS se, round(avg(base_mae - mae), 6) AS edge,
  round(stddev_samp(base_mae - mae) / sqrt(count(*)), 6) AS edge_se, count(*) FILTER (base_mae > mae) AS folds_won,
  count(*) AS folds FROM fe""")
def cv_metrics_q(spark, sf):
    m = cv_metrics(_cv(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in ("error", "baseline", "se", "edge", "edge_se")], "folds_won", "folds")


@query("gram", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS s_q, round(sum(l_discount), 2) AS s_d, round(sum(l_quantity * l_quantity), 2) AS qq,
  round(sum(l_quantity * l_discount), 2) AS qd, round(sum(l_discount * l_discount), 4) AS dd,
  round(sum(l_quantity * l_tax), 2) AS qy, round(sum(l_discount * l_tax), 4) AS dy FROM lineitem""")
def gram_q(spark, sf):
    g = gram(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_tax")
    pick = {"s_q": ("one__l_quantity", 2), "s_d": ("one__l_discount", 2), "qq": ("l_quantity__l_quantity", 2),
            "qd": ("l_quantity__l_discount", 2), "dd": ("l_discount__l_discount", 4), "qy": ("l_quantity__y", 2),
            "dy": ("l_discount__y", 4)}
    return g.select("n", *[F.round(c, d).alias(k) for k, (c, d) in pick.items()])


@query("vocab", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL AND p_type <> 'Other' ORDER BY 1")
def vocab_q(spark, sf):
    return vocabulary(table(spark, sf, "part"), "p_type")


@query("shares", """
SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY c_nationkey), 6) AS share
FROM customer GROUP BY 1, 2""")
def shares(spark, sf):
    parts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    total = F.sum("v").over(Window.partitionBy("c_nationkey"))
    return parts.select("c_nationkey", "c_mktsegment", F.round(F.col("v") / total, 6).alias("share"))


@query("span", """
SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM orders""")
def span(spark, sf):
    return table(spark, sf, "orders").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"))


# ------------------------------------------------------------------ windows

@query("dedupe_first_last", """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def dedupe_first_last(spark, sf):
    c = table(spark, sf, "conversations")
    first = latest(c, ["conv_id"], [F.col("turn")]).select("conv_id", F.col("role").alias("first_role"))
    last = latest(c, ["conv_id"], [F.col("turn").desc()]).select("conv_id", F.col("role").alias("last_role"), F.col("turn").alias("last_turn"))
    return first.join(last, "conv_id")


@query("stratified_queue", f"""
WITH {SUBSCRIPTION}, q AS (SELECT o_orderkey, opened, year(opened) AS year,
    CASE WHEN qib IS NOT NULL THEN 3 WHEN retail IS NOT NULL THEN 2 WHEN nii IS NOT NULL THEN 1 ELSE 0 END AS weight FROM subscription)
SELECT o_orderkey, year, weight, row_number() OVER (PARTITION BY year ORDER BY weight DESC, opened DESC, o_orderkey) - 1 AS rank_in_year
FROM q WHERE weight > 0""")
def stratified_queue_q(spark, sf):
    s = subscription(spark, sf)
    staged = s.select("o_orderkey", "opened", dataset.maturity_weight(
        F.col("nii"), F.col("retail"), F.col("qib")).alias("weight")).filter("weight > 0")
    return dataset.stratified_queue(staged, "opened", "weight", "o_orderkey").select(
        "o_orderkey", "year", "weight", "rank_in_year")


@query("fiscal_rank", f"WITH {WIDE} SELECT doc_id, fy, revenue, rk AS fiscal_rank FROM ranked")
def fiscal_rank_q(spark, sf):
    f = facts(spark, sf).filter("metric = 'revenue'")
    return fiscal_rank(f).select("doc_id", "fy", F.col("value").alias("revenue"), "fiscal_rank")


_YOY = ["revenue", "receivables", "pat", "cfo", "total_assets", "net_worth", "total_debt", "current_assets", "current_liabilities"]


@query("yoy", f"""
WITH {WIDE} SELECT t0.doc_id, {', '.join(f't0.{m} AS {m}_t, t1.{m} AS {m}_p' for m in _YOY)} FROM t0 LEFT JOIN t1 USING (doc_id)""")
def yoy(spark, sf):
    s = fiscal_series(spark, sf)
    return s.select("doc_id", *[year(m, k).alias(f"{m}_{n}") for m in _YOY for k, n in ((0, "t"), (1, "p"))])


@query("cagr", f"""
WITH {WIDE} SELECT t0.doc_id, CASE WHEN t0.n_years >= 2 AND t0.revenue > 0 AND told.revenue > 0 THEN
    round(pow(t0.revenue / told.revenue, 1.0 / (t0.n_years - 1)) - 1, 6) END AS revenue_cagr,
  CASE WHEN t0.n_years >= 2 AND t0.pat > 0 AND told.pat > 0 THEN round(pow(t0.pat / told.pat, 1.0 / (t0.n_years - 1)) - 1, 6) END AS pat_cagr
FROM t0 JOIN told USING (doc_id)""")
def cagr_q(spark, sf):
    return fiscal_series(spark, sf).select("doc_id", F.round(cagr("revenue"), 6).alias("revenue_cagr"),
                                           F.round(cagr("pat"), 6).alias("pat_cagr"))


@query("margin_series", f"""
WITH {WIDE} SELECT doc_id, fy, round(pat / nullif(revenue, 0), 6) AS net_margin, round(ebitda / nullif(revenue, 0), 6) AS operating_margin FROM wide""")
def margin_series(spark, sf):
    w = wide_years(facts(spark, sf), METRICS)
    return w.select("doc_id", "fy", F.round(F.col("pat") / F.nullif("revenue", F.lit(0.0)), 6).alias("net_margin"),
                    F.round(F.col("ebitda") / F.nullif("revenue", F.lit(0.0)), 6).alias("operating_margin"))




@query("islands", f"""
WITH {PAGES}, {GAPPED} SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM gapped""")
def islands_q(spark, sf):
    return ordering.islands(gapped_pages(spark, sf), ["doc_id"], "n").select("doc_id", "n", "run")


@query("ffill", f"""
WITH {PAGES}, m AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') AS head FROM lines)
SELECT doc_id, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM m""")
def ffill_q(spark, sf):
    from ..functions.scalars import extract
    from ..plans.sections import doc_lines

    lines = doc_lines(texts(spark, sf)).withColumn("own", extract(F.col("line"), "^([A-Z][a-z]+) "))
    return ordering.ffill(lines, ["doc_id"], ["line_no"], "own", "head").select("doc_id", "line_no", "head")


@query("first_value_wins", """
SELECT l_suppkey AS doc_id, 'FY' || (l_partkey % 7) AS fiscal_label, l_returnflag AS metric,
  arg_min(l_extendedprice, (l_linenumber, l_linestatus, l_orderkey, l_extendedprice)) AS value, min(l_linenumber) AS page FROM lineitem GROUP BY 1, 2, 3""")
def first_value_wins_q(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("FY"), F.col("l_partkey") % 7).alias("fiscal_label"),
        F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("page"),
        F.col("l_linestatus").alias("source_rank"), F.struct("l_orderkey", "l_extendedprice").alias("ord"), F.lit(0.9).alias("confidence"))
    return first_value_wins(li).select("doc_id", "fiscal_label", "metric", "value", "page")


@query("time_folds", """
WITH ix AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
s AS (SELECT *, greatest(floor(n * 0.4), 60)::BIGINT AS st FROM ix)
SELECT o_orderkey, CASE WHEN n - st >= 25 THEN (i >= st)::INT + (i >= floor(st + 1 * (n - st) / 5))::INT + (i >= floor(st + 2 * (n - st) / 5))::INT
  + (i >= floor(st + 3 * (n - st) / 5))::INT + (i >= floor(st + 4 * (n - st) / 5))::INT END AS fold FROM s""")
def time_folds_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return ordering.time_folds(o, "d", "o_orderkey").select("o_orderkey", "fold")


@query("global_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS idx FROM orders""")
def global_index_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return ordering.global_index(o, "d", "o_orderkey").select("o_orderkey", "idx")


@query("sorted_desc", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS listed FROM orders
ORDER BY listed DESC NULLS LAST, o_orderkey""")
def sorted_desc(spark, sf):
    listed = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    o = table(spark, sf, "orders").select("o_orderkey", listed.alias("d")).orderBy(F.col("d").desc_nulls_last(), "o_orderkey")
    return o.select("o_orderkey", day("d").alias("listed"))
