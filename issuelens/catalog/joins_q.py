"""Joins: lookups, containment, intervals, as-of, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import first_match, norm_name, tokens
from ..operators import joins
from ..operators.merge import first_valid, priority_fill
from ..operators.ordering import nearest_mark, top_per_group
from ..plans.ledger import frozen_rule
from ..plans.sections import match_titles
from .base import GAPPED, PAGES, PRICES, SUBSCRIPTION, gapped_pages, prices, query, subscription, table, texts


@query("expanded_base", f"""
WITH {SUBSCRIPTION}, c AS (SELECT o_custkey AS k, arg_min(o_orderkey, o_orderkey) AS first_order FROM orders GROUP BY 1)
SELECT s.o_orderkey, c_name AS name, c_mktsegment AS lead, qib, retail, n_name AS place, c.first_order
FROM subscription s LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN c ON c.k = s.o_custkey""")
def expanded_base(spark, sf):
    s = subscription(spark, sf).withColumnRenamed("o_custkey", "k")
    cust = table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    firsts = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first_order"))
    out = joins.left_first(s, cust.select("k", "c_name", "c_mktsegment", "c_nationkey"), "k", [F.col("c_name")])
    out = out.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = joins.left_first(out, firsts, "k", [F.col("first_order")])
    return out.select("o_orderkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("lead"), "qib",
                      "retail", F.col("n_name").alias("place"), "first_order")


@query("priority_fill", f"""
WITH {SUBSCRIPTION}, hand AS (SELECT o_orderpriority AS p, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1)
SELECT o_orderkey, coalesce(qib, nii * 100, hand.v) AS roe,
  coalesce(CASE WHEN o_orderstatus = 'F' THEN 'settled' END, CASE WHEN nii IS NOT NULL THEN 'noted' END) AS sector
FROM subscription LEFT JOIN hand ON o_orderpriority = p""")
def priority_fill_q(spark, sf):
    s = subscription(spark, sf)
    hand = s.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    base = s.select("o_orderkey", "o_orderpriority")
    details = s.select("o_orderkey", "qib", F.when(F.col("o_orderstatus") == "F", "settled").otherwise("").alias("sector"))
    report = s.filter(F.col("nii").isNotNull()).select("o_orderkey", "nii")
    out = priority_fill(base, "o_orderkey", [
        (details, {"roe": F.col("qib"), "sector": F.col("sector")}),
        (report, {"roe": F.col("nii") * 100, "sector": F.lit("noted")})], ["roe", "sector"])
    out = out.join(hand, "o_orderpriority", "left")
    return out.select("o_orderkey", F.coalesce("roe", "v").alias("roe"), "sector")


@query("dim_lookup", """
WITH d AS (SELECT l_orderkey, arg_max(l_suppkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS supp FROM lineitem GROUP BY 1)
SELECT o_orderkey, supp FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""")
def dim_lookup(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey") \
        .select("o_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_partkey")
    last = [F.col(c).desc() for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    out = joins.dim_lookup(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", last)
    return out.select("o_orderkey", F.col("l_suppkey").alias("supp"))


_NORM = """array_to_string(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' '),
  lambda w: w NOT IN ('', 'limited', 'ltd', 'private', 'pvt', 'the', 'and', 'of', 'india')), ' ')"""


@query("name_join", f"""
WITH a AS (SELECT p_partkey, {_NORM.format("'The ' || p_name || ' Ltd.'")} AS k FROM part),
b AS (SELECT {_NORM.format("upper(p_name) || ' (India)'")} AS k, min(p_partkey) AS first_key FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey, first_key FROM a LEFT JOIN b USING (k)""")
def name_join(spark, sf):
    p = table(spark, sf, "part")
    left = p.select("p_partkey", norm_name(F.concat(F.lit("The "), "p_name", F.lit(" Ltd."))).alias("k"))
    right = p.filter("p_size > 25").select(
        norm_name(F.concat(F.upper("p_name"), F.lit(" (India)"))).alias("k"), F.col("p_partkey").alias("first_key"))
    return joins.left_first(left, right, "k", [F.col("first_key")]).select("p_partkey", "first_key")


def _names(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id")) \
        .select("name_id", tokens(F.col("p_name")).alias("toks"))


def _titles(spark, sf):
    title = F.concat_ws(" ", F.regexp_replace("p_brand", "#", " "), "p_name", "p_type", F.lit("prospectus"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("title_id"), tokens(title).alias("toks"), "p_size")


_TOKS = """list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' '),
  lambda w: w NOT IN ('', 'limited', 'ltd', 'private', 'pvt', 'rhp', 'the', 'and', 'of', 'red', 'herring',
  'prospectus', 'dated', 'co', 'company')))"""
_NT = f"""names AS (SELECT min(p_partkey) AS name_id, {_TOKS.format('p_name')} AS nt FROM part GROUP BY p_name),
titles AS (SELECT p_partkey AS title_id, p_size,
  {_TOKS.format("concat_ws(' ', replace(p_brand, '#', ' '), p_name, p_type, 'prospectus')")} AS tt FROM part)"""


@query("token_subset_join", f"""
WITH {_NT} SELECT name_id, title_id FROM names JOIN titles ON len(nt) > 0 AND list_has_all(tt, nt)""")
def token_subset_join(spark, sf):
    return joins.token_subset_join(_names(spark, sf), _titles(spark, sf), "name_id", "toks", "title_id", "toks")


_OV = f"""l AS (SELECT min(p_partkey) AS left_id,
  {_TOKS.format("replace(p_brand, '#', ' ') || ' ' || p_name")} AS lt FROM part GROUP BY p_brand, p_name),
r AS (SELECT min(p_partkey) AS table_id, {_TOKS.format("p_name || ' ' || p_type")} AS rt FROM part GROUP BY p_name, p_type)"""


@query("token_overlap_join", f"""
WITH {_OV}, m AS (SELECT left_id, table_id FROM l JOIN r ON len(lt) > 0 AND len(rt) > 0 AND (list_has_all(lt, rt)
  OR list_has_all(rt, lt) OR len(list_intersect(lt, rt)) >= greatest(2, len(rt) - 1)))
SELECT left_id, min(table_id) AS table_id FROM m GROUP BY 1""")
def token_overlap_join(spark, sf):
    p = table(spark, sf, "part")
    left = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("left_id")).select(
        "left_id", tokens(F.concat_ws(" ", F.regexp_replace("p_brand", "#", " "), "p_name")).alias("lt"))
    right = p.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("table_id")).select(
        "table_id", tokens(F.concat_ws(" ", "p_name", "p_type")).alias("rt"))
    return joins.token_overlap_join(left, right, "left_id", "lt", "table_id", "rt", "table_id")


@query("nearest_in_interval", f"""
WITH {_NT}, pairs AS (SELECT name_id, title_id, DATE '2020-01-01' + CAST(name_id % 400 AS INT) AS opened,
    DATE '2020-01-01' + p_size * 9 AS filed FROM names JOIN titles ON len(nt) > 0 AND list_has_all(tt, nt))
SELECT name_id, arg_min(title_id, (abs(filed - opened), title_id)) AS title_id, min(abs(filed - opened)) AS gap_days
FROM pairs WHERE filed BETWEEN opened - 200 AND opened + 45 GROUP BY 1""")
def nearest_in_interval(spark, sf):
    start = F.lit("2020-01-01").cast("date")
    names = _names(spark, sf).withColumn("opened", F.date_add(start, (F.col("name_id") % 400).cast("int")))
    titles = _titles(spark, sf).withColumn("filed", F.date_add(start, F.col("p_size") * 9))
    return joins.nearest_in_interval(names, titles, "name_id", "toks", "opened", "title_id", "toks", "filed", 200, 45)


@query("asof_horizon", f"""
WITH {PRICES}, a AS (SELECT symbol, min(session_date) AS d0 FROM prices GROUP BY 1),
h AS (SELECT symbol, d0, max((session_date, close)) FILTER (session_date <= d0 + 7) AS h7,
    max((session_date, close)) FILTER (session_date <= d0 + 14) AS h14,
    max((session_date, close)) FILTER (session_date <= d0 + 28) AS h28 FROM prices JOIN a USING (symbol) GROUP BY 1, 2)
SELECT symbol, CASE WHEN h7[1] >= d0 + 6 THEN h7[2] END AS h7, CASE WHEN h14[1] >= d0 + 13 THEN h14[2] END AS h14,
  CASE WHEN h28[1] >= d0 + 27 THEN h28[2] END AS h28 FROM h""")
def asof_horizon(spark, sf):
    p = prices(spark, sf)
    anchors = p.groupBy("symbol").agg(F.min("session_date").alias("d0"))
    return joins.asof_horizons(p, anchors, "symbol", "session_date", "close", "d0", {"h7": 7, "h14": 14, "h28": 28}, 1)


def _index(spark, sf):
    return prices(spark, sf).groupBy("session_date").agg(F.avg("close").alias("close"))


_INDEX = "idx AS (SELECT session_date, avg(close) AS close FROM prices GROUP BY 1)"


@query("asof_index", f"""
WITH {PRICES}, {_INDEX}, n AS (SELECT *, lag(close, 5) OVER (ORDER BY session_date) AS old FROM idx),
anchors AS (SELECT o_orderkey, DATE '2023-12-20' + CAST(o_orderkey % 45 AS INT) AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS d, round((n.close / n.old - 1) * 100, 6) AS index_chg
FROM anchors ASOF LEFT JOIN n ON anchors.d >= n.session_date""")
def asof_index(spark, sf):
    anchors = table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(F.lit("2023-12-20").cast("date"), (F.col("o_orderkey") % 45).cast("int")).alias("d"))
    out = joins.asof_index(anchors, _index(spark, sf), "d", "session_date", "close", 5)
    return out.select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("index_chg", 6).alias("index_chg"))


@query("momentum30", f"""
WITH {PRICES}, {_INDEX} SELECT strftime(session_date, '%Y-%m-%d') AS session_date,
  round((close / lag(close, 5) OVER (ORDER BY session_date) - 1) * 100, 6) AS chg FROM idx""")
def momentum(spark, sf):
    idx = _index(spark, sf)
    dense = joins.index_change(idx, "session_date", "close", 5, "chg")
    return idx.select("session_date").join(dense, "session_date").select(
        F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), F.round("chg", 6).alias("chg"))


@query("missing_reports", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_reports(spark, sf):
    return joins.has_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", False).select("doc_id", "source")


@query("has_report", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_report(spark, sf):
    return joins.has_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", True).select("doc_id", "lang")


@query("known_ids", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""")
def known_ids(spark, sf):
    promo = table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(promo, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("list_analyses", """
SELECT o_orderkey AS id, c_name AS company, o_orderstatus AS status, l.net AS overall
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 4) AS net FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
ORDER BY o_orderdate DESC, o_orderkey""")
def list_analyses(spark, sf):
    rep = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("overall"))
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(rep, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.col("o_orderstatus").alias("status"), "overall")


@query("similar", """
WITH te AS (SELECT vec_id AS tid, embedding AS te FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT tid AS target_id, vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, te),
    lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / len(embedding)), 4) AS distance
  FROM embeddings, te WHERE vec_id <> tid),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT target_id, vec_id, distance, rank FROM r WHERE rank <= 5""")
def similar(spark, sf):
    vectors = _profiles(spark, sf)
    return joins.similar(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "profile", 5, 5, 4)


@query("similar_work")
def similar_work(spark, sf):
    """Share of all (target, row) pairs that the nearest-profile search scores."""
    vectors = _profiles(spark, sf)
    return joins.similar_work(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "profile", 5, 5, 4)


def _profiles(spark, sf):
    """Each embedding as a map of category to score."""
    profile = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i),
                                F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", profile.alias("profile"))


@query("title_match", """
WITH t AS (SELECT DISTINCT p_name FROM part)
SELECT p_name AS title, 'k_' || split_part(p_name, ' ', 2) AS key, 100.0 AS score FROM t
WHERE split_part(p_name, ' ', 2) IN ('anvil', 'bolt', 'gear', 'gizmo', 'plate', 'ring', 'rod', 'widget')""")
def title_match(spark, sf):
    nouns = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
    chapters = [(f"k_{n}", [n], n.upper()) for n in nouns]
    titles = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    return match_titles(titles, "title", chapters).select("title", "key", "score")


@query("classify_text", r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'token|password') THEN 'secret'
  WHEN regexp_matches(lower(text), '[0-9]{3}\.[0-9]{1,3}\.') THEN 'address' WHEN regexp_matches(lower(text), '[0-9]') THEN 'figures'
  WHEN regexp_matches(lower(text), 'the ') THEN 'plain' ELSE 'other' END AS bucket FROM documents""")
def classify_text(spark, sf):
    rules = [("secret", "token|password"), ("address", r"[0-9]{3}\.[0-9]{1,3}\."), ("figures", "[0-9]"), ("plain", "the ")]
    return texts(spark, sf).select(
        "doc_id", first_match(F.lower("text"), rules, "other", ignore_case=False).alias("bucket"))


@query("first_valid_candidate", """
SELECT l_orderkey, min(l_linenumber) AS line, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS supp FROM lineitem
WHERE l_quantity >= 25 GROUP BY 1""")
def first_valid_candidate(spark, sf):
    trial = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    out = first_valid(table(spark, sf, "lineitem"), ["l_orderkey"], trial, F.col("l_quantity") >= 25)
    return out.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"))


@query("nearest_mark", f"""
WITH {PAGES}, {GAPPED}, scan AS (SELECT doc_id, n, CASE WHEN contains(text, 'the') THEN 'p' || n END AS mark FROM gapped),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM scan),
m AS (SELECT * FROM runs WHERE mark IS NOT NULL),
b AS (SELECT r.doc_id, r.n, arg_min(m.mark, (abs(m.n - r.n), m.n)) AS unit FROM runs r
  LEFT JOIN m ON m.doc_id = r.doc_id AND m.run = r.run GROUP BY 1, 2)
SELECT doc_id, n, unit FROM b""")
def nearest_mark_q(spark, sf):
    scan = gapped_pages(spark, sf).withColumn(
        "mark", F.when(F.col("text").contains("the"), F.concat(F.lit("p"), F.col("n").cast("string"))))
    return nearest_mark(scan, ["doc_id"], "n", "mark", "unit").select("doc_id", "n", "unit")


_TRAIL = f"""{SUBSCRIPTION}, ix AS (SELECT *, row_number() OVER (ORDER BY opened, o_orderkey) - 1 AS i FROM subscription),
ts AS (SELECT *, min(i) OVER (PARTITION BY opened) AS t0 FROM ix), dd AS (SELECT DISTINCT opened, t0 FROM ts),
bars AS (SELECT dd.opened, CASE WHEN count(p.qib) >= 20 THEN median(p.qib) END AS qib_bar,
    CASE WHEN count(p.retail) >= 20 THEN median(p.retail) END AS retail_bar
  FROM dd LEFT JOIN ts p ON p.i BETWEEN dd.t0 - 60 AND dd.t0 - 1 GROUP BY 1)"""


@query("trailing_median", f"""
WITH {_TRAIL} SELECT o_orderkey, qib_bar, retail_bar FROM subscription JOIN bars USING (opened)""")
def trailing_median(spark, sf):
    from ..operators.ordering import trailing_bars

    s = subscription(spark, sf)
    bars = trailing_bars(s, "opened", "o_orderkey", ["qib", "retail"])
    return s.select("o_orderkey", "opened").join(bars, "opened").select("o_orderkey", "qib_bar", "retail_bar")


@query("frozen_rule", f"""
WITH {_TRAIL} SELECT o_orderkey, CASE WHEN qib > qib_bar AND retail <= retail_bar THEN 'BUY-CANDIDATE' ELSE 'no' END AS rule_says,
  qib, retail, qib_bar, retail_bar FROM subscription JOIN bars USING (opened)
WHERE qib IS NOT NULL AND retail IS NOT NULL AND qib_bar IS NOT NULL AND retail_bar IS NOT NULL""")
def frozen_rule_q(spark, sf):
    return frozen_rule(subscription(spark, sf), "opened", "o_orderkey").select(
        "o_orderkey", "rule_says", "qib", "retail", "qib_bar", "retail_bar")
