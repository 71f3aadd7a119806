"""Scans, landing clean-ups, merges, sinks and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.merge import coalesce_upsert, latest, ledger_merge, retrofit, union_batches, upsert
from ..operators.ordering import exact_quantile
from ..plans import dataset, entities
from ..plans.facts import metric_present, wide_years
from ..plans.models import coverage_gate
from ..plans.sections import low_text
from ..sources import landing
from ..session import shared_dir, spread
from ..sources.schemas import REPORT
from ..sources.sinks import append_history, compact_report, signal_map, site_payload, write_tables
from .base import PAGES, PRICES, R, SUBSCRIPTION, WIDE, day, doc_pages, facts, prices, query, subscription, table, texts


@query("scan_projection", """
SELECT o_orderkey AS issue_id, o_orderpriority AS method, o_totalprice AS price FROM orders
WHERE o_orderdate >= DATE '1997-01-01' AND o_orderstatus = 'F'""")
def scan_projection(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01' AND o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("issue_id"), F.col("o_orderpriority").alias("method"),
                    F.col("o_totalprice").alias("price"))


@query("clean_rows", r"""
SELECT regexp_extract(html, 'track\((\d+)\)', 1) AS cg_ipo_id,
  regexp_extract(html, 'href="(/[^"]+)"', 1) AS detail_url,
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS company,
  trim(regexp_replace(regexp_replace(url, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS url, page_id
FROM pages WHERE regexp_matches(html, 'track\((\d+)\)')
  AND trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) <> ''""")
def clean_rows(spark, sf):
    return landing.clean_rows(texts(spark, sf, "pages", "page_id"), "html", r"track\((\d+)\)", r'href="(/[^"]+)"')


@query("html_links", r"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 1)) AS url,
    unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 2)) AS title,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 1), 1) AS pos FROM pages)
SELECT url, arg_min(trim(title), (page_id, pos)) AS title, min(page_id) AS page_id FROM m
WHERE NOT regexp_matches(title, '^(the|and)$') GROUP BY url""")
def html_links(spark, sf):
    rows = landing.html_matches(texts(spark, sf, "pages", "page_id"), "html", r'<a href="([^"]+)">([^<]*)</a>',
                                ["url", "title"], ["page_id"]).filter(~F.col("title").rlike("^(the|and)$"))
    first = landing.top_per_group(rows, ["url"], [F.col("page_id"), F.col("pos")])
    return first.select("url", F.trim("title").alias("title"), "page_id")


@query("html_rows", r"""
WITH parts AS (SELECT page_id, unnest(string_split_regex(html, '<p[ >]')) AS cell,
    generate_subscripts(string_split_regex(html, '<p[ >]'), 1) - 1 AS pos FROM pages),
t AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_extract('<x ' || cell,
    '^(.*?)(?:</p>|$)', 1, 's'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM parts WHERE pos > 0),
k AS (SELECT page_id, pos, array_to_string(list_filter(string_split(regexp_replace(lower(regexp_extract(txt,
    '^.*?([A-Z][a-z]+ [a-z]+)', 1)), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'limited', 'ltd',
    'private', 'pvt', 'rhp', 'the', 'and', 'of', 'red', 'herring', 'prospectus', 'dated', 'co', 'company')), ' ') AS name,
    TRY_CAST(nullif(regexp_extract(txt, '([0-9]+)', 1), '') AS DOUBLE) AS amount
  FROM t WHERE contains(txt, 'the'))
SELECT name, arg_max(amount, (page_id, pos)) AS amount FROM k WHERE name <> '' AND amount IS NOT NULL GROUP BY name""")
def html_rows(spark, sf):
    return landing.html_rows(texts(spark, sf, "pages", "page_id"), "html", ["page_id"], "p", "the",
                             r"^.*?([A-Z][a-z]+ [a-z]+)", r"([0-9]+)")


@query("report_scan", """
WITH s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 9 <> 4)
SELECT CAST(s_suppkey AS VARCHAR) AS cg_ipo_id, s_name AS company, s_acctbal AS overall, s_nationkey::DOUBLE AS growth, 'call ' || s_name AS verdict FROM s""")
def report_scan(spark, sf):
    """Suppliers written as pretty-printed reports, a folder each, every ninth broken off; the whole ones read back."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    s = spread(table(spark, sf, "supplier"), "s_suppkey")
    score = F.struct(F.col("s_nationkey").cast("double").alias("score"))
    report = F.struct(
        F.struct(F.col("s_acctbal").alias("overall"), F.create_map(F.lit("growth"), score).alias("categories")).alias("scoring"),
        F.struct(F.col("s_name").alias("company_name")).alias("meta"), F.concat(F.lit("call "), "s_name").alias("verdict"))
    body = F.to_json(report, {"pretty": "true"})
    broken = F.when(F.col("s_suppkey") % 9 == 4, F.expr("left(body, length(body) div 2)")).otherwise(F.col("body"))
    # A folder costs far more than its few bytes: all cores make them, and each task moves its own into place.
    s.withColumn("body", body).select(broken.alias("value"), F.col("s_suppkey").alias("id")) \
        .write.partitionBy("id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    read = landing.read_reports(spark, folder, r"/id=([^/]+)/")
    return read.select("cg_ipo_id", F.col("meta.company_name").alias("company"), F.col("scoring.overall").alias("overall"),
                       F.col("scoring.categories")["growth"]["score"].alias("growth"), "verdict")


@query("daily_close", f"WITH {PRICES} SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, close FROM prices")
def daily_close(spark, sf):
    return prices(spark, sf).withColumn("session_date", day("session_date"))


@query("doc_register", """
SELECT doc_id, sha256(text) AS sha256, strlen(text) AS file_size,
  CASE WHEN contains(lower(source), 'drhp') OR contains(lower(source), 'src1') THEN 'DRHP' ELSE 'RHP' END AS doc_type
FROM documents""")
def doc_register(spark, sf):
    docs = texts(spark, sf)
    named = docs.withColumn("filename", F.regexp_replace("source", "^src1", "draft-src1"))
    return landing.register_documents(named, F.col("filename"), F.encode("text", "UTF-8")) \
        .select("doc_id", "sha256", F.col("file_size").cast("bigint").alias("file_size"), "doc_type")


@query("upsert", """
WITH fresh AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders WHERE o_orderdate >= DATE '1999-01-01' GROUP BY 1),
old AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
    arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_orderdate < DATE '1999-01-01' GROUP BY 1)
SELECT o_custkey, o_orderkey, price, NULL AS status FROM fresh
UNION ALL SELECT o_custkey, o_orderkey, NULL, status FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM fresh)""")
def upsert_q(spark, sf):
    o = table(spark, sf, "orders")
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    old = latest(o.filter(F.col("o_orderdate") < cut), ["o_custkey"], newest) \
        .select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    fresh = o.filter(F.col("o_orderdate") >= cut).select(
        "o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"))
    return upsert(old, fresh, ["o_custkey"], newest).select("o_custkey", "o_orderkey", "price", "status")


_SPLIT = """
WITH old AS (SELECT o_custkey AS id, max(o_totalprice) FILTER (o_orderstatus = 'F') AS kpi, count(*) AS reserved,
    min(o_orderkey) AS first_seen FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1),
new AS (SELECT o_custkey AS id, max(o_totalprice) FILTER (o_orderstatus = 'O') AS kpi,
    nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS reserved FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
"""


@query("upsert_coalesce", _SPLIT + """
SELECT coalesce(new.id, old.id) AS id, coalesce(new.kpi, old.kpi) AS kpi,
  CASE WHEN new.id IS NOT NULL THEN new.reserved ELSE old.reserved END AS reserved, first_seen
FROM old FULL JOIN new ON old.id = new.id""")
def upsert_coalesce(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    price = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    old = o.filter(F.col("o_orderdate") < cut).groupBy("id").agg(
        price("F").alias("kpi"), F.count("*").alias("reserved"), F.min("o_orderkey").alias("first_seen"))
    new = o.filter(F.col("o_orderdate") >= cut).groupBy("id").agg(
        price("O").alias("kpi"),
        F.nullif(F.count(F.when(F.col("o_orderstatus") == "P", 1)), F.lit(0)).alias("reserved"))
    return coalesce_upsert(old, new, ["id"], ["kpi"], ["reserved"])


@query("latest_signal", """
SELECT user_id AS analysis_id, arg_max(value, (ts, event_id)) AS gmp, arg_max(event_type, (ts, event_id)) AS kind
FROM events GROUP BY 1""")
def latest_signal(spark, sf):
    ev = table(spark, sf, "events")
    return latest(ev, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select(
        F.col("user_id").alias("analysis_id"), F.col("value").alias("gmp"), F.col("event_type").alias("kind"))


@query("ledger_merge", """
WITH led AS (SELECT o_custkey AS id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS says,
    max(o_totalprice) FILTER (o_orderstatus = 'P') AS ret FROM orders WHERE o_orderdate < DATE '1997-06-01' GROUP BY 1),
calls AS (SELECT o_custkey AS id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS says,
    max(o_totalprice) FILTER (o_orderstatus = 'F') AS ret FROM orders WHERE o_orderdate >= DATE '1997-06-01' GROUP BY 1)
SELECT coalesce(led.id, calls.id) AS id, CASE WHEN led.id IS NOT NULL THEN led.says ELSE calls.says END AS says,
  coalesce(led.ret, calls.ret) AS ret FROM led FULL JOIN calls ON led.id = calls.id""")
def ledger_merge_q(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    cut = F.lit("1997-06-01").cast("timestamp_ntz")

    def side(df, status):
        return df.groupBy("id").agg(
            F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("says"),
            F.max(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))).alias("ret"))

    return ledger_merge(side(o.filter(F.col("o_orderdate") < cut), "P"),
                        side(o.filter(F.col("o_orderdate") >= cut), "F"), "id", ["says"], ["ret"])


@query("completed_reports", """
SELECT o_orderkey, c_name AS company, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND coalesce(c_acctbal > 9000, false) = false""")
def completed_reports(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, sf, "customer").filter("coalesce(c_acctbal > 9000, false) = false")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_name").alias("company"), F.col("o_totalprice").alias("score"))


@query("site_payload", f"""
WITH {SUBSCRIPTION}
SELECT o_orderkey, round(o_totalprice / 7, 2) AS price, round(qib / 3, 2) AS sub_qib, round(retail / 3, 2) AS sub_rii,
  {R("CASE WHEN nii > 0 THEN qib / nii END", 2)} AS ratio FROM subscription""")
def site_payload_q(spark, sf):
    s = subscription(spark, sf)
    nested = s.select(
        "o_orderkey", (F.col("o_totalprice") / 7).alias("price"),
        F.struct((F.col("qib") / 3).alias("qib"), (F.col("retail") / 3).alias("rii")).alias("subs"),
        F.array(F.coalesce(F.try_divide(F.col("qib"), F.col("nii")), F.lit(float("nan")))).alias("ratios"))
    return site_payload(nested).select("o_orderkey", "price", F.col("subs.qib").alias("sub_qib"),
                                       F.col("subs.rii").alias("sub_rii"), F.get("ratios", F.lit(0)).alias("ratio"))


@query("compact_docs", """
WITH d AS (SELECT doc_id, lang, source, n_chars, substr(text, 1, 500) AS excerpt,
    list_slice(string_split(text, chr(10)), 1, 3) AS top FROM documents)
SELECT d.doc_id, lang, excerpt, array_to_string(top, '|') AS top_lines,
  CASE WHEN quality IS NULL AND toxic IS NULL THEN false ELSE true END AS has_fundamentals
FROM d LEFT JOIN labels USING (doc_id)""")
def compact_docs(spark, sf):
    """Documents as nested reports, through JSON, cut to what the site reads."""
    d = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text")))
    report = F.struct(
        F.col("lang").alias("verdict"), F.struct(F.col("text").alias("excerpt")).alias("industry"),
        F.struct(lines.alias("bull")).alias("cases"),
        F.struct(F.struct(F.col("quality").cast("double").alias("roe"), F.col("toxic").cast("double").alias("roce")).alias("ratios")).alias("financials"))
    parsed = d.select(F.col("doc_id").alias("cg_ipo_id"), F.from_json(F.to_json(report), REPORT).alias("r")).select("cg_ipo_id", "r.*")
    out = compact_report(parsed)
    return out.select(
        F.col("cg_ipo_id").alias("doc_id"), F.col("verdict").alias("lang"), F.col("industry.excerpt").alias("excerpt"),
        F.array_join(F.transform("cases.bull", lambda x: x["text"]), "|").alias("top_lines"), F.col("fundamentals").isNotNull().alias("has_fundamentals"))


def _own_folder(spark):
    return f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"


@query("history_append", """
SELECT o_orderkey, o_orderstatus AS attempt, o_totalprice AS score FROM orders""")
def history_append(spark, sf):
    """Attempts appended status by status, read back as one history."""
    folder = _own_folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("attempt"), F.col("o_totalprice").alias("score"))
    append_history(o.filter("attempt = 'F'"), folder)
    append_history(o.filter("attempt is distinct from 'F'"), folder)
    return spark.read.parquet(folder)


@query("persisted_tables", """
SELECT c_custkey AS doc_id, c_mktsegment AS segment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def persisted_tables(spark, sf):
    """Two tables written and joined again from their files."""
    folder = _own_folder(spark)
    write_tables({"documents": table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("segment")),
                  "facts": table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")}, folder)
    docs, rows = (spark.read.parquet(f"{folder}/{t}") for t in ("documents", "facts"))
    return docs.join(rows, "doc_id", "left").groupBy("doc_id", "segment").agg(F.count("o_orderkey").alias("orders"))


@query("clean_header", """
SELECT s_suppkey AS "Supplier", s_acctbal AS "Balance", s_name AS plain FROM supplier""")
def clean_header_q(spark, sf):
    s = table(spark, sf, "supplier")
    return landing.clean_headers(s.select(F.col("s_suppkey").alias("~Supplier"), F.col("s_acctbal").alias("Balance <b>(in crore)</b>"), F.col("s_name").alias("plain")))


@query("page_refs", """
SELECT o_custkey AS doc_id, array_to_string(list(CAST(o_orderkey % 400 AS VARCHAR) ORDER BY o_orderkey), ',') AS refs FROM orders GROUP BY 1""")
def page_refs_q(spark, sf):
    """Every page reference of a composed paragraph."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey"))), lambda x: F.concat(
        F.lit("as stated [p."), (x["o_orderkey"] % 400).cast("string"), F.lit("]"))), " and ")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(said.alias("text"))
    return o.select("doc_id", F.array_join(F.transform(S.page_refs(F.col("text")), lambda x: x.cast("string")), ",").alias("refs"))


@query("issuer_pe", """
SELECT s_suppkey AS doc_id, CAST(s_suppkey % 90 + 5 AS DOUBLE) + 0.5 AS issuer_pe, CAST(2 + s_suppkey % 3 AS INT) AS issuer_pe_page FROM supplier""")
def issuer_pe_q(spark, sf):
    """P/E printed beside the price band, in either wording, on one of several pages."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    pe = F.concat((F.col("doc_id") % 90 + 5).cast("string"), F.lit(".5"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("P/E ratio at the upper end of the price band: "), pe)) \
        .otherwise(F.concat(F.lit("At the price band the P/E is "), pe, F.lit(" times")))
    at = (F.col("doc_id") % 3 + 2).cast("int")
    pages = s.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).withColumn("text", F.when(F.col("n") == at, text).otherwise("other"))
    ranges = s.select("doc_id", F.lit(1).cast("bigint").alias("rank"), F.lit(1).alias("lo"), F.lit(5).alias("hi"))
    return entities.issuer_pe(pages, ranges)


@query("retrofit_counts", """
WITH rep AS (SELECT doc_id, lang, CASE WHEN n_chars > 3000 THEN n_chars END AS fund FROM documents)
SELECT lang, count(*) FILTER (fund IS NOT NULL) AS had, count(*) FILTER (fund IS NULL AND l.doc_id IS NOT NULL) AS patched,
  count(*) FILTER (fund IS NULL AND l.doc_id IS NULL) AS unmatched
FROM rep LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def retrofit_counts(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") > 3000, F.struct(F.col("n_chars").alias("v"))).alias("fund"))
    corpus = table(spark, sf, "labels").select("doc_id", F.struct(F.col("quality").cast("bigint").alias("v")).alias("fund"))
    done = retrofit(d, corpus, "doc_id", "fund")
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return done.groupBy("lang").agg(count("had"), count("patched"), count("unmatched"))


# ------------------------------------------------------------------ predicates

@query("site_window", f"""
WITH {SUBSCRIPTION}, d AS (SELECT o_orderkey, opened, CASE WHEN o_orderstatus <> 'O' THEN opened + 40 END AS listed FROM subscription)
SELECT o_orderkey FROM d WHERE listed >= DATE '2001-01-01' - 550
  OR (listed IS NULL AND opened >= DATE '2001-01-01' - 120) OR opened >= DATE '2001-01-01'""")
def site_window(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("opened"))
    listed = F.when(F.col("o_orderstatus") != "O", F.date_add("opened", 40))
    now = F.lit("2001-01-01").cast("date")
    return o.filter(dataset.site_window(F.col("opened"), listed, now)).select("o_orderkey")


@query("title_filter", r"""
SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '(^| )(tion|ment|heit)( |$)')""")
def title_filter(spark, sf):
    return table(spark, sf, "conversations").filter(~F.col("text").rlike(r"(^| )(tion|ment|heit)( |$)")).select("conv_id", "turn")


@query("refresh_due", f"""
WITH {SUBSCRIPTION}
SELECT o_orderkey, NOT (date_diff('day', opened, DATE '2001-08-01') > 760 AND (nii IS NOT NULL OR o_orderstatus = 'F')) AS due
FROM subscription""")
def refresh_due(spark, sf):
    s = subscription(spark, sf)
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return s.select("o_orderkey", dataset.refresh_due(
        F.col("opened"), F.col("nii"), known, F.lit("2001-08-01").cast("date")).alias("due"))


@query("needs_fetch", f"""
WITH {SUBSCRIPTION}
SELECT o_orderkey, (coalesce(qib, retail, nii) IS NULL OR o_orderstatus = 'P')
  AND NOT coalesce(date_diff('day', opened, DATE '2001-08-01') < 700, false) AS fetch FROM subscription""")
def needs_fetch(spark, sf):
    s = subscription(spark, sf)
    sector = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return s.select("o_orderkey", dataset.needs_fetch(
        [F.col("qib"), F.col("retail"), F.col("nii")], sector, F.col("opened"),
        F.lit("2001-08-01").cast("date"), 700).alias("fetch"))


@query("work_budget", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40""")
def work_budget(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return dataset.work_budget(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 40).select("o_orderkey", "o_totalprice")


@query("coverage_gate", f"""
WITH {SUBSCRIPTION} SELECT o_orderkey FROM subscription WHERE net / o_totalprice IS NULL OR net / o_totalprice >= 0.5""")
def coverage_gate_q(spark, sf):
    s = subscription(spark, sf).withColumn("coverage", F.col("net") / F.nullif("o_totalprice", F.lit(0.0)))
    return coverage_gate(s).select("o_orderkey")


@query("low_text", f"""
WITH {PAGES}
SELECT doc_id, count(*) AS pages, count(*) FILTER (length(trim(text)) < 400) AS low_pages,
  round(avg(CASE WHEN length(trim(text)) < 400 THEN 0.0 ELSE 1.0 END), 4) AS readable_ratio FROM dpages GROUP BY 1""")
def low_text_q(spark, sf):
    return low_text(doc_pages(spark, sf), 400)


@query("metric_present", f"""
WITH {WIDE}, long AS (UNPIVOT sums ON COLUMNS(* EXCLUDE (doc_id, fy)) INTO NAME metric VALUE v)
SELECT doc_id, metric, count(v) AS years FROM long GROUP BY 1, 2 HAVING count(v) > 0""")
def metric_present_q(spark, sf):
    return metric_present(facts(spark, sf))


@query("guarded_median", f"""
WITH {SUBSCRIPTION}, g AS (SELECT o_orderpriority, (net / o_totalprice - 1) * 100 AS gain, o_totalprice FROM subscription)
SELECT o_orderpriority, round(median(gain) FILTER (gain > -95), 6) AS median_gain,
  count(*) FILTER (o_totalprice > 0 AND o_totalprice <= 400000) AS plausible FROM g GROUP BY 1""")
def guarded_median(spark, sf):
    s = subscription(spark, sf).withColumn("gain", (F.col("net") / F.nullif("o_totalprice", F.lit(0.0)) - 1) * 100)
    g = s.withColumn("gain", F.when(F.col("gain") > -95, F.col("gain")))
    counts = g.groupBy("o_orderpriority").agg(
        F.count(F.when((F.col("o_totalprice") > 0) & (F.col("o_totalprice") <= 400000), 1)).alias("plausible"))
    mid = exact_quantile(g, ["o_orderpriority"], "gain", 0.5, "m")
    return counts.join(mid, "o_orderpriority", "left").select(
        "o_orderpriority", F.round("m", 6).alias("median_gain"), "plausible")


@query("signal_map", f"""
WITH {SUBSCRIPTION}
SELECT o_orderkey, nullif(concat_ws(',', CASE WHEN nii IS NOT NULL THEN 'nii=' || CAST(nii AS BIGINT) END,
  CASE WHEN qib IS NOT NULL THEN 'qib=' || CAST(qib AS BIGINT) END,
  CASE WHEN retail IS NOT NULL THEN 'rii=' || CAST(retail AS BIGINT) END), '') AS signals FROM subscription""")
def signal_map_q(spark, sf):
    s = subscription(spark, sf)
    m = signal_map({"nii": F.col("nii"), "qib": F.col("qib"), "rii": F.col("retail")})
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string")))
    return s.select("o_orderkey", F.array_join(F.array_sort(pairs), ",").alias("signals"))


@query("listed_guard", f"""
WITH {SUBSCRIPTION} SELECT o_orderkey, CASE WHEN opened + 30 <= DATE '2000-01-01' THEN o_totalprice END AS day1 FROM subscription""")
def listed_guard(spark, sf):
    o = table(spark, sf, "orders")
    listed = F.date_add(F.to_date("o_orderdate"), 30) <= F.lit("2000-01-01").cast("date")
    return o.select("o_orderkey", F.when(listed, F.col("o_totalprice")).alias("day1"))


@query("union_batches", """
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_batches_q(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"))
    return union_batches([c, s])


@query("distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").dropDuplicates(["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag")


@query("derived_metrics", f"WITH {WIDE} SELECT doc_id, fy, total_debt, ebitda, revenue FROM wide")
def derived_metrics(spark, sf):
    return wide_years(facts(spark, sf)).select("doc_id", "fy", "total_debt", "ebitda", "revenue")
