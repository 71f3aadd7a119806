"""Document text: lines, chapters, facts from pages, issue details and scalar functions.

The driver's documents hold no prospectus wording, so each query passes its own pattern
table to the operator; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..operators.ordering import ffill
from ..plans import entities, facts, sections
from ..session import materialise
from ..sources import landing
from .base import GAPPED, PAGES, R, doc_pages, gapped_pages, query, table, texts

# chapters of the driver's documents: key, titles, heading pattern
CHAPTERS = [
    ("opening", ["the"], r"(?:The|La|Die|El) .*"),
    ("middle", ["of"], r"(?:Of|And|Les|Der|Los) .*"),
    ("closing", ["in"], r"(?:In|To|Des|Und|De) .*"),
    ("absent", ["zz"], r"Zzz .*"),
]
_HEAD = """heads AS (SELECT doc_id, n, key FROM dpages, (VALUES ('opening', '^(?:The|La|Die|El) .*$'),
  ('middle', '^(?:Of|And|Les|Der|Los) .*$'), ('closing', '^(?:In|To|Des|Und|De) .*$'), ('absent', '^Zzz .*$')) c(key, pat)
  WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, pat))) > 0)"""


@query("doc_lines", f"WITH {PAGES} SELECT doc_id, line_no, line FROM lines")
def doc_lines(spark, sf):
    return sections.doc_lines(texts(spark, sf)).select("doc_id", "line_no", "line")


@query("toc_lines", """
SELECT p_partkey AS doc_id, 1 AS pos, p_name || ' part' AS title, p_size AS page FROM part""")
def toc_lines(spark, sf):
    """A contents line per part below a line that is none."""
    line = F.concat(F.upper("p_type"), F.lit("\n"), "p_name", F.lit(" part ........ "), F.col("p_size").cast("string"), F.lit(" "))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("n"), line.alias("text"))
    return sections.toc_lines(pages).select("doc_id", "pos", "title", "page")


@query("heading_scan", f"WITH {PAGES}, {_HEAD} SELECT doc_id, key, min(n) AS page_start FROM heads GROUP BY 1, 2")
def heading_scan(spark, sf):
    return sections.from_headings(doc_pages(spark, sf), spark, CHAPTERS).select("doc_id", "key", "page_start")


_CLAIM = """claims AS (SELECT doc_id, key, CAST(1 + (doc_id * 7 + length(key)) % 6 AS INT) AS claimed FROM documents,
  (VALUES ('opening'), ('middle')) k(key))"""
_VERIFY = """verified AS (SELECT c.doc_id, c.key, c.claimed, arg_min(h.n, (abs(h.n - c.claimed), -h.n)) AS found FROM claims c
  LEFT JOIN heads h ON h.doc_id = c.doc_id AND h.key = c.key GROUP BY 1, 2, 3)"""


def _claims(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("opening"), F.lit("middle"))).alias("key"))
    page = (1 + (F.col("doc_id") * 7 + F.length("key")) % 6).cast("int")
    return d.select("doc_id", "key", F.initcap("key").alias("title"), page.alias("page_start"), F.lit("printed_toc").alias("method"))


@query("verify_page", f"""
WITH {PAGES}, {_HEAD}, {_CLAIM}, {_VERIFY} SELECT doc_id, key, coalesce(found, claimed) AS page_start FROM verified""")
def verify_page(spark, sf):
    heads = sections.heading_pages(doc_pages(spark, sf), CHAPTERS)
    return sections.verify_pages(_claims(spark, sf), heads).select("doc_id", "key", "page_start")


_MERGE = f"""{PAGES}, {_HEAD}, {_CLAIM}, {_VERIFY},
scan AS (SELECT doc_id, key, min(n) AS page_start FROM heads GROUP BY 1, 2),
canon AS (SELECT * FROM (VALUES (0, 'opening'), (1, 'middle'), (2, 'closing'), (3, 'absent')) c(canon, key)),
merged AS (SELECT d.doc_id, canon, c.key, coalesce(v.found, v.claimed, s.page_start) AS page_start,
  CASE WHEN v.claimed IS NOT NULL THEN 'printed_toc' WHEN s.page_start IS NOT NULL THEN 'heading_scan' END AS method
  FROM documents d CROSS JOIN canon c LEFT JOIN verified v ON v.doc_id = d.doc_id AND v.key = c.key
  LEFT JOIN scan s ON s.doc_id = d.doc_id AND s.key = c.key),
counts AS (SELECT doc_id, max(n) AS pages FROM dpages GROUP BY 1),
nx AS (SELECT m.*, pages, lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start, canon) AS nxt FROM merged m JOIN counts USING (doc_id)
  WHERE page_start IS NOT NULL),
spans AS (SELECT doc_id, key, page_start, greatest(page_start, CASE WHEN nxt IS NULL THEN pages WHEN nxt > page_start THEN nxt - 1
  ELSE page_start END) AS page_end FROM nx)"""


def _merged(spark, sf):
    pages = doc_pages(spark, sf)
    verified = sections.verify_pages(_claims(spark, sf), sections.heading_pages(pages, CHAPTERS))
    located = verified.unionByName(sections.from_headings(pages, spark, CHAPTERS))
    counts = pages.groupBy("doc_id").agg(F.max("n").alias("pages"))
    return pages, counts, sections.merge_sections(located, counts, spark, CHAPTERS)


@query("section_merge", f"""
WITH {_MERGE} SELECT doc_id, key, page_start, method, page_start IS NOT NULL AS found FROM merged""")
def section_merge(spark, sf):
    return _merged(spark, sf)[2].select("doc_id", "key", "page_start", "method", "found")


@query("spans", f"WITH {_MERGE} SELECT doc_id, key, page_start, page_end FROM spans")
def spans(spark, sf):
    _, counts, merged = _merged(spark, sf)
    return sections.section_spans(merged, counts).select("doc_id", "key", "page_start", "page_end")


@query("section_text", f"""
WITH {_MERGE} SELECT s.doc_id, s.key, s.page_start, s.page_end, md5(string_agg(p.text, chr(10) ORDER BY p.n)) AS text_md5
FROM spans s JOIN dpages p ON p.doc_id = s.doc_id AND p.n BETWEEN s.page_start AND s.page_end GROUP BY 1, 2, 3, 4""")
def section_text(spark, sf):
    pages, counts, merged = _merged(spark, sf)
    spans = sections.section_spans(merged, counts)
    out = sections.section_text(spans, pages)
    return out.select("doc_id", "key", "page_start", "page_end", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


_ANCHOR = "(?:token|555|password|[0-9]{6})"


@query("anchor_pages", f"""
WITH {_MERGE}, named AS (SELECT doc_id, n FROM dpages WHERE regexp_matches(lower(text), '{_ANCHOR}')),
rng AS (SELECT * FROM spans WHERE key IN ('opening', 'closing')),
inside AS (SELECT DISTINCT a.doc_id, a.n FROM named a JOIN rng r ON a.doc_id = r.doc_id AND a.n BETWEEN r.page_start AND r.page_end
  UNION SELECT doc_id, n FROM named WHERE doc_id NOT IN (SELECT doc_id FROM rng)),
ex AS (SELECT i.doc_id, unnest(range(i.n, least(i.n + 3, pages) + 1)) AS n FROM inside i JOIN counts USING (doc_id))
SELECT DISTINCT doc_id, n FROM ex""")
def anchor_pages(spark, sf):
    pages, counts, merged = _merged(spark, sf)
    spans = sections.section_spans(merged, counts)
    return facts.anchor_pages(pages, spans, ["opening", "closing"], [_ANCHOR]).select("doc_id", "n")


@query("unit_resolve", f"""
WITH {PAGES}, {GAPPED}, scan AS (SELECT doc_id, n, nullif(lower(regexp_extract(text, '(that|tion|ment) ', 1)), '') AS own FROM gapped),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM scan),
m AS (SELECT * FROM runs WHERE own IS NOT NULL),
r AS (SELECT r.doc_id, r.n, arg_min(m.own, (abs(m.n - r.n), m.n)) AS unit FROM runs r LEFT JOIN m ON m.doc_id = r.doc_id AND m.run = r.run GROUP BY 1, 2)
SELECT doc_id, n, last_value(unit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM r""")
def unit_resolve(spark, sf):
    caption = F.concat(F.lit("rs in "), F.regexp_replace(F.lower(S.extract(F.col("text"), "(that|tion|ment) ")), "^(.*)$", "$1"))
    words = {"that": "lakh", "tion": "crore", "ment": "million"}
    back = {v: k for k, v in words.items()}
    unit = F.concat(F.lit("rs in "), S.lookup(F.replace(caption, F.lit("rs in "), F.lit("")), words))
    scan = gapped_pages(spark, sf).withColumn("text", F.coalesce(unit, F.lit("")))
    out = ffill(facts.resolve_units(scan), ["doc_id"], ["n"], "unit", "unit")
    return out.select("doc_id", "n", S.lookup(F.col("unit"), back).alias("unit"))


# table cells of the driver's data: a customer's orders by year as a ruled table
_CELLS = """y AS (SELECT c_nationkey AS doc_id, l_returnflag AS f, year(o_orderdate) AS fy, round(sum(l_quantity), 2) AS v FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def _cells(spark, sf):
    """Nation as document, return flag as statement row, order year as column."""
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    y = materialise(
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("doc_id"), "l_returnflag", F.year("o_orderdate").alias("fy"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("v")))
    at = {"page": F.lit(1), "table_no": F.lit(0)}
    row = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 3).otherwise(4)
    col = F.col("fy") - 1994
    labels = S.lookup(F.col("l_returnflag"), {"A": "Revenue from operations (I)", "N": "(a) Trade receivables", "R": "Total assets"})
    values = y.select("doc_id", row.alias("row_no"), col.alias("col_no"),
                      F.concat(F.lit("₹ "), F.format_number("v", 2)).alias("text"))
    names = y.select("doc_id", row.alias("row_no"), F.lit(0).alias("col_no"), labels.alias("text")).distinct()
    heads = y.select("doc_id", F.lit(1).alias("row_no"), col.alias("col_no"),
                     F.concat(F.lit("Fiscal "), (F.col("fy") + 20).cast("string")).alias("text")).distinct()
    title = y.select("doc_id", F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.lit("Particulars").alias("text")).distinct()
    return materialise(values.unionByName(names).unionByName(heads).unionByName(title).withColumns(at))


@query("table_facts", f"""
WITH {_CELLS} SELECT doc_id, 'FY' || right(CAST(fy + 20 AS VARCHAR), 2) AS fiscal_label,
  CASE f WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'receivables' ELSE 'total_assets' END AS metric, v AS value FROM y""")
def table_facts(spark, sf):
    return facts.table_facts(_cells(spark, sf)).select("doc_id", "fiscal_label", "metric", "value")


@query("fold_header", f"""
WITH {_CELLS} SELECT DISTINCT doc_id, fy - 1994 AS col_no, 'fiscal ' || (fy + 20) AS header FROM y
UNION ALL SELECT DISTINCT doc_id, 0, 'particulars' FROM y""")
def fold_header(spark, sf):
    return entities.fold_header(_cells(spark, sf)).select("doc_id", "col_no", "header")


@query("borderless_rows", f"""
WITH {_CELLS}
SELECT doc_id, 'FY' || right(CAST(fy + 20 AS VARCHAR), 2) AS fiscal_label,
  CASE f WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'receivables' ELSE 'total_assets' END AS metric, v AS value
FROM y""")
def borderless_rows(spark, sf):
    """Statement pages printed without rules: headings, labels and one value per line."""
    grid = _cells(spark, sf).filter("row_no >= 2")
    rows = grid.groupBy("doc_id", "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("label"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("col_no") > 0, F.struct("col_no", "text"))))).alias("v"))
    body = rows.select(
        "doc_id", "row_no", F.transform("v", lambda x: x["col_no"]).alias("cols"),
        F.concat_ws("\n", "label", F.lit("25"), F.array_join(F.transform("v", lambda x: x["text"]), "\n")).alias("block"))
    docs = body.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "block"))).alias("blocks"), F.max("cols").alias("cols"))
    heads = F.array_join(F.transform("cols", lambda c: F.concat(
        F.lit("year ended March 31, "), (c + 2014).cast("string"))), "\n")
    text = F.concat_ws("\n", heads, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    pages = facts.carry_headers(docs.select("doc_id", F.lit(1).alias("n"), text.alias("text")))
    return facts.borderless_facts(pages).select("doc_id", "fiscal_label", "metric", "value")


@query("liability_context", f"""
WITH {_CELLS}, d AS (SELECT doc_id, fy, sum(v) FILTER (f = 'A') AS a, sum(v) FILTER (f = 'N') AS n, sum(v) FILTER (f = 'R') AS r FROM y GROUP BY 1, 2)
SELECT doc_id, 'FY' || right(CAST(fy + 20 AS VARCHAR), 2) AS fiscal_label, k.m AS metric, CASE k.m WHEN 'borrowings_lt' THEN a ELSE n END AS value
FROM d, (VALUES ('borrowings_lt'), ('borrowings_st')) k(m) WHERE (k.m = 'borrowings_lt' AND a IS NOT NULL) OR (k.m = 'borrowings_st' AND n IS NOT NULL)""")
def liability_context(spark, sf):
    """Balance sheets whose two debt rows are both labelled Borrowings: the heading above says which is which.

    The first, above any heading, is neither and drops out.
    """
    grid = _cells(spark, sf).filter("row_no >= 2")
    rows = grid.filter("row_no IN (2, 3)").groupBy("doc_id", "row_no").agg(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("col_no") > 0, F.struct("col_no", "text"))))).alias("v"))
    head = F.when(F.col("row_no") == 2, "Non-current liabilities").otherwise("Current liabilities")
    body = rows.select("doc_id", "row_no", head.alias("head"), F.transform("v", lambda x: x["col_no"]).alias("cols"),
                       F.array_join(F.transform("v", lambda x: x["text"]), "\n").alias("values"))
    block = F.concat_ws("\n", "head", F.lit("Borrowings"), "values")
    docs = body.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", block.alias("block")))).alias("blocks"), F.max("cols").alias("cols"))
    heads = F.array_join(F.transform("cols", lambda c: F.concat(F.lit("year ended March 31, "), (c + 2014).cast("string"))), "\n")
    stray = F.concat(F.lit("Borrowings\n"), F.array_join(F.transform("cols", lambda c: F.lit("9,99,999.00")), "\n"))
    text = F.concat_ws("\n", heads, stray, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    pages = facts.carry_headers(docs.select("doc_id", F.lit(1).alias("n"), text.alias("text")))
    return facts.borderless_facts(pages).select("doc_id", "fiscal_label", "metric", "value")


@query("ctx_fill", r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' || turn WHEN role = 'system' THEN 's' || turn END AS ctx FROM conversations)
SELECT conv_id, turn, last_value(ctx IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctx FROM t""")
def ctx_fill(spark, sf):
    c = table(spark, sf, "conversations").withColumn("own", F.when(
        F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string"))).when(
        F.col("role") == "system", F.concat(F.lit("s"), F.col("turn").cast("string"))))
    return ffill(c, ["conv_id"], ["turn"], "own", "ctx", block=1000).select("conv_id", "turn", "ctx")


@query("first_hit", f"""
WITH {_MERGE}, h AS (SELECT doc_id, n, nullif(regexp_extract(text, '([0-9]{{4,}})', 1), '') AS number,
    nullif(regexp_extract(text, '([a-z]+) that', 1), '') AS word FROM dpages),
r AS (SELECT h.*, CASE key WHEN 'closing' THEN 1 WHEN 'opening' THEN 2 END AS rank FROM h JOIN spans s ON h.doc_id = s.doc_id
  AND h.n BETWEEN s.page_start AND s.page_end AND s.key IN ('closing', 'opening'))
SELECT doc_id, arg_min(number, (rank, n)) FILTER (number IS NOT NULL) AS number, arg_min(n, (rank, n)) FILTER (number IS NOT NULL) AS number_page,
  arg_min(word, (rank, n)) FILTER (word IS NOT NULL) AS word, arg_min(n, (rank, n)) FILTER (word IS NOT NULL) AS word_page
FROM r WHERE number IS NOT NULL OR word IS NOT NULL GROUP BY 1""")
def first_hit(spark, sf):
    pages, counts, merged = _merged(spark, sf)
    ranges = entities.page_ranges(sections.section_spans(merged, counts), ["closing", "opening"])
    text = F.col("text")
    return entities.first_hits(pages, ranges, {
        "number": S.extract(text, "([0-9]{4,})"), "word": S.extract(text, "([a-z]+) that")})


@query("objects", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT *, CASE WHEN contains(line, 'tion') THEN 'debt' WHEN contains(line, 'ment') THEN 'capex' WHEN contains(line, 'ing') THEN 'other' END AS category,
  TRY_CAST(nullif(replace(regexp_extract(line, '([0-9,]+(?:[.][0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS amount_cr FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, amount_cr ORDER BY line_no) AS k FROM c WHERE category IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rank FROM f WHERE k = 1)
SELECT doc_id, rank, md5(line) AS purpose, category FROM r""")
def objects(spark, sf):
    lines = sections.doc_lines(texts(spark, sf))
    out = entities.objects(lines, categories=[("debt", "(?-i)tion"), ("capex", "(?-i)ment"), ("other", "(?-i)ing")])
    return out.select("doc_id", "rank", F.md5(F.encode("purpose", "UTF-8")).alias("purpose"), "category")


@query("lit_counts", r"""
SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, 'that\D{0,80}?(\d{1,4})', 1), '') AS INT) AS criminal,
  TRY_CAST(nullif(regexp_extract(text, 'ment\D{0,80}?(\d{1,4})', 1), '') AS INT) AS tax FROM documents""")
def lit_counts(spark, sf):
    kinds = [("criminal", r"(?-i)that\D{0,80}?(\d{1,4})"), ("tax", r"(?-i)ment\D{0,80}?(\d{1,4})")]
    cols = entities.litigation_counts(F.col("text"), kinds)
    return texts(spark, sf).select("doc_id", *[c.alias(k) for k, c in cols.items()])


@query("tri_state", """
SELECT doc_id, CASE WHEN regexp_matches(text, 'not |token') THEN false WHEN regexp_matches(text, 'was |were ') THEN true END AS declared FROM documents""")
def tri_state(spark, sf):
    return texts(spark, sf).select(
        "doc_id", entities.tri_state(F.col("text"), "(?-i)not |token", "(?-i)was |were ").alias("declared"))


@query("pledge", f"""
WITH {_MERGE}, h AS (SELECT doc_id, n, trim(regexp_replace(nullif(regexp_extract(text, '([a-z ]{{0,40}}that[a-z ]{{0,40}})', 1), ''), '\\s+', ' ', 'g')) AS ev FROM dpages),
j AS (SELECT h.doc_id, CASE key WHEN 'closing' THEN 1 ELSE 2 END AS rank, arg_min(ev, n) AS ev, min(n) AS n FROM h JOIN spans s ON h.doc_id = s.doc_id
  AND h.n BETWEEN s.page_start AND s.page_end AND s.key IN ('closing', 'opening') WHERE ev IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, true AS pledged, arg_min(ev, rank) AS evidence, arg_min(n, rank) AS source_page FROM j
WHERE NOT regexp_matches(ev, 'the that|of that') GROUP BY 1""")
def pledge(spark, sf):
    pages, counts, merged = _merged(spark, sf)
    ranges = entities.page_ranges(sections.section_spans(merged, counts), ["closing", "opening"])
    return entities.pledging(pages, ranges, "(?-i)([a-z ]{0,40}that[a-z ]{0,40})", "(?-i)the that|of that")


@query("auditor", f"""
WITH {PAGES}, f AS (SELECT doc_id, n, regexp_matches(text, 'token|555') AS q, regexp_matches(text, 'ment ') AS e FROM dpages)
SELECT doc_id, bool_or(q) AS qualified, bool_or(e) AS emphasis_of_matter, coalesce(max(n) FILTER (q), min(n) FILTER (e)) AS source_page FROM f GROUP BY 1""")
def auditor(spark, sf):
    return entities.auditor_flags(doc_pages(spark, sf), "(?-i)token|555", "(?-i)ment ")


@query("company_name", r"""
WITH t AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) || ' LIMITED' WHEN s_suppkey % 3 = 1 THEN s_name || ' Limited' ELSE s_name END AS l FROM supplier)
SELECT doc_id, CASE WHEN l LIKE '%LIMITED' OR l LIKE '%Limited' THEN 'Supplier ' || right(l, 17)[1:9] || ' Limited' END AS company_name FROM t""")
def company_name(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.regexp_replace("s_name", "#", " ")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.upper(name), F.lit(" LIMITED"))) \
        .when(F.col("s_suppkey") % 3 == 1, F.concat(name, F.lit(" Limited"))).otherwise(name)
    cover = s.select(F.col("s_suppkey").alias("doc_id"), F.concat_ws("\n", F.lit("red herring"), line, F.lit("Lead Bank Limited 1x")).alias("text"))
    return sections.company_name(cover).select("doc_id", "company_name")


@query("issuer_name", r"""
WITH t AS (SELECT s_suppkey AS doc_id, 1 + s_suppkey % 12 AS name_page, 'Supplier ' || right(s_name, 9) || ' Limited' AS company_name FROM supplier WHERE s_suppkey % 5 <> 2)
SELECT doc_id, company_name, name_page::INT AS name_page FROM t""")
def issuer_name(spark, sf):
    """The name stands on any of twelve pages, sometimes again later, and on none for every fifth supplier."""
    s = table(spark, sf, "supplier")
    name = F.regexp_replace("s_name", "#", " ")
    own = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper(name), F.lit(" LIMITED"))).otherwise(F.concat(name, F.lit(" Limited")))
    pages = s.select("s_suppkey", own.alias("own"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    later = F.when((F.col("n") > 1 + F.col("s_suppkey") % 12) & (F.col("s_suppkey") % 5 != 2), "OTHER HOLDINGS LIMITED").otherwise("Lead Bank Limited 1x")
    line = F.when((F.col("n") == 1 + F.col("s_suppkey") % 12) & (F.col("s_suppkey") % 5 != 2), F.col("own")).otherwise(later)
    text = F.concat_ws("\n", F.lit("red herring"), line, F.lit("a page of text"))
    return sections.issuer_names(pages.select(F.col("s_suppkey").alias("doc_id"), "n", text.alias("text")))


@query("reservation", r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM pages),
g AS (SELECT page_id, TRY_CAST(nullif(regexp_extract(txt, 'missing ([0-9.]+)', 1), '') AS DOUBLE) AS a,
  TRY_CAST(nullif(regexp_extract(txt, 'track.([0-9]{1,3})', 1), '') AS DOUBLE) AS b FROM t)
SELECT page_id, coalesce(CASE WHEN a > 0 AND a <= 100 THEN a END, CASE WHEN b > 0 AND b <= 100 THEN b END) AS pct_qib,
  CAST(round(CAST(coalesce(CASE WHEN a > 0 AND a <= 100 THEN a END, CASE WHEN b > 0 AND b <= 100 THEN b END) * 0.6 AS DECIMAL(38,8)), 2) AS DOUBLE) AS pct_anchor FROM g""")
def reservation(spark, sf):
    txt = S.strip_html(F.col("html"), " ")
    cols = landing.reservation(F.col("txt"), {"pct_qib": ["missing ([0-9.]+)", "track.([0-9]{1,3})"]})
    return texts(spark, sf, "pages", "page_id").withColumn("txt", txt).select("page_id", *cols)


@query("kpi_block", r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM pages),
b AS (SELECT page_id, CASE WHEN instr(txt, 'p{margin') > 0 THEN substr(txt, instr(txt, 'p{margin'), 800) END AS blk FROM t)
SELECT page_id, TRY_CAST(nullif(regexp_extract(blk, 'ad[^0-9]*\s+(-?[0-9.]+)', 1), '') AS DOUBLE) AS kpi_roe FROM b""")
def kpi_block(spark, sf):
    txt = S.strip_html(F.col("html"), " ")
    cols = landing.kpi_block(F.col("txt"), "p{margin", 800, {"kpi_roe": "(?-i)ad[^0-9]*"}, None)
    return texts(spark, sf, "pages", "page_id").withColumn("txt", txt).select("page_id", *cols)


# ------------------------------------------------------------------ documents composed from the tables

def _prospectus(spark, sf):
    """One composed chapter page per customer, with figures from its orders."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.floor(F.sum("o_totalprice") / 1000).cast("double").alias("total"), F.count("*").alias("n"),
        F.floor(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 1000).cast("double").alias("fresh"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    pct = (F.col("c_custkey") % 60 + 20).cast("string")
    text = F.concat_ws(
        "", F.lit("Price Band: ₹ "), (F.col("n") + 100).cast("string"), F.lit(" to ₹ "), (F.col("n") + 105).cast("string"),
        F.lit("\nface value of ₹ 10 each\nFresh issue of equity shares aggregating up to ₹ "), F.format_number("fresh", 2),
        F.lit(" lakhs.\nOffer for sale of shares aggregating up to ₹ "), F.format_number("total", 2),
        F.lit(" million.\nBid lot of "), (F.col("n") * 5).cast("string"), F.lit(" equity shares. Listed on NSE and BSE\n"),
        F.lit("pre-offer holding of our promoters is "), pct, F.lit("%\n"),
        F.lit("related party transactions aggregating to ₹ "), F.format_number("total", 2), F.lit(" lakhs\n"),
        F.lit("contingent liabilities of ₹ "), (F.col("n") * 3).cast("string"), F.lit(" crores\n"),
        F.lit("our top ten customers contributed "), pct, F.lit("% of revenue. We depend on our promoters.\n"),
        F.lit("Asha Rao, aged "), (F.col("n") + 30).cast("string"), F.lit(" years, is one of our Promoters with experience of over "),
        (F.col("n") + 3).cast("string"), F.lit(" years in trade. An independent director serves. The industry is highly competitive."))
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("n"), text.alias("text"), "total", "fresh", F.col("n").alias("k"))


_PROSP = """p AS (SELECT o_custkey AS doc_id, floor(sum(o_totalprice) / 1000) AS total, count(*) AS k,
  floor(sum(o_totalprice) FILTER (o_orderstatus = 'F') / 1000) AS fresh FROM orders GROUP BY 1)"""


@query("issue_details", f"""
WITH {_PROSP}, a AS (SELECT doc_id, k, CAST(round(CAST(fresh * 0.01 AS DECIMAL(38,8)), 2) AS DOUBLE) AS f, CAST(round(CAST(total * 0.1 AS DECIMAL(38,8)), 2) AS DOUBLE) AS o FROM p)
SELECT doc_id, k + 100.0 AS price_band_low, k + 105.0 AS price_band_high, 10.0 AS face_value, f AS fresh_issue_cr, o AS ofs_cr,
  round(coalesce(f, 0) + o, 2) AS total_issue_cr, CAST(k * 5 AS INT) AS lot_size, 'BSE, NSE' AS listing_at, (doc_id % 60 + 20)::DOUBLE AS pre_issue_promoter_pct FROM a""")
def issue_details(spark, sf):
    pages = _prospectus(spark, sf).select("doc_id", "n", "text")
    docs = pages.select("doc_id")
    spans = docs.select("doc_id", F.lit("capital_structure").alias("key"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return entities.issue_details(pages, spans, docs).drop("post_issue_promoter_pct", "post_issue_page")


@query("note_totals", f"""
WITH {_PROSP} SELECT doc_id, CAST(round(CAST(total * 0.01 AS DECIMAL(38,8)), 2) AS DOUBLE) AS rpt_cr, k * 3.0 AS contingent_cr
FROM p""")
def note_totals(spark, sf):
    pages = _prospectus(spark, sf).select("doc_id", "n", "text")
    cells = _cells(spark, sf)
    rpt = entities.related_party(pages, cells).select("doc_id", F.col("total_cr").alias("rpt_cr"))
    cont = entities.contingent(pages, cells).select("doc_id", F.col("total_cr").alias("contingent_cr"))
    return rpt.join(cont, "doc_id")


@query("promoters", f"""
WITH {_PROSP} SELECT doc_id, 'Asha Rao' AS names, CASE WHEN k + 3 < 100 THEN CAST(k + 3 AS VARCHAR) ELSE '' END AS experience,
  1 AS independent_directors, false AS conflicts FROM p""")
def promoters(spark, sf):
    pages = _prospectus(spark, sf)
    chapters = pages.select("doc_id", F.col("text").alias("promoters"), F.col("text").alias("management"), F.lit("").alias("group_companies"))
    out = entities.promoters(chapters)
    return out.select("doc_id", F.array_join("names", ",").alias("names"),
                      F.array_join(F.transform("experience_claims", lambda x: x.cast("string")), ",").alias("experience"),
                      F.col("independent_director_mentions").alias("independent_directors"), F.col("group_company_conflicts").alias("conflicts"))


def _peer_cells(spark, sf):
    """Per nation a printed peer table: suppliers with P/E, EPS and RoNW columns."""
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("doc_id"), "s_name", "s_suppkey", F.round(F.abs("s_acctbal") / 100 + 1, 2).alias("pe"),
        F.round(F.abs("s_acctbal") / 50 + 1, 2).alias("eps"), F.round(F.abs("s_acctbal") / 200, 2).alias("ronw"))
    row = (F.col("s_suppkey") + 2).cast("int")
    cols = F.array(
        F.struct(F.lit(0).alias("c"), F.concat("s_name", F.lit("*")).alias("t")), F.struct(F.lit(1).alias("c"), F.format_number("pe", 2).alias("t")),
        F.struct(F.lit(2).alias("c"), F.format_number("eps", 2).alias("t")), F.struct(F.lit(3).alias("c"), F.format_number("ronw", 2).alias("t")))
    body = s.select("doc_id", row.alias("row_no"), F.explode(cols).alias("x")).select("doc_id", "row_no", F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))
    heads = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(t).alias("t")) for r, c, t in (
        (0, 0, "Name of the"), (1, 0, "company"), (0, 1, "P/E"), (0, 2, "EPS"), (1, 2, "(Basic)"), (1, 3, "RoNW (%)"))])
    top = s.select("doc_id").distinct().select("doc_id", F.explode(heads).alias("x")).select(
        "doc_id", F.col("x.r").alias("row_no"), F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))
    return body.unionByName(top).withColumns({"page": F.lit(3), "table_no": F.lit(0)})


@query("peers", f"""
SELECT s_nationkey AS doc_id, s_name AS name, {R('abs(s_acctbal) / 100 + 1', 2)} AS pe, {R('abs(s_acctbal) / 50 + 1', 2)} AS eps,
  {R('abs(s_acctbal) / 200', 2)} AS ronw FROM supplier""")
def peers(spark, sf):
    cells = _peer_cells(spark, sf)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("company_name"))
    return entities.peers(cells, names).select("doc_id", "name", "pe", "eps", "ronw")


@query("holding", """
WITH h AS (SELECT s_nationkey AS doc_id, arg_min(s_suppkey, s_suppkey) AS k FROM supplier GROUP BY 1)
SELECT doc_id, (k % 70 + 5)::DOUBLE AS post_issue_promoter_pct FROM h""")
def holding(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc_id"), "s_suppkey")
    row = (F.col("s_suppkey") + 2).cast("int")
    cols = F.array(
        F.struct(F.lit(0).alias("c"), F.lit("Promoter and promoter group").alias("t")), F.struct(F.lit(1).alias("c"), (F.col("s_suppkey") * 10 + 1).cast("string").alias("t")),
        F.struct(F.lit(2).alias("c"), F.lit("11.50").alias("t")), F.struct(F.lit(3).alias("c"), (F.col("s_suppkey") % 70 + 5).cast("string").alias("t")))
    body = s.select("doc_id", row.alias("row_no"), F.explode(cols).alias("x")).select("doc_id", "row_no", F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))
    heads = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in ((0, "Holder"), (1, "Shares"), (2, "Pre-offer %"), (3, "Post-offer %"))])
    top = s.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row_no"), F.explode(heads).alias("x")).select(
        "doc_id", "row_no", F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))
    cells = body.unionByName(top).withColumns({"page": F.lit(3), "table_no": F.lit(0)})
    return entities.post_issue_holding(cells).select("doc_id", "post_issue_promoter_pct")


# ------------------------------------------------------------------ scalar families

@query("scalar_numeric", r"""
SELECT o_orderkey, TRY_CAST(trim(replace(replace(CASE o_orderkey % 5 WHEN 0 THEN ' 1,' || o_orderkey || '.5%' WHEN 1 THEN 'n/a' WHEN 2 THEN 'none'
    WHEN 3 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END, ',', ''), '%', '')) AS DOUBLE) AS num_raw,
  CASE o_orderkey % 4 WHEN 0 THEN -1000.0 - o_orderkey % 1000 WHEN 1 THEN 250.0 WHEN 2 THEN NULL ELSE o_orderkey::DOUBLE END AS amount,
  CAST(round(CAST(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 1.0 END AS DECIMAL(38,8)), 2) AS DOUBLE) AS crore,
  round(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / (o_custkey % 7) END, 4) AS ratio,
  round(1 / (1 + exp(-least(greatest((o_orderkey % 100 - 50)::DOUBLE, -30), 30))), 8) AS sig
FROM orders""")
def scalar_numeric(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" 1,"), k.cast("string"), F.lit(".5%"))).when(k % 5 == 1, "n/a").when(
        k % 5 == 2, "inf").when(k % 5 == 3, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    printed = F.when(k % 4 == 0, F.concat(F.lit("(1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".00)"))).when(
        k % 4 == 1, "₹ 2,50.00").when(k % 4 == 2, "–").otherwise(k.cast("string"))
    unit = F.when(k % 3 == 0, "Lakhs").when(k % 3 == 1, "crore").otherwise("bushel")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.num(raw).alias("num_raw"), S.amount(printed).alias("amount"),
        S.rescale(F.col("o_totalprice"), unit).alias("crore"),
        F.round(S.safe_div(F.col("o_totalprice"), (F.col("o_custkey") % 7).cast("double")), 4).alias("ratio"),
        F.round(S.sigmoid((k % 100 - 50).cast("double")), 8).alias("sig"))


@query("scalar_id", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN 'x' || o_orderkey ELSE '' END AS id FROM orders""")
def scalar_id(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 1, k.cast("string")).when(
        k % 4 == 2, F.concat(F.lit(" x"), k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", S.norm_id(raw).alias("id"))


@query("scalar_name", r"""
SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower('M/s. ' || p_name || ' & Co. (India) Private Limited'), '[^a-z0-9 ]', ' ', 'g'), ' '),
    lambda w: w NOT IN ('', 'limited', 'ltd', 'private', 'pvt', 'the', 'and', 'of', 'india')), ' ') AS norm,
  'm s ' || CASE WHEN p_name LIKE 'red %' THEN p_name[5:] ELSE p_name END || ' india' AS toks FROM part""")
def scalar_name(spark, sf):
    name = F.concat(F.lit("M/s. "), "p_name", F.lit(" & Co. (India) Private Limited"))
    return table(spark, sf, "part").select("p_partkey", S.norm_name(name).alias("norm"), F.array_join(S.tokens(name), " ").alias("toks"))


@query("scalar_html", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS stripped,
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS spaced FROM pages""")
def scalar_html(spark, sf):
    return texts(spark, sf, "pages", "page_id").select("page_id", S.strip_html(F.col("html")).alias("stripped"), S.strip_html(F.col("html"), " ").alias("spaced"))


@query("scalar_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed, 'FY' || right(CAST(year(o_orderdate) + 20 AS VARCHAR), 2) AS fiscal FROM orders""")
def scalar_date(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "tba").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    head = F.concat(F.lit("As at March 31, "), (F.year("o_orderdate") + 20).cast("string"))
    return o.select("o_orderkey", F.date_format(S.parse_date(text), "yyyy-MM-dd").alias("parsed"), S.fiscal_label(head).alias("fiscal"))


@query("scalar_day_first", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def scalar_day_first(spark, sf):
    """Order dates in seven spellings, all read with the day first; an eighth is no date."""
    o = table(spark, sf, "orders")
    spelt = [F.date_format("o_orderdate", f) for f in S.DAY_FIRST]
    place = F.col("o_orderkey") % 8
    text = F.lit("13/13/2020")
    for i, c in enumerate(spelt):
        text = F.when(place == i, F.upper(c) if i % 2 else F.concat(F.lit(" "), c)).otherwise(text)
    return o.select("o_orderkey", F.date_format(S.parse_day_first(text), "yyyy-MM-dd").alias("parsed"))


@query("scalar_band", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 25 THEN 20.0 WHEN l_quantity >= 15 THEN 15.0 WHEN l_quantity >= 8 THEN 10.0
    WHEN l_quantity >= 3 THEN 5.0 ELSE 0.0 END AS points,
  CASE WHEN l_quantity / 10 > 2.5 THEN 0.0 WHEN l_quantity / 10 > 1.5 THEN 4.0 WHEN l_quantity / 10 > 0.75 THEN 10.0 WHEN l_quantity / 10 > 0.3 THEN 19.0 ELSE 25.0 END AS lower_points,
  CASE WHEN l_quantity >= 70 THEN 'critical' WHEN l_quantity >= 50 THEN 'high' WHEN l_quantity >= 30 THEN 'medium' ELSE 'low' END AS severity,
  least(greatest(l_quantity, 5.0), 40.0) AS clipped, round(ln(1 + l_quantity), 8) AS logged FROM lineitem""")
def scalar_band(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.band(q, vocab.BANDS["operating_margin_level"]).alias("points"),
        S.band(q / 10, vocab.BANDS["debt_to_equity"], True).alias("lower_points"),
        S.pct_severity(q, (30, 50, 70)).alias("severity"), S.clip(q, 5, 40).alias("clipped"), F.round(S.log1p_pos(q), 8).alias("logged"))


@query("scalar_rebase", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 1000 - 100 > -95 THEN round(((1 + l_quantity / 100) / (1 + (l_discount * 1000 - 100) / 100) - 1) * 100, 6) END AS rebased FROM lineitem""")
def scalar_rebase(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(S.rebase(F.col("l_quantity"), F.col("l_discount") * 1000 - 100), 6).alias("rebased"))


@query("scalar_snippet", r"""
WITH m AS (SELECT doc_id, text, regexp_extract(text, 'that [a-z]+', 0) AS hit FROM documents)
SELECT doc_id, CASE WHEN hit <> '' THEN trim(regexp_replace(substr(text, greatest(instr(text, hit) - 110, 1), length(hit) + 220), '\s+', ' ', 'g')) END AS snippet FROM m""")
def scalar_snippet(spark, sf):
    hit = F.regexp_extract("text", "that [a-z]+", 0)
    return texts(spark, sf).select("doc_id", F.when(
        hit != "", S.snippet(F.col("text"), F.position(hit, F.col("text")), F.length(hit))).alias("snippet"))
