"""One query per operator over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm.decontam import find_leaks
from issuelens.llm.gif import media_digests, store_media
from issuelens.llm.langid import identify, train
from issuelens.llm.linededup import dedupe_lines
from issuelens.llm.neardup import near_duplicates
from issuelens.llm.negatives import hard_negatives
from issuelens.llm.packing import pack
from issuelens.llm.pii import pseudonymise
from issuelens.llm.quality import learn as learn_quality, score as score_quality
from issuelens.llm.sharding import shard
from issuelens.llm.staging import table
from issuelens.llm.toxicity import learn, score
from issuelens.llm.variants import group_variants
from issuelens.llm.warc import new_archive, read_archive, record_index, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query(
    "op1_minhash_near_dedup",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
        FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * same >= 80 * (x.n + y.n - same)),
    reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN links ON a = seen)
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
    FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair where the document holds the item within the edit bound."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_sampled_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of nearly equal bytes."""
    return shard(table(spark, sf_dir, "documents"))


@query(
    "op5_warc_archive",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
    FROM h
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a content-addressed archive and back."""
    folder = new_archive(spark)
    write_archive(table(spark, sf_dir, "pages"), folder)
    return record_index(read_archive(spark, folder)).drop("record_bytes")


@query("op6_gif_media")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF, and the payload and colours read back from it."""
    return media_digests(store_media(table(spark, sf_dir, "documents")))


@query("op7_harmonic_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return pack(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query(
    "op9_line_dedup",
    """
    WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    windows AS (
        SELECT doc_id, i AS pos, {'a': l[i + 1], 'b': l[i + 2], 'c': l[i + 3]} AS w
        FROM lines, unnest(range(0, len(l) - 2)) AS t(i)
        WHERE trim(l[i + 1] || l[i + 2] || l[i + 3], ' ') <> ''),
    later AS (
        SELECT doc_id, pos FROM (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
    covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, unnest([0, 1, 2]) AS t(k)),
    kept AS (
        SELECT doc_id, string_agg(l[i + 1], chr(10) ORDER BY i) AS text, count(*) AS n
        FROM lines JOIN unnest(range(0, len(l))) AS t(i) ON true
        WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = lines.doc_id AND c.pos = i) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           coalesce(len(d.l), 0) AS n_lines, coalesce(len(d.l), 0) - coalesce(k.n, 0) AS n_removed
    FROM lines d LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    return dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", "n_entities", F.expr("transform(entities, e -> e.kind)").alias("kinds"))


@query(
    "op11_spelling_variants",
    """
    WITH RECURSIVE crc_table AS (
        SELECT list(r ORDER BY i) AS crcs FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS r
            FROM (SELECT unnest(range(256))::UBIGINT AS i))),
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run
        FROM documents),
    spoken AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY 1, 2),
    bytes AS (
        SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM spoken),
    hashed AS (
        SELECT doc_id, run, k, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, b::UBIGINT[]),
            lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255)::BIGINT + 1]))) AS h FROM bytes, crc_table),
    spelt AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
    cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM words, unnest(range(0, length(word))) AS t(i)),
    near AS (
        SELECT x.word, y.word AS o, y.n AS m FROM cuts x JOIN cuts y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.d = y.word
        UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.d = y.word),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(o, {'m': -m, 'o': o}) AS o FROM near GROUP BY 1),
    told AS (SELECT w.word, CASE WHEN m >= 10 * n THEN o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (SELECT word, word AS at FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.at WHERE t.form IS NOT NULL),
    ends AS (SELECT c.word, c.at AS root FROM chain c JOIN told t ON t.word = c.at WHERE t.form IS NULL)
    SELECT t.word, form, root, n, n_near, form_n FROM told t JOIN ends e ON e.word = t.word
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, its form and the root of its forms."""
    return group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cells AS (SELECT id, label, unnest(c) AS x, generate_subscripts(c, 1) AS at FROM v),
    scores AS (
        SELECT a.id AS a, b.id AS b, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS s
        FROM cells a JOIN cells b ON a.at = b.at AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL),
    friends AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM scores WHERE same) WHERE k <= 5),
    foes AS (
        SELECT f.a, f.b AS p, f.s AS ps, n.b, n.s, row_number() OVER (PARTITION BY f.a, f.b ORDER BY n.s DESC, n.b) AS k
        FROM friends f JOIN scores n ON n.a = f.a AND NOT n.same AND 50 * f.s <= 100 * n.s AND 100 * n.s <= 95 * f.s)
    SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM foes WHERE k <= 3
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives in the window of each of five positives of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 50 == 0)
