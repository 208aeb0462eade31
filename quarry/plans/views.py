"""The driver's tables seen as the engine's inputs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import table

CATALOG = """cat AS (
  SELECT d.doc_id, 2010 + CAST(d.doc_id % 16 AS INTEGER) AS ano, d.lang AS situacao_doc, d.source AS tipo_pdf,
    substr(d.text, 1, 60) AS titulo, d.source AS autor, substr(d.text, 61, 60) AS ementa, substr(d.text, 121) AS assunto, d.n_chars AS updated_at,
    CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 0 THEN 'error' ELSE 'ok' END AS status_download,
    CASE WHEN d.n_chars < 60 THEN 'skipped' WHEN d.n_chars % 7 = 0 THEN 'error' WHEN l.quality = 1 THEN 'ok' ELSE 'pending' END AS status_parse,
    CASE WHEN d.n_chars > 3600 THEN 'ok' WHEN l.toxic = 1 THEN 'error' ELSE 'pending' END AS status_chunk,
    CASE WHEN d.n_chars % 2 = 0 THEN 'pending' ELSE 'ok' END AS status_embed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n, q = F.col("n_chars"), F.col("quality")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", (F.lit(2010) + (F.col("doc_id") % 16).cast("int")).alias("ano"), F.col("lang").alias("situacao_doc"), F.col("source").alias("tipo_pdf"),
        F.substring("text", 1, 60).alias("titulo"), F.col("source").alias("autor"), F.substring("text", 61, 60).alias("ementa"), F.substring("text", 121, 2**31 - 1).alias("assunto"), n.alias("updated_at"),
        F.when(q.isNull(), "pending").when(q == 0, "error").otherwise("ok").alias("status_download"),
        F.when(n < 60, "skipped").when(n % 7 == 0, "error").when(q == 1, "ok").otherwise("pending").alias("status_parse"),
        F.when(n > 3600, "ok").when(F.col("toxic") == 1, "error").otherwise("pending").alias("status_chunk"),
        F.when(n % 2 == 0, "pending").otherwise("ok").alias("status_embed"),
    )


#: A document as a page of its source; every third one has a table.
PAGES = """pg AS (
  SELECT source AS doc_id, doc_id AS page_index, n_chars AS char_count, doc_id % 3 = 0 AS suspected_table,
    CASE WHEN n_chars < 60 THEN 'scanned' WHEN doc_id % 3 = 0 THEN 'complex' ELSE 'digital' END AS classification,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text_markdown, doc_id % 6 = 0 AS has_one, doc_id % 11 = 0 AS has_revoked
  FROM documents
)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.pages import classify, needs_vision

    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), i.alias("page_index"), F.col("n_chars").alias("char_count"), classify(F.col("n_chars"), i % 3 == 0).alias("classification"),
        F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("text_markdown"),
        F.when(i % 6 == 0, F.array(F.concat(F.lit("| t"), i.cast("string"), F.lit(" |")))).otherwise(F.array().cast("array<string>")).alias("tables_markdown"), (i % 11 == 0).alias("has_revoked"),
    )
    return rows.withColumn("needs_vision", needs_vision(F.col("classification"), F.col("text_markdown"), F.col("tables_markdown")))


#: Lines of documents with headings put in: every 5th an article's, every other 13th a chapter's; 20 lines a page.
LINES = r"""raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents
), ln AS (
  SELECT doc_id, CAST(n // 20 AS INTEGER) AS page_index, CAST(n AS INTEGER) AS line_no,
    regexp_replace(CASE WHEN n % 5 = 0 THEN 'Art. ' || (n // 5 + 1) || ' ' || l WHEN n % 13 = 0 THEN 'CAPÍTULO IV ' || l ELSE l END, '\s+$', '') AS line
  FROM raw
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.text import strip_end

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    n = F.col("n")
    text = F.when(n % 5 == 0, F.concat(F.lit("Art. "), (F.floor(n / 5) + 1).cast("string"), F.lit(" "), F.col("l"))).when(n % 13 == 0, F.concat(F.lit("CAPÍTULO IV "), F.col("l"))).otherwise(F.col("l"))
    return rows.select("doc_id", F.floor(n / 20).cast("int").alias("page_index"), n.alias("line_no"), strip_end(text).alias("line"))


#: Lines as pieces, with a table at every 7th and a strike-out at every 11th; empty lines are none.
PIECES = r"""raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents
), pc AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS piece_no, CAST(n // 20 AS INTEGER) AS page_start, CAST((n + 1) // 20 AS INTEGER) AS page_end, 'Art. ' || (n // 5) AS article_ref,
    l || CASE WHEN n % 7 = 3 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' ELSE '' END || CASE WHEN n % 11 = 5 THEN ' ~~gone~~' ELSE '' END AS piece
  FROM raw WHERE regexp_matches(l, '\S')
)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "l")).where(F.rlike("l", F.lit(r"\S")))
    n = F.col("n")
    grid = F.when(n % 7 == 3, "\n| a | b |\n| --- | --- |\n| 1 | 2 |").otherwise("")
    piece = F.concat("l", grid, F.when(n % 11 == 5, " ~~gone~~").otherwise(""))
    return rows.select(
        "doc_id", n.alias("piece_no"), F.floor(n / 20).cast("int").alias("page_start"), F.floor((n + 1) / 20).cast("int").alias("page_end"), F.concat(F.lit("Art. "), F.floor(n / 5).cast("string")).alias("article_ref"), piece.alias("piece")
    )


#: Queries of dense search: vectors whose id is divisible by 50.
DENSE = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), cs AS (
  SELECT query_id, vec_id AS chunk_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, qv
), dn AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM cs
)"""


def dense_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


#: Queries of sparse search: the benchmark's texts.
SPARSE = r"""tk AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents), po AS (
  SELECT doc_id, term, count(*) AS weight FROM tk WHERE term <> '' GROUP BY ALL
), qt AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark), qp AS (
  SELECT item_id, term, count(*) AS weight FROM qt WHERE term <> '' GROUP BY ALL
), sc AS (
  SELECT q.item_id AS query_id, p.doc_id AS chunk_id, CAST(sum(p.weight * q.weight) AS DOUBLE) AS score FROM po p JOIN qp q ON p.term = q.term GROUP BY ALL
), sp AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc
)"""


def sparse_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from quarry.operators.vectors import postings, term_lists

    return term_lists(table(spark, sf_dir, "documents"), "doc_id", "text"), postings(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")


#: Questions that name numbers of page addresses; every other one a year too.
QUESTIONS = r"""qs AS (
  SELECT item_id AS query_id, 'What do resolutions ' || array_to_string(list_transform(range(6), lambda k: 100 + (item_id * 37 + k * 211) % 900), ', ') || ' say' || CASE WHEN item_id % 2 = 0 THEN ' of ' || (2010 + item_id % 16) ELSE '' END || '? ' || text AS question FROM benchmark
), nb AS (
  SELECT query_id, question, regexp_extract_all(lower(question), '\b(201[0-9]|202[0-5])\b', 1) AS years, regexp_extract_all(lower(question), '\b(\d{3,5})\b', 1) AS every FROM qs
), nn AS (SELECT query_id, question, years, list_filter(every, lambda n: NOT list_contains(years, n)) AS nums FROM nb), fl AS (
  SELECT page_id AS doc_id, url || '?' || (2010 + page_id % 16) AS arquivo FROM pages
), ih AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM nn, fl
  WHERE len(list_filter(nums, lambda n: contains(arquivo, n))) > 0 AND (len(years) = 0 OR len(list_filter(years, lambda y: contains(arquivo, y))) > 0)
), idd AS (SELECT query_id, doc_id FROM ih WHERE n <= 40)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    year = F.when(i % 2 == 0, F.concat(F.lit(" of "), (F.lit(2010) + i % 16).cast("string"))).otherwise("")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat(F.lit("What do resolutions "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (100 + (i * 37 + k * 211) % 900).cast("string")), ", "), F.lit(" say"), year, F.lit("? "), F.col("text")).alias("question"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat("url", F.lit("?"), (F.lit(2010) + F.col("page_id") % 16).cast("string")).alias("arquivo"))
