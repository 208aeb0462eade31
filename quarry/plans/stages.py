"""Queries over stages, stores, audits, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry import quarantine
from quarry.operators import answers, audit, ruling, trigrams, vectors
from quarry.operators import catalog as cat
from quarry.operators import chunks as ch
from quarry.operators import evaluation as ev
from quarry.operators import pages as pg
from quarry.operators import retrieval as rt
from quarry.plans import documents, search, views
from quarry.plans.documents import ORACLES, QUERIES, query
from quarry.providers import answered
from quarry.session import cut, table
from quarry.sources import files, store, tables

__all__ = ["ORACLES", "QUERIES"]


@query(documents.META_SQL + r""", m AS (
  SELECT regexp_replace(regexp_extract(CASE WHEN arquivo <> '' THEN arquivo ELSE u END, '([^/]*)/*$', 1), '([^.])\.[^.]+$', '\1') || '__' || substr(sha1(u), 1, 10) AS doc_id, titulo, ano FROM p WHERE lower(split_part(u, '?', 1)) LIKE '%.pdf'
), o AS (SELECT doc_id, 'old' AS titulo, 1 AS ano, 'ok' AS status FROM m WHERE ano = 2017 UNION ALL SELECT 'gone', 'old', 1, 'ok')
SELECT coalesce(m.doc_id, o.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN o.titulo ELSE m.titulo END AS titulo, CASE WHEN m.doc_id IS NULL THEN o.ano ELSE m.ano END AS ano, coalesce(o.status, 'pending') AS status_download, coalesce(o.status, 'pending') AS status_embed
FROM m FULL JOIN o ON m.doc_id = o.doc_id""")
def catalog_load(spark, d):
    records = cat.flatten_metadata(documents.metadata_files(spark, d), ordered=True)
    empty = cat.empty_snapshot(spark)
    known = records.where("ano = 2017").select("doc_id").union(spark.createDataFrame([("gone",)], "doc_id string"))
    given = {"titulo": F.lit("old"), "ano": F.lit(1), **{f"status_{s}": F.lit("ok") for s in cat.STAGES}}
    old = known.select("doc_id", *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema if f.name != "doc_id"))
    return cat.loaded(empty.unionByName(old), records).select("doc_id", "titulo", "ano", "status_download", "status_embed")


@query(f"""WITH {documents.PAGES}, {views.CATALOG.replace('d.doc_id, 2010', 'd.source AS doc, d.doc_id, 2010')}, ok AS (
  SELECT doc AS doc_id FROM cat GROUP BY doc HAVING count(*) FILTER (status_download = 'ok' AND status_parse = 'ok') * 4 >= count(*) * 1
) SELECT doc_id FROM ok WHERE doc_id IN (SELECT doc_id FROM pn WHERE needs_vision) ORDER BY doc_id LIMIT 10""")
def vision_candidates(spark, d):
    done = (F.col("status_download") == "ok") & (F.col("status_parse") == "ok")
    docs = views.catalog(spark, d).groupBy(F.col("tipo_pdf").alias("doc_id")).agg((F.count_if(done) * 4 >= F.count("*")).alias("ok"))
    status = F.when(F.col("ok"), "ok").otherwise("error")
    return cat.vision_candidates(docs.select("doc_id", status.alias("status_parse"), status.alias("status_download")), views.pages(spark, d), 10).select("doc_id")


CHUNKED = "ck AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text FROM documents), ch AS (SELECT doc_id, text FROM ck WHERE text IS NOT NULL)"


@query(f"""WITH {views.CATALOG}, {CHUNKED}, pd AS (SELECT doc_id FROM cat WHERE status_embed IN ('pending', 'error') AND status_download = 'ok' AND status_chunk = 'ok')
SELECT p.doc_id, count(c.doc_id) AS chunks, count(c.doc_id) = 0 AS marked_ok FROM pd p LEFT JOIN ch c ON p.doc_id = c.doc_id GROUP BY 1""")
def embed_work(spark, d):
    chunks = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", "text")
    todo, none = cat.embed_work(views.catalog(spark, d), chunks)
    return todo.groupBy("doc_id").agg(F.count("*").alias("chunks")).withColumn("marked_ok", F.lit(False)).unionByName(none.select("doc_id", F.lit(0).cast("long").alias("chunks"), F.lit(True).alias("marked_ok")))


@query("""SELECT count(*) AS pending, count(*) FILTER (doc_id % 7 <> 0) AS ok, count(*) FILTER (doc_id % 7 = 0) AS errors, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END) AS BIGINT) AS chars FROM documents""")
def job_statistics(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(i % 7 == 0, "error").otherwise("ok").alias("status"), F.when(i % 7 == 0, 0).otherwise(F.col("n_chars")).alias("n"))
    return cat.job_statistics(rows, {"chars": "n"})


@query(r"""SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'a_b_' || page_id || '.PDF' ELSE 'x' || page_id END, '(?i)\.pdf$', '') || '__' || substr(sha1(url), 1, 10) || '.pdf' AS name FROM pages""")
def local_names(spark, d):
    i = F.col("page_id").cast("string")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/b\\"), i, F.lit(".PDF"))).otherwise(F.concat(F.lit("x"), i))
    return table(spark, d, "pages").select("page_id", files.local_name(documents.document_id(F.lit(""), F.col("url")), given).alias("name"))


@query("SELECT doc_id, doc_id % 3 = 0 AS is_pdf, CASE WHEN doc_id % 4 = 1 THEN 'error' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'skipped' END AS status FROM documents")
def magic_sniff(spark, d):
    i = F.col("doc_id")
    content = F.encode(F.concat(F.when(i % 3 == 0, "%PDF").otherwise("%pdf"), "text"), "UTF-8")
    return table(spark, d, "documents").select("doc_id", files.sniffed(content).alias("is_pdf"), files.parse_status(F.when(i % 4 != 1, content)).alias("status"))


TABLES_SQL = """tb AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber % 2 AS page_index, l_linenumber AS table_no, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source, l_linenumber % 5 <> 0 AS full_one, '| ' || l_linestatus || ' | ' || l_linenumber || ' |' || chr(10) || '| --- | --- |' AS markdown FROM lineitem
), tf AS (SELECT * FROM tb WHERE full_one), tr AS (SELECT doc_id, min(source) AS best FROM tf GROUP BY 1)"""


@query(f"WITH {TABLES_SQL} SELECT t.doc_id, t.page_index, string_agg(t.markdown, chr(10) ORDER BY t.table_no, t.markdown) AS tables FROM tf t JOIN tr r ON t.doc_id = r.doc_id AND t.source = r.best GROUP BY ALL")
def tables_by_page(spark, d):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    row = F.array(F.array(F.col("l_linestatus"), n.cast("string")))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), (n % 2).alias("page_index"), n.alias("table_no"), F.when(flag == "R", "primary").when(flag == "A", "lattice").otherwise("stream").alias("source"),
        F.when(n % 5 != 0, row).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
    )
    return pg.tables_by_page(rows).select("doc_id", "page_index", F.array_join("tables_markdown", "\n").alias("tables"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE round(least(1.0, (l_quantity + l_tax) / (l_linenumber * 20.0)), 9) END AS ratio FROM lineitem""")
def image_ratio(spark, d):
    n = F.col("l_linenumber")
    areas = F.array(F.col("l_quantity"), F.lit(None).cast("double"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(pg.image_ratio(areas, F.when(n == 3, 0.0).otherwise(n * 20.0)), 9).alias("ratio"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'rect' ELSE 'line' END AS kind, l_quantity AS x0, l_tax * 10 AS y0, l_quantity + l_linenumber * 2 - 9 AS x1, l_discount * 30 AS y1 FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS page_index, round(least(x0, x1), 6) AS x0, round(least(y0, y1), 6) AS y0, round(greatest(x0, x1), 6) AS x1, round(greatest(y0, y1), 6) AS y1 FROM m
WHERE (kind = 'line' AND abs(y1 - y0) <= 1.2 AND abs(x1 - x0) > 4) OR (kind = 'rect' AND y1 - y0 <= 2.0 AND x1 - x0 > 4)""")
def stroke_lines(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), n.alias("page_index"), F.when(n % 2 == 0, "rect").otherwise("line").alias("kind"), q.alias("x0"), (F.col("l_tax") * 10).alias("y0"), (q + n * 2 - 9).alias("x1"), (F.col("l_discount") * 30).alias("y1")
    )
    return pg.stroke_lines(rows).select("doc_id", "page_index", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""WITH o AS (SELECT source AS doc_id, doc_id AS page_index, 'old' AS status FROM documents WHERE doc_id % 2 = 0), n AS (SELECT source AS doc_id, doc_id AS page_index, 'new' AS status FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.page_index, o.page_index) AS page_index, coalesce(n.status, o.status) AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.page_index = n.page_index""")
def merge_vision(spark, d):
    rows = lambda k, s: table(spark, d, "documents").where(F.col("doc_id") % k == 0).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), F.lit(s).alias("status"))
    return pg.merge_vision(rows(2, "old"), rows(3, "new"))


@query("""SELECT e.vec_id AS chunk_id, e.vec_id AS doc_id, d.lang AS situacao_doc, d.source AS autor FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id AND d.doc_id % 3 <> 0""")
def payload_flatten(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.lit("mine").alias("autor"))
    docs = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("situacao_doc"), F.col("source").alias("autor"))
    return ch.with_metadata(chunks, docs, ["situacao_doc", "autor"]).select("chunk_id", "doc_id", "situacao_doc", "autor")


POINTS = """pt AS (SELECT CAST(doc_id AS VARCHAR) AS point_id, doc_id % 40 AS doc_id, source AS arquivo, 'a' AS side FROM documents WHERE doc_id % 2 = 0), nw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS point_id, l_orderkey % 40 AS doc_id, max(l_linestatus || l_linenumber) AS arquivo, 'b' AS side FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey
)"""


def points(spark, d):
    i, k = F.col("doc_id"), F.col("l_orderkey")
    old = table(spark, d, "documents").where("doc_id % 2 = 0").select(i.cast("string").alias("point_id"), (i % 40).alias("doc_id"), F.lit("0").alias("chunk_id"), F.col("source").alias("arquivo"), F.lit("a").alias("side"))
    name = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    new = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(k.cast("string").alias("point_id"), (k % 40).alias("doc_id"), name.alias("chunk_id"), name.alias("arquivo"), F.lit("b").alias("side"))
    return old, new


@query(f"WITH {POINTS} SELECT point_id, arquivo, side FROM nw UNION ALL SELECT point_id, arquivo, side FROM pt WHERE point_id NOT IN (SELECT point_id FROM nw)")
def point_upsert(spark, d):
    return tables.upsert_points(*points(spark, d)).select("point_id", "arquivo", "side")


@query(f"WITH {POINTS} SELECT point_id, doc_id FROM pt WHERE doc_id NOT IN (SELECT doc_id FROM nw WHERE doc_id % 4 = 0)")
def point_delete(spark, d):
    old, new = points(spark, d)
    return tables.without_documents(old, new.where("doc_id % 4 = 0")).select("point_id", "doc_id")


@query(f"WITH {POINTS} SELECT doc_id, arg_min(arquivo, point_id) AS arquivo, count(*) AS points FROM pt GROUP BY 1")
def document_index(spark, d):
    old, _ = points(spark, d)
    return tables.document_index(old).join(old.groupBy("doc_id").agg(F.count("*").alias("points")), "doc_id")


@query("""WITH c AS (SELECT item_id, 'case ' || item_id AS question, CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'c' || item_id END AS id, item_id % 7 = 0 AS blank FROM benchmark)
SELECT coalesce(id, 'case_' || lpad(CAST(item_id AS VARCHAR), 4, '0')) AS case_id, question, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS n_expected, CASE WHEN item_id % 2 = 0 THEN 'gold' END AS gold_answer FROM c WHERE NOT blank""")
def eval_cases(spark, d):
    i = F.col("item_id")
    fields = F.struct(
        F.when(i % 4 != 0, F.concat(F.lit("c"), i.cast("string"))).alias("id"), F.concat(F.lit("case "), i.cast("string")).alias("question"),
        F.when(i % 3 != 0, F.array(F.lit("x"), F.lit("y"))).alias("expected_doc_ids"), F.when(i % 2 == 0, "gold").alias("gold_answer"),
    )
    lines = table(spark, d, "benchmark").select(i.alias("n"), F.when(i % 7 == 0, " ").otherwise(F.to_json(fields)).alias("line"))
    return tables.parsed_cases(lines).select("case_id", "question", F.size("expected_doc_ids").alias("n_expected"), "gold_answer")


AUDIT = f"""{documents.PAGES}, ad AS (
  SELECT doc_id, count(*) AS pages, count(*) FILTER (classification = 'digital') AS digital_pages, bool_or(has_revoked) AS any_revoked, CAST(sum(CASE WHEN has_one THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum(char_count) AS BIGINT) AS chars FROM pn GROUP BY 1
), cc AS (SELECT source AS doc_id, count(*) AS chunks, count(*) FILTER (doc_id % 22 = 0) AS revoked_chunks FROM documents WHERE lang <> 'fr' AND source NOT LIKE '%1' GROUP BY 1),
vv AS (SELECT source AS doc_id, count(*) AS points FROM documents WHERE lang <> 'fr' AND source NOT LIKE '%2' GROUP BY 1), cl AS (
  SELECT source AS doc_id, CASE WHEN source LIKE '%3' THEN 'error' ELSE 'ok' END AS status_download, CASE WHEN source LIKE '%4' THEN 'pending' ELSE 'ok' END AS status_chunk FROM documents GROUP BY 1 UNION ALL SELECT 'missing', 'ok', 'ok'
), au AS (SELECT cl.*, ad.pages, ad.digital_pages, ad.any_revoked, ad.tables, ad.chars, cc.chunks, cc.revoked_chunks, vv.points FROM cl LEFT JOIN ad ON cl.doc_id = ad.doc_id LEFT JOIN cc ON cl.doc_id = cc.doc_id LEFT JOIN vv ON cl.doc_id = vv.doc_id)"""


def audited(spark, d):
    docs = table(spark, d, "documents")
    i, s = F.col("doc_id"), F.col("source")
    chunks = docs.where((F.col("lang") != "fr") & ~s.endswith("1")).select(s.alias("doc_id"), i.alias("chunk_index"), "text", F.lit(False).alias("has_table"), (i % 22 == 0).alias("has_revoked"))
    stored = docs.where((F.col("lang") != "fr") & ~s.endswith("2")).select(s.alias("doc_id"))
    known = docs.select(s.alias("doc_id")).distinct()
    rows = known.select("doc_id", F.when(F.col("doc_id").endswith("3"), "error").otherwise("ok").alias("status_download"), F.lit("ok").alias("status_parse"), F.when(F.col("doc_id").endswith("4"), "pending").otherwise("ok").alias("status_chunk"))
    rows = rows.union(spark.createDataFrame([("missing", "ok", "ok", "ok")], rows.schema))
    return audit.document_audit(rows, views.pages(spark, d), chunks, stored)


@query(f"WITH {AUDIT} SELECT doc_id, pages, digital_pages, any_revoked, tables, chars, chunks, revoked_chunks, points FROM au")
def document_audit(spark, d):
    return audited(spark, d).select("doc_id", "pages", "digital_pages", "any_revoked", F.col("tables").cast("long").alias("tables"), "chars", "chunks", "revoked_chunks", "points")


@query(f"""WITH {AUDIT} SELECT doc_id, 'not downloaded' AS issue FROM au WHERE status_download <> 'ok' UNION ALL SELECT doc_id, 'parsed without pages' FROM au WHERE pages IS NULL
UNION ALL SELECT doc_id, 'chunked without chunks' FROM au WHERE status_chunk = 'ok' AND coalesce(chunks, 0) = 0 UNION ALL SELECT doc_id, 'chunks and points differ' FROM au WHERE coalesce(chunks, 0) <> coalesce(points, 0)
UNION ALL SELECT doc_id, 'struck-out text lost' FROM au WHERE coalesce(any_revoked, false) AND coalesce(revoked_chunks, 0) = 0""")
def audit_issues(spark, d):
    return audit.issues(audited(spark, d))


@query("SELECT source AS doc_id, count(*) AS n FROM documents WHERE contains(text, 'a') AND contains(text, 'e') AND (contains(text, 'qu') OR contains(text, 'sch')) GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 3")
def top_mentions(spark, d):
    return audit.mentions(table(spark, d, "documents").select(F.col("source").alias("doc_id"), "text"), "text", ["a", "e"], ["qu", "sch"])


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 1 AND 2000")
def valid_questions(spark, d):
    return answers.checked(table(spark, d, "documents").withColumnRenamed("text", "question"), 50).select("doc_id", F.length("question").alias("n"))


ANSWER = search.CONTEXT + r""", an AS (SELECT query_id, n, substr(regexp_replace(context, '^\s+|\s+$', '', 'g'), 1, 300) AS answer FROM ct)"""


@query(f"WITH {ANSWER} SELECT query_id, md5(answer) AS answer_md5, n AS n_citations, NOT ((lower(answer) LIKE 'não consta%' OR lower(answer) LIKE 'nao consta%') AND length(answer) <= 300) AS passed FROM an")
def answered_questions(spark, d):
    hits = search.context_hits(spark, d)
    asked = hits.select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("question")).distinct()
    out = answers.benchmark_passed(answers.answer(hits, asked))
    return out.select("query_id", F.md5("answer").alias("answer_md5"), F.size("citations").cast("long").alias("n_citations"), "passed")


@query(f"""WITH {search.CASES}, ew AS (
  SELECT DISTINCT q.query_id AS case_id, list_contains(e.expected, r1.chunk_id) AS h1 FROM (SELECT DISTINCT query_id FROM qv) q
  JOIN (SELECT query_id, [query_id + 1, query_id + 3, chunk_id] AS expected FROM dn WHERE rank = 3) e ON e.query_id = q.query_id JOIN dn r1 ON r1.query_id = q.query_id AND r1.rank = 1
) SELECT case_id, h1 AS hit_at_1, true AS hit_at_3, CASE WHEN case_id % 100 = 0 THEN 4.0::DOUBLE END AS score FROM ew""")
def evaluated_cases(spark, d):
    v, q = views.dense_inputs(spark, d)
    hits = vectors.dense_top_k(v, q, k=10).select("query_id", F.col("rank").alias("final_rank"), F.col("chunk_id").alias("doc_id"))
    i = F.col("query_id")
    cases = hits.where("final_rank = 3").select(i.alias("case_id"), F.array(i + 1, i + 3, F.col("doc_id")).alias("expected_doc_ids"), F.when(i % 100 == 0, "gold").alias("gold_answer"))
    replies = cases.select("case_id", F.lit('{"score": 4, "rationale": "so"}').alias("reply"))
    found, _ = answers.evaluate(cases, hits, replies)
    return found.select("case_id", "hit_at_1", "hit_at_3", "score")


#: Hybrid search within filters on the payload: they apply before each ranking, not after it.
FILTERED = {"situacao_doc": ["en", "de"], "has_revoked": False}
_KEPT = "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id % 11 <> 0"


def _filtered(sql: str) -> str:
    sql = sql.replace("FROM tk", "FROM (SELECT t.* FROM tk t JOIN kp ON t.doc_id = kp.doc_id) tk") if "FROM tk" in sql else sql
    return f"kp AS ({_KEPT}), " + sql.replace("embeddings v\n)", "(SELECT e.* FROM embeddings e JOIN kp ON e.vec_id = kp.doc_id) v\n)").replace("FROM pages\n", "FROM pages WHERE page_id IN (SELECT doc_id FROM kp)\n")


@query(f"WITH {_filtered(search.HYBRID)} SELECT query_id, chunk_id, score, final_rank FROM fin WHERE final_rank <= 6")
def hybrid_filtered(spark, d):
    return search.found(spark, d, FILTERED).select("query_id", "chunk_id", "score", "final_rank")


@query("SELECT doc_id, md5(text) AS text_md5, doc_id % 4 = 0 AS rewritten FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || text ELSE text END AS text FROM documents)")
def chunk_rewrite(spark, d):
    """Chunks stored as JSON lines; those of some documents are written anew, the others stay."""
    from quarry.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/chunks-{spark.sql('SELECT uuid()').first()[0]}"
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    tables.write_chunks(rows, path)
    tables.write_chunks(rows.where(F.col("doc_id").cast("long") % 4 == 0).withColumn("text", F.concat(F.lit("new "), "text")), path)
    stored = cut(tables.read_chunks(spark, path, "doc_id string, text string"))
    i = F.col("doc_id").cast("long")
    return stored.select(i.alias("doc_id"), F.md5("text").alias("text_md5"), (i % 4 == 0).alias("rewritten"))


@query("""SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN 'second' ELSE 'first' END AS version, n_chars FROM documents WHERE doc_id % 100 NOT IN (2, 3)
UNION ALL SELECT doc_id, 'more', n_chars FROM documents WHERE doc_id % 100 = 1""")
def store_upsert(spark, d):
    """A store of documents after a batch that replaces some, one that deletes some, a compaction, and one more deletion."""
    from quarry.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/store-{spark.sql('SELECT uuid()').first()[0]}"
    docs = table(spark, d, "documents").select("doc_id", F.lit("first").alias("version"), "n_chars")
    rest = lambda k: docs.where(F.col("doc_id") % 100 == k)
    store.write(docs, path)
    store.write(rest(1).withColumn("version", F.explode(F.array(F.lit("second"), F.lit("more")))), path, rest(2))
    store.compact(spark, path, sort=("n_chars",), bloom=("doc_id",))
    store.delete(rest(3), path)
    return store.read(spark, path)


#: Lines of orders as rows of a page, each ruled in three cells; numbers that are missing part tables.
RULED_SQL = """ln AS (SELECT l_orderkey, l_linenumber AS n, max(l_returnflag) AS flag, min(l_linestatus) AS state FROM lineitem GROUP BY 1, 2)"""


#: Lines of a partition, about.
LINES = 100_000


def order_lines(spark, d):
    """The lines by page, and the number of their partitions."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"))
    rows = cut(rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), "n", "flag", "state", (F.col("n") * 12.0).alias("y")))
    # Lines are few: the strokes and spans made of them needn't move again (with one partition Spark moves them). Each task sorts what LINES of them make.
    parts = max(2, -(-rows.count() // LINES))
    return ruling.parted(rows, parts), parts


def cells_as_spans(rows, cells):
    """Spans of (text, x) in each row."""
    each = rows.select("doc_id", "page_index", F.col("n").alias("line_no"), "y", F.explode(F.array(*(F.struct(F.lit(k).alias("span_no"), t.alias("text"), F.lit(x).alias("x0")) for k, (t, x) in enumerate(cells)))).alias("c"))
    return each.select("doc_id", "page_index", "line_no", "c.*", (F.col("c.x0") + 10).alias("x1"), (F.col("y") + 1).alias("y0"), (F.col("y") + 11).alias("y1"))


@query(rf"""WITH {RULED_SQL}, g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS isl FROM ln), h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, isl ORDER BY n) AS r FROM g), m AS (
  SELECT l_orderkey, isl, string_agg('| ' || n || ' | ' || flag || ' | ' || state || ' |' || CASE WHEN r = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY n) AS markdown FROM h GROUP BY ALL
) SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY isl) - 1 AS INTEGER) AS table_no, markdown FROM m""")
def ruled_tables(spark, d):
    rows, parts = order_lines(spark, d)
    spans = cells_as_spans(rows, [(F.col("n").cast("string"), 10.0), (F.col("flag"), 50.0), (F.col("state"), 90.0)])
    lines = [(0.0, 0.0, 120.0, 0.0), (0.0, 12.0, 120.0, 12.0), *((x, 0.0, x, 12.0) for x in (0.0, 40.0, 80.0, 120.0))]
    strokes = rows.select("doc_id", "page_index", "y", F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(line, ("x0", "a", "x1", "b"), strict=True))) for line in lines))).alias("s"))
    strokes = strokes.select("doc_id", "page_index", "s.x0", (F.col("y") + F.col("s.a")).alias("y0"), "s.x1", (F.col("y") + F.col("s.b")).alias("y1"))
    return ruling.lattice(spans, strokes, parts).select("doc_id", "table_no", pg.table_markdown(F.col("rows")).alias("markdown"))


@query(rf"""WITH {RULED_SQL}, k AS (SELECT *, flag <> 'N' AS two FROM ln), c AS (SELECT *, CASE WHEN two AND lag(two) OVER (PARTITION BY l_orderkey ORDER BY n) THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM c), m AS (
  SELECT l_orderkey, run, count(*) AS lines, string_agg(n || ',' || flag, ';' ORDER BY n) AS rows FROM g WHERE two GROUP BY ALL HAVING count(*) > 1
) SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY run) - 1 AS INTEGER) AS table_no, rows FROM m""")
def aligned_tables(spark, d):
    rows, parts = order_lines(spark, d)
    spans = cells_as_spans(rows, [(F.col("n").cast("string"), 10.0), (F.when(F.col("flag") != "N", F.col("flag")).otherwise(""), 80.0)])
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return ruling.stream(spans, parts).select("doc_id", "table_no", joined.alias("rows"))


@query(documents.ORACLES["browser_search"])
def browser_indexed(spark, d):
    """The rows of browser_search from lists of three-letter strings."""
    from quarry.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/trigrams-{spark.sql('SELECT uuid()').first()[0]}"
    docs = views.catalog(spark, d)
    trigrams.write(trigrams.lists(docs), path)
    return documents.browsed(docs, trigrams.read(spark, path))


@query("""SELECT doc_id, CASE WHEN doc_id % 250 <> 7 THEN length(text) END AS n, CASE WHEN doc_id % 250 = 7 THEN 'ValueError: no. ' || doc_id END AS error FROM documents""")
def isolated_work(spark, d):
    """Lengths of texts, found in child processes; some documents fail there."""

    def make():
        def work(row):
            if row["doc_id"] % 250 == 7:
                raise ValueError(f"no. {row['doc_id']}")
            return [{"n": len(row["text"])}]

        return work

    return quarantine.isolated(table(spark, d, "documents").select("doc_id", "text"), make, StructType([StructField("n", LongType())]))
