"""Queries over catalog, pages and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ids import NAMESPACE, chunk_id, document_id, point_id
from quarry.functions.text import snippet
from quarry.operators import catalog as cat
from quarry.operators import chunks as ch
from quarry.operators import pages as pg
from quarry.plans import views
from quarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


META_SQL = r"""WITH r AS (
  SELECT page_id, 2016 + CAST(page_id % 3 AS INTEGER) AS ano, 'bucket' || (page_id % 4) AS data_bucket, 'T' || page_id AS titulo, 'Situação: ' || CASE WHEN page_id % 5 = 0 THEN '' ELSE 'VIGENTE' END AS situacao,
    'assunto: ' || (page_id % 9) AS assunto, url, CASE WHEN page_id % 2 = 0 THEN 'a' || page_id || '.pdf' ELSE '' END AS arquivo FROM pages
), p AS (
  SELECT *, url || '/' || page_id || CASE WHEN page_id % 4 = 3 THEN '.html' WHEN page_id % 4 = 2 THEN '.PDF?x=1' ELSE '.pdf' END AS u FROM r
)
"""


def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata document for each page, as the files hold them."""
    i = F.col("page_id")
    url = F.concat("url", F.lit("/"), i.cast("string"), F.when(i % 4 == 3, ".html").when(i % 4 == 2, ".PDF?x=1").otherwise(".pdf"))
    pdf = F.struct(F.lit("Texto Integral: ").alias("tipo"), url.alias("url"), F.when(i % 2 == 0, F.concat(F.lit("a"), i.cast("string"), F.lit(".pdf"))).otherwise("").alias("arquivo"))
    entry = F.struct(
        F.concat(F.lit("T"), i.cast("string")).alias("titulo"), F.concat(F.lit("Situação: "), F.when(i % 5 == 0, "").otherwise("VIGENTE")).alias("situacao"), F.concat(F.lit("assunto: "), (i % 9).cast("string")).alias("assunto"), F.array(pdf).alias("pdfs")
    )
    value = F.to_json(F.create_map(F.concat(F.lit("bucket"), (i % 4).cast("string")), F.struct(F.array(entry).alias("registros"))))
    return table(spark, sf_dir, "pages").select(value.alias("value"), F.concat(F.lit("x_"), (F.lit(2016) + i % 3).cast("string"), F.lit("_metadados.json")).alias("file_name"))


@query(META_SQL + r"""SELECT regexp_replace(regexp_extract(CASE WHEN arquivo <> '' THEN arquivo ELSE u END, '([^/]*)/*$', 1), '([^.])\.[^.]+$', '\1') || '__' || substr(sha1(u), 1, 10) AS doc_id,
  u AS url, arquivo, ano, 'Texto Integral' AS tipo_pdf, titulo, nullif(trim(substr(situacao, 10)), '') AS situacao_doc, trim(substr(assunto, 9)) AS assunto, data_bucket
FROM p WHERE lower(split_part(u, '?', 1)) LIKE '%.pdf'""")
def metadata_flatten(spark, d):
    return cat.flatten_metadata(metadata_files(spark, d)).select("doc_id", "url", "arquivo", "ano", "tipo_pdf", "titulo", "situacao_doc", "assunto", "data_bucket")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '([^.])\.[^.]+$', '\1') || '__' || substr(sha1(url), 1, 10) AS doc_id FROM pages""")
def doc_ids(spark, d):
    return table(spark, d, "pages").select("page_id", document_id(F.lit(""), F.col("url")).alias("doc_id"))


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{NAMESPACE}') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query(f"""WITH {views.CATALOG}, s AS (
  SELECT doc_id, unnest(['download', 'parse', 'chunk', 'embed']) AS stage, unnest([status_download, status_parse, status_chunk, status_embed]) AS status FROM cat
) SELECT stage, status, count(*) AS n FROM s GROUP BY ALL""")
def stage_counts(spark, d):
    return cat.stage_counts(views.catalog(spark, d))


@query(f"""WITH {views.CATALOG}, s AS (
  SELECT doc_id, unnest(['download', 'parse', 'chunk', 'embed']) AS stage, unnest([status_download, status_parse, status_chunk, status_embed]) AS status FROM cat
), t AS (SELECT stage, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'error') AS error FROM s GROUP BY stage)
SELECT *, ok + pending + error AS total, CASE WHEN ok + pending + error > 0 THEN ok / (ok + pending + error) ELSE 0.0 END AS ok_ratio FROM t""")
def stage_progress(spark, d):
    return cat.stage_progress(views.catalog(spark, d))


def _pending(stage: str, gates: str) -> None:
    sql = f"WITH {views.CATALOG} SELECT doc_id FROM cat WHERE status_{stage} IN ('pending', 'error') {gates}"
    QUERIES[f"pending_{stage}"] = lambda spark, d: cat.pending(views.catalog(spark, d), stage).select("doc_id")
    ORACLES[f"pending_{stage}"] = sql


_pending("download", "")
_pending("parse", "AND status_download = 'ok'")
_pending("chunk", "AND status_download = 'ok' AND status_parse = 'ok'")
_pending("embed", "AND status_download = 'ok' AND status_chunk = 'ok'")


@query(f"""WITH {views.CATALOG} SELECT doc_id, updated_at FROM cat
WHERE 'error' IN (status_download, status_parse, status_chunk, status_embed) ORDER BY updated_at DESC NULLS LAST, doc_id LIMIT 200""")
def error_listing(spark, d):
    return cat.errors(views.catalog(spark, d)).select("doc_id", "updated_at")


UPSERT_SQL = f"""WITH {views.CATALOG}, old AS (SELECT doc_id, titulo, ano, status_download FROM cat WHERE doc_id % 3 <> 0), inc AS (
  SELECT user_id AS doc_id, 'title ' || event_id AS titulo, CAST(event_id % 20 AS INTEGER) AS ano, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events
), new AS (SELECT doc_id, titulo, ano FROM inc WHERE n = 1)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.titulo ELSE o.titulo END AS titulo, CASE WHEN n.doc_id IS NOT NULL THEN n.ano ELSE o.ano END AS ano,
  coalesce(o.status_download, 'pending') AS status_download FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""


@query(UPSERT_SQL)
def upsert_latest(spark, d):
    old = views.catalog(spark, d).where("doc_id % 3 <> 0").select("doc_id", "titulo", "ano", "status_download")
    e = F.col("event_id")
    new = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("title "), e.cast("string")).alias("titulo"), (e % 20).cast("int").alias("ano"), "event_id")
    return cat.upsert(old, new, "event_id").select("doc_id", "titulo", "ano", "status_download")


@query(f"""WITH {views.CATALOG}, dl AS (
  SELECT user_id AS doc_id, arg_max(CASE WHEN value > 50 THEN 'ok' ELSE 'error' END, event_id) AS status FROM events GROUP BY 1
) SELECT c.doc_id, coalesce(d.status, c.status_embed) AS status_embed FROM cat c LEFT JOIN dl d ON c.doc_id = d.doc_id""")
def mark_status(spark, d):
    deltas = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("value") > 50, "ok").otherwise("error").alias("status"), "event_id")
    return cat.mark_status(views.catalog(spark, d), deltas, "embed", sequence="event_id").select("doc_id", "status_embed")


@query(f"WITH {views.CATALOG} SELECT doc_id, ano FROM cat WHERE ano = 2015 AND situacao_doc = 'en'")
def payload_filter_eq(spark, d):
    return views.catalog(spark, d).where(cat.payload_filter({"ano": 2015, "situacao_doc": "en", "autor": None})).select("doc_id", "ano")


@query(f"WITH {views.CATALOG} SELECT doc_id, situacao_doc FROM cat WHERE situacao_doc IN ('de', 'fr') AND ano IN (2011, 2012)")
def payload_filter_in(spark, d):
    return views.catalog(spark, d).where(cat.payload_filter({"situacao_doc": ["de", "fr"], "ano": (2011, 2012)})).select("doc_id", "situacao_doc")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1")
def payload_filter_bool(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("has_revoked", F.col("toxic") == 1)
    return rows.where(cat.payload_filter({"has_revoked": True})).select("doc_id")


@query(f"""WITH {views.CATALOG}, m AS (
  SELECT doc_id, ano, situacao_doc FROM cat WHERE ano IN (2012, 2013, 2014) AND status_embed = 'ok' AND (titulo ILIKE '%the%' OR autor ILIKE '%the%' OR ementa ILIKE '%the%' OR assunto ILIKE '%the%') ORDER BY ano DESC NULLS LAST, doc_id LIMIT 501
), n AS (SELECT *, count(*) OVER () > 500 AS truncated, row_number() OVER (ORDER BY ano DESC NULLS LAST, doc_id) AS n FROM m) SELECT doc_id, ano, situacao_doc, truncated FROM n WHERE n <= 500""")
def browser_search(spark, d):
    return browsed(views.catalog(spark, d))


def browsed(rows, index=None):
    return cat.browse(rows, years=[2012, 2013, 2014], statuses={"embed": "ok"}, search=" the ", index=index).select("doc_id", "ano", "situacao_doc", "truncated")


@query(f"WITH {views.CATALOG} SELECT DISTINCT 'ano' AS facet, CAST(ano AS VARCHAR) AS value FROM cat UNION ALL SELECT DISTINCT 'situacao_doc', situacao_doc FROM cat")
def facets(spark, d):
    return cat.facets(views.catalog(spark, d))


@query(f"WITH {views.CATALOG} SELECT tipo_pdf, count(*) AS n FROM cat WHERE tipo_pdf IS NOT NULL GROUP BY 1 ORDER BY n DESC, tipo_pdf LIMIT 30")
def top_tipos(spark, d):
    return cat.top_values(views.catalog(spark, d), "tipo_pdf")


VISION = "CASE WHEN (classification IN ('scanned', 'complex') AND text_clean = '') OR (classification = 'complex' AND NOT has_one) THEN true ELSE false END"
PAGES = views.PAGES + r", pv AS (SELECT *, regexp_replace(text_markdown, '^\s+|\s+$', '', 'g') AS text_clean FROM pg), pn AS (SELECT *, " + VISION + " AS needs_vision FROM pv)"


@query(f"WITH {PAGES} SELECT page_index, classification, needs_vision FROM pn")
def page_router(spark, d):
    return views.pages(spark, d).select("page_index", "classification", "needs_vision")


@query(f"""WITH {PAGES} SELECT doc_id, count(*) AS total_pages, count(*) FILTER (classification = 'scanned') AS scanned_pages, count(*) FILTER (classification = 'complex') AS complex_pages,
  count(*) FILTER (has_revoked) AS revoked_pages, count(*) FILTER (needs_vision) AS vision_pages, CAST(sum(char_count) AS BIGINT) AS total_chars,
  CASE WHEN count(*) FILTER (needs_vision) = 0 THEN 'digital' WHEN count(*) FILTER (needs_vision) < count(*) THEN 'mixed' ELSE 'vision_heavy' END AS mix FROM pn GROUP BY doc_id""")
def page_summary(spark, d):
    return pg.summary(views.pages(spark, d))


@query(f"""WITH {PAGES} SELECT doc_id, count(*) FILTER (classification = 'digital') AS digital, count(*) FILTER (classification = 'scanned') AS scanned, count(*) FILTER (classification = 'complex') AS complex FROM pn GROUP BY doc_id""")
def class_histogram(spark, d):
    return pg.histogram(views.pages(spark, d))


def vision_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select(
        F.col("source").alias("doc_id"), i.alias("page_index"), F.when(i % 27 == 0, " ").otherwise(F.concat(F.lit(" seen "), i.cast("string"))).alias("markdown"), F.when(i % 2 == 0, "ok").otherwise("error").alias("status")
    )


VISION_SQL = "vs AS (SELECT source AS doc_id, doc_id AS page_index, CASE WHEN doc_id % 27 = 0 THEN ' ' ELSE ' seen ' || doc_id END AS markdown, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'error' END AS status FROM documents WHERE doc_id % 9 = 0)"


@query(f"""WITH {PAGES}, {VISION_SQL} SELECT p.page_index, md5(CASE WHEN v.status = 'ok' AND trim(v.markdown) <> '' THEN trim(v.markdown)
  WHEN p.has_one THEN p.text_clean || CASE WHEN p.text_clean <> '' THEN chr(10) || chr(10) ELSE '' END || '| t' || p.page_index || ' |' ELSE p.text_clean END) AS text_md5
FROM pn p LEFT JOIN vs v ON p.doc_id = v.doc_id AND p.page_index = v.page_index""")
def page_overlay(spark, d):
    return pg.overlaid(views.pages(spark, d), vision_results(spark, d)).select("page_index", F.md5("page_text").alias("text_md5"))


@query(f"WITH {PAGES}, {VISION_SQL} SELECT doc_id, page_index FROM pn p WHERE needs_vision AND NOT EXISTS (SELECT 1 FROM vs v WHERE v.status = 'ok' AND v.doc_id = p.doc_id AND v.page_index = p.page_index)")
def vision_todo(spark, d):
    return pg.vision_todo(views.pages(spark, d), vision_results(spark, d)).select("doc_id", "page_index")


@query(r"""WITH t AS (
  SELECT l_orderkey, l_linenumber, [[l_returnflag, NULL, 'h|x'], [l_linestatus || chr(10) || 'y', CAST(l_linenumber AS VARCHAR)], ['z']] AS r FROM lineitem
) SELECT l_orderkey, l_linenumber, '| ' || r[1][1] || ' |  | h\|x |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || replace(r[2][1], chr(10), ' ') || ' | ' || r[2][2] || ' |  |' || chr(10) || '| z |  |  |' AS markdown FROM t""")
def table_markdown(spark, d):
    n = F.col("l_linenumber").cast("string")
    rows = F.array(F.array(F.col("l_returnflag"), F.lit(None).cast("string"), F.lit("h|x")), F.array(F.concat("l_linestatus", F.lit("\ny")), n), F.array(F.lit("z")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pg.table_markdown(rows).alias("markdown"))


#: Words of the customers' names as spans, with strokes at heights and widths that vary.
SPANS_SQL = """sp AS (
  SELECT CAST(c_custkey % 50 AS VARCHAR) AS doc_id, CAST(c_custkey % 7 AS INTEGER) AS page_index, CAST(c_custkey AS INTEGER) AS line_no, s AS span_no, 'w' || c_custkey || '_' || s || ' ' AS text,
    40.0 * s AS x0, 10.0 * (c_custkey // 350) AS y0, 40.0 * s + 30.0 AS x1, 10.0 * (c_custkey // 350) + 8.0 AS y1 FROM customer, (SELECT unnest(range(4)) AS s)
), mk AS (
  SELECT CAST(s_suppkey % 50 AS VARCHAR) AS doc_id, CAST(s_suppkey % 7 AS INTEGER) AS page_index, CASE WHEN s_suppkey % 3 = 0 THEN 'annotation' ELSE 'line' END AS kind,
    CAST(s_suppkey % 90 AS DOUBLE) AS x0, 10.0 * (s_suppkey % 5) + (s_suppkey % 9) AS y0, CAST(s_suppkey % 90 + 60 AS DOUBLE) AS x1, 10.0 * (s_suppkey % 5) + (s_suppkey % 9) + 1.0 AS y1 FROM supplier
), st AS (
  SELECT s.doc_id, s.page_index, s.line_no, s.span_no, s.text, coalesce(bool_or(CASE
    WHEN m.kind = 'line' THEN (m.y0 + m.y1) / 2 BETWEEN (s.y0 + s.y1) / 2 - (s.y1 - s.y0) * 0.45 AND (s.y0 + s.y1) / 2 + (s.y1 - s.y0) * 0.45 AND greatest(0.0, least(s.x1, m.x1) - greatest(s.x0, m.x0)) / (s.x1 - s.x0) >= 0.55
    WHEN m.kind = 'annotation' THEN m.x1 >= s.x0 AND m.x0 <= s.x1 AND m.y1 >= s.y0 AND m.y0 <= s.y1 AND greatest(0.0, least(s.x1, m.x1) - greatest(s.x0, m.x0)) / greatest(1e-6, s.x1 - s.x0) >= 0.55 END), false) AS revoked
  FROM sp s LEFT JOIN mk m ON s.doc_id = m.doc_id AND s.page_index = m.page_index GROUP BY ALL
)"""


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("c_custkey"), F.col("s").cast("double")
    y = 10.0 * F.floor(k / 350).cast("double")
    text = table(spark, sf_dir, "customer").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        (k % 50).cast("string").alias("doc_id"), (k % 7).cast("int").alias("page_index"), k.cast("int").alias("line_no"), F.col("s").alias("span_no"), F.concat(F.lit("w"), k.cast("string"), F.lit("_"), F.col("s").cast("string"), F.lit(" ")).alias("text"),
        (40.0 * s).alias("x0"), y.alias("y0"), (40.0 * s + 30.0).alias("x1"), (y + 8.0).alias("y1"),
    )
    p = F.col("s_suppkey")
    x, top = (p % 90).cast("double"), (10.0 * (p % 5).cast("double") + (p % 9).cast("double"))
    marks = table(spark, sf_dir, "supplier").select(
        (p % 50).cast("string").alias("doc_id"), (p % 7).cast("int").alias("page_index"), F.when(p % 3 == 0, "annotation").otherwise("line").alias("kind"), x.alias("x0"), top.alias("y0"), (x + 60.0).alias("x1"), (top + 1.0).alias("y1")
    )
    return text, marks


@query(f"WITH {SPANS_SQL} SELECT line_no, span_no, revoked FROM st")
def strike_spans(spark, d):
    return pg.struck(*spans(spark, d)).select("line_no", F.col("span_no").cast("long").alias("span_no"), "revoked")


@query(f"""WITH {SPANS_SQL}, f AS (SELECT *, CASE WHEN revoked = lag(revoked) OVER (PARTITION BY doc_id, page_index, line_no ORDER BY span_no) THEN 0 ELSE 1 END AS new FROM st),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index, line_no ORDER BY span_no) AS run FROM f),
h AS (SELECT doc_id, page_index, line_no, run, bool_and(revoked) AS revoked, string_agg(text, '' ORDER BY span_no) AS text FROM g GROUP BY ALL),
i AS (SELECT doc_id, page_index, line_no, string_agg(CASE WHEN revoked AND length(trim(text)) >= 3 THEN '~~' || text || '~~' ELSE text END, '' ORDER BY run) AS markdown FROM h GROUP BY ALL)
SELECT line_no, rtrim(markdown) AS markdown FROM i WHERE rtrim(markdown) <> ''""")
def spans_markdown(spark, d):
    return pg.spans_markdown(pg.struck(*spans(spark, d))).select("line_no", "markdown")


@query(f"WITH {SPANS_SQL} SELECT doc_id, page_index, bool_or(revoked) AS has_revoked FROM st GROUP BY ALL")
def page_revoked(spark, d):
    return pg.page_revoked(pg.struck(*spans(spark, d)))


@query(rf"""WITH {views.LINES}, k AS (
  SELECT *, line = '' AS blank, regexp_matches(line, '(?i)^\s*Art\.\s*\d+[ºo]?(\s|$)') AS art, regexp_matches(line, '(?i)^\s*CAP[IÍ]TULO\s+[IVXLCDM]+') AS head FROM ln
), b AS (
  SELECT *, NOT blank AND (art OR head OR sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER w = 1) AS start FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER w AS block_no, last_value(CASE WHEN art THEN regexp_replace(line, '^\s+', '') END IGNORE NULLS) OVER w AS ref FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), e AS (
  SELECT doc_id, block_no, md5(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g')) AS text_md5, min(page_index) AS page_start,
    coalesce(max(page_index) FILTER (NOT blank AND NOT art AND NOT head), min(page_index)) AS page_end, first(ref ORDER BY line_no) AS article_ref FROM c WHERE block_no > 0 GROUP BY ALL
) SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, text_md5, page_start, page_end, article_ref FROM e WHERE text_md5 <> md5('')""")
def structural_blocks(spark, d):
    return ch.structural_blocks(views.lines(spark, d)).select("doc_id", "block_no", F.md5("text").alias("text_md5"), "page_start", "page_end", "article_ref")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, unnest(range(1, len(string_split_regex(text, '\n\s*\n')) + 1)) AS n FROM t WHERE length(text) // 4 > 900),
st AS (SELECT doc_id, n, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM raw),
ps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY n) AS cum FROM st WHERE p <> ''),
c0 AS (SELECT doc_id, i, cum FROM ps UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM ps),
w(doc_id, k, a, b) AS (
  SELECT doc_id, 1, CAST(1 AS BIGINT), (SELECT greatest(1, max(c.i)) FROM c0 c WHERE c.doc_id = d.doc_id AND c.cum <= 3600) FROM (SELECT DISTINCT doc_id FROM ps) d
  UNION ALL
  SELECT doc_id, k + 1, s, (SELECT greatest(v.b + 1, max(c.i)) FROM c0 c, c0 f WHERE c.doc_id = v.doc_id AND f.doc_id = v.doc_id AND f.i = v.s - 1 AND c.cum - f.cum <= 3600)
  FROM (SELECT w.*, coalesce((SELECT min(f.i) + 1 FROM c0 f, c0 e WHERE f.doc_id = w.doc_id AND e.doc_id = w.doc_id AND e.i = w.b AND f.i >= w.a - 1 AND f.i < w.b AND e.cum - f.cum <= 400), w.b + 1) AS s FROM w WHERE w.b < (SELECT max(i) FROM c0 m WHERE m.doc_id = w.doc_id)) v
)
SELECT w.doc_id, CAST(w.k - 1 AS INTEGER) AS piece_no, md5(string_agg(p.p, chr(10) || chr(10) ORDER BY p.i)) AS piece_md5 FROM w JOIN ps p ON p.doc_id = w.doc_id AND p.i BETWEEN w.a AND w.b GROUP BY w.doc_id, w.k
UNION ALL SELECT doc_id, 0, md5(text) FROM t WHERE length(text) // 4 <= 900""")
def sliding_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return rows.select("doc_id", F.posexplode(ch.window_pieces(F.col("text"))).alias("piece_no", "p")).select("doc_id", "piece_no", F.md5("p").alias("piece_md5"))


@query(rf"""WITH {views.PIECES}, s AS (
  SELECT *, regexp_matches(piece, '\n\s*\|[^\n]+\|\s*\n\s*\|\s*-{{2,}}') AS tab, row_number() OVER (PARTITION BY doc_id ORDER BY piece_no) AS rn FROM pc
), c AS (SELECT *, sum(CASE WHEN rn = 1 OR tab OR greatest(1, length(piece) // 4) >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY piece_no) - 1 AS ci FROM s),
g AS (SELECT doc_id, CAST(ci AS BIGINT) AS chunk_index, md5(string_agg(regexp_replace(piece, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY piece_no)) AS text_md5, first(piece ORDER BY piece_no) AS raw, first(article_ref ORDER BY piece_no) AS article_ref,
  first(tab ORDER BY piece_no) AS has_table, bool_or(contains(piece, '~~gone~~')) AS has_revoked, first(page_start ORDER BY piece_no) AS page_start, last(page_end ORDER BY piece_no) AS page_end FROM c GROUP BY ALL)
SELECT doc_id, chunk_index, text_md5, doc_id || '::' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0') || '::' || substr(sha1(doc_id || '|' || chunk_index || '|' || substr(raw, 1, 200)), 1, 16) AS chunk_id,
  article_ref, has_table, has_revoked, page_start, page_end FROM g""")
def merged_chunks(spark, d):
    return ch.merged(views.pieces(spark, d)).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "chunk_id", "article_ref", "has_table", "has_revoked", "page_start", "page_end")


@query("""SELECT doc_id, doc_id || '::' || lpad(CAST(doc_id * 7 AS VARCHAR), CAST(greatest(4, length(CAST(doc_id * 7 AS VARCHAR))) AS INTEGER), '0') || '::' || substr(sha1(doc_id || '|' || (doc_id * 7) || '|' || substr(text, 1, 200)), 1, 16) AS chunk_id FROM documents""")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") * 7, F.col("text")).alias("chunk_id"))


FLAG_TEXT = r"text || CASE WHEN doc_id % 4 = 1 THEN chr(10) || '| a |' || chr(10) || '|---|' ELSE '' END || CASE WHEN doc_id % 6 = 2 THEN ' ~~old text~~ ~~ ~~' ELSE '' END || repeat(chr(10), CAST(doc_id % 5 AS INTEGER)) || '|  |' || chr(10) || 'end '"


def _flag_text():
    i = F.col("doc_id")
    return F.concat("text", F.when(i % 4 == 1, "\n| a |\n|---|").otherwise(""), F.when(i % 6 == 2, " ~~old text~~ ~~ ~~").otherwise(""), F.repeat(F.lit("\n"), (i % 5).cast("int")), F.lit("|  |\nend "))


@query(rf"SELECT doc_id, regexp_matches({FLAG_TEXT}, '\n\s*\|[^\n]+\|\s*\n\s*\|\s*-{{2,}}') AS has_table, regexp_matches({FLAG_TEXT}, '~~[^~]+~~') AS has_revoked FROM documents")
def chunk_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", ch.has_table(_flag_text()).alias("has_table"), ch.has_revoked(_flag_text()).alias("has_revoked"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({FLAG_TEXT}, '(?m)^\s*\|[\s|]*$', '', 'g'), '~~\s*~~', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(ch.clean_text(_flag_text())).alias("text_md5"))


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS snippet FROM f""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", snippet(F.col("text"), 120).alias("snippet"))
