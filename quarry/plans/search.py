"""Queries over vectors, retrieval, evaluation and call rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as ev
from quarry.operators import clusters, rates, sparse_index, vectors
from quarry.operators.catalog import payload_filter
from quarry.operators import retrieval as rt
from quarry.plans import views
from quarry.plans.documents import ORACLES, QUERIES, query
from quarry.session import cut, shared_dir, table

__all__ = ["ORACLES", "QUERIES"]


@query(f"WITH {views.DENSE} SELECT * FROM dn WHERE rank <= 10 AND query_id % 100 = 0")
def dense_topk(spark, d):
    v, q = views.dense_inputs(spark, d)
    return vectors.dense_top_k(v, q.where("query_id % 100 = 0"), k=10)


@query(f"""WITH {views.DENSE}, f AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM cs WHERE label = 3)
SELECT * FROM f WHERE rank <= 40""")
def dense_topk_filtered(spark, d):
    v, q = views.dense_inputs(spark, d)
    return vectors.dense_top_k(v.where("label = 3"), q)


@query(f"WITH {views.DENSE} SELECT * FROM dn WHERE rank <= 40")
def dense_topk_batch(spark, d):
    return vectors.dense_top_k(*views.dense_inputs(spark, d))


@query(f"WITH {views.SPARSE} SELECT doc_id AS chunk_id, term, weight FROM po")
def postings(spark, d):
    return vectors.postings(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")


@query(f"WITH {views.SPARSE} SELECT * FROM sp WHERE rank <= 40")
def sparse_topk(spark, d):
    return vectors.sparse_top_k(*views.sparse_inputs(spark, d))


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{spark.sql('SELECT uuid()').first()[0]}"


@query(f"WITH {views.SPARSE} SELECT * FROM sp WHERE rank <= 40")
def sparse_indexed(spark, d):
    """The rows of sparse_topk from stored postings, of which only blocks that can hold one of the best are unpacked."""
    path = _path(spark, "postings")
    words = vectors.postings(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    sparse_index.write(sparse_index.blocks(words), path)
    return sparse_index.top_k(sparse_index.read(spark, path), views.sparse_inputs(spark, d)[1])


@query(f"WITH {views.DENSE} SELECT * FROM dn WHERE rank <= 40")
def dense_clustered(spark, d):
    """The rows of dense_topk_batch from vectors stored by cluster."""
    v, q = views.dense_inputs(spark, d)
    return clusters.top_k(clusters.laid_out(v.select("chunk_id", "embedding"), _path(spark, "vectors")), q)


@query(f"WITH {views.QUESTIONS} SELECT query_id, doc_id FROM idd")
def identifier_lookup(spark, d):
    return rt.identifier_documents(views.questions(spark, d), views.files(spark, d))


@query(f"WITH {views.QUESTIONS}, n AS (SELECT query_id, count(*) AS docs FROM idd GROUP BY 1) SELECT i.query_id, i.doc_id FROM idd i JOIN n ON i.query_id = n.query_id WHERE n.docs BETWEEN 1 AND 3")
def identifier_hard_filter(spark, d):
    hits = rt.identifier_documents(views.questions(spark, d), views.files(spark, d))
    few = hits.groupBy("query_id").count().where("count BETWEEN 1 AND 3").select("query_id")
    return hits.join(few, "query_id", "left_semi")


#: Rankings of the same questions: dense for the vector of each item's id, sparse for its text, dense again within identified documents.
RANKINGS = f"""{views.QUESTIONS}, {views.SPARSE}, dc AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings v
), dr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dc), ir AS (
  SELECT c.query_id, c.chunk_id, row_number() OVER (PARTITION BY c.query_id ORDER BY c.score DESC, c.chunk_id) AS rank FROM dc c JOIN idd i ON c.query_id = i.query_id AND c.chunk_id = i.doc_id
), rk AS (
  SELECT query_id, chunk_id, 0 AS src, rank FROM dr WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 1, rank FROM sp WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 2, rank FROM ir WHERE rank <= 40
), fu AS (
  SELECT query_id, chunk_id, coalesce(max(CASE WHEN src = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN src = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN src = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS rrf,
    min(src * 1000000 + rank) AS first_seen, min(CASE WHEN src = 2 THEN rank END) AS ident_rank FROM rk GROUP BY ALL
), ndoc AS (SELECT query_id, count(*) AS docs FROM idd GROUP BY 1), fr AS (
  SELECT f.*, n.docs, row_number() OVER (PARTITION BY f.query_id ORDER BY rrf DESC, first_seen) AS fr, bool_or(ident_rank IS NOT NULL) OVER (PARTITION BY f.query_id) AS has_any FROM fu f LEFT JOIN ndoc n ON f.query_id = n.query_id
), ca AS (
  SELECT query_id, chunk_id, rrf, CASE WHEN coalesce(docs BETWEEN 1 AND 3, false) AND has_any THEN ident_rank WHEN fr <= 20 THEN fr WHEN ident_rank <= 10 THEN 100 + ident_rank END AS position, ident_rank IS NOT NULL AS is_ident FROM fr
)"""


def rankings(spark, d, filters=None, indexed=False):
    """(dense, sparse, identified, identifier documents, questions), each within the payload's ``filters``; ``indexed``: from stored indexes."""
    qs = views.questions(spark, d)
    v, index, names = views.dense_inputs(spark, d)[0], views.sparse_inputs(spark, d)[0], views.files(spark, d)
    asked = v
    if filters:
        kept = payload(spark, d).where(payload_filter(filters)).select("chunk_id")
        v, index = (x.join(kept, "chunk_id", "left_semi") for x in (v, index))
        names = names.join(kept.withColumnRenamed("chunk_id", "doc_id"), "doc_id", "left_semi")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    q = asked.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding")).join(items, "query_id")
    terms = views.sparse_inputs(spark, d)[1]
    if indexed:
        path = _path(spark, "indexes")
        sparse_index.write(sparse_index.blocks(vectors.postings(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")), f"{path}/postings")
        dense = cut(clusters.top_k(clusters.laid_out(v.select("chunk_id", "embedding"), f"{path}/vectors"), q))
        sparse = cut(sparse_index.top_k(sparse_index.read(spark, f"{path}/postings"), terms))
    else:
        dense, sparse = vectors.dense_top_k(v, q), vectors.sparse_top_k(index, terms)
    docs = rt.identifier_documents(qs, names)
    # Within identified documents: each query has its own few vectors.
    own = docs.select("query_id", F.col("doc_id").alias("chunk_id")).join(v, "chunk_id").join(q, "query_id")
    score = F.round(vectors.dot(F.col("embedding"), F.col("query_embedding")) / (vectors.norm(F.col("embedding")) * vectors.norm(F.col("query_embedding"))), 6)
    identified = vectors.ranked(own.select("query_id", "chunk_id", score.alias("score")), "query_id", "score", "chunk_id", 40)
    return dense, sparse, identified, docs, qs


def fused(spark, d):
    dense, sparse, identified, docs, _ = rankings(spark, d)
    tag = lambda df, s: df.select("query_id", "chunk_id", F.lit(s).alias("source"), "rank")
    return rt.fuse(tag(dense, "dense").unionByName(tag(sparse, "sparse")).unionByName(tag(identified, "identifier"))), docs


@query(f"WITH {RANKINGS} SELECT query_id, chunk_id, round(rrf, 9) AS rrf, CAST(first_seen AS BIGINT) AS first_seen FROM fu")
def rrf_fuse(spark, d):
    return fused(spark, d)[0].select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.col("first_seen").cast("long").alias("first_seen"))


@query(f"WITH {RANKINGS} SELECT query_id, chunk_id, CAST(position AS BIGINT) AS position, is_ident FROM ca WHERE position IS NOT NULL")
def candidate_union(spark, d):
    return rt.candidates(*fused(spark, d)).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), "is_ident")


HYBRID = RANKINGS + r""", qw AS (
  SELECT query_id, list_distinct(list_filter(string_split_regex(lower(question), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS terms FROM qs
), pay AS (
  SELECT doc_id AS chunk_id, source AS arquivo, text, CAST(doc_id % 3 AS INTEGER) AS page_start, lang AS situacao_doc FROM documents
), rr AS (
  SELECT c.query_id, c.chunk_id, c.position, p.page_start, p.situacao_doc, round(len(list_intersect(q.terms, string_split_regex(lower('[arquivo: ' || p.arquivo || ']' || chr(10) || p.text), '[^\p{L}\p{N}]+'))) / CAST(len(q.terms) AS DOUBLE)
    * (CASE WHEN p.page_start = 0 THEN 0.85 ELSE 1.0 END::DOUBLE * CASE WHEN c.is_ident THEN 1.5 ELSE 1.0 END::DOUBLE), 9) AS score
  FROM ca c JOIN pay p ON c.chunk_id = p.chunk_id JOIN qw q ON c.query_id = q.query_id WHERE c.position IS NOT NULL
), fin AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS INTEGER) AS final_rank FROM rr)"""


def payload(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("arquivo"), "text", (F.col("doc_id") % 3).cast("int").alias("page_start"), (F.col("doc_id") % 3 + 1).cast("int").alias("page_end"),
        F.col("lang").alias("situacao_doc"), F.lit(None).cast("string").alias("article_ref"), F.col("source").alias("url"), F.substring("text", 1, 20).alias("titulo"), (F.lit(2010) + F.col("doc_id") % 16).alias("ano"), F.col("source").alias("autor"), (F.col("doc_id") % 11 == 0).alias("has_revoked"),
    )


def found(spark, d, filters=None, indexed=False):
    dense, sparse, identified, docs, qs = rankings(spark, d, filters, indexed)
    return rt.hybrid(dense, sparse, identified, docs, payload(spark, d), qs)


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, score, final_rank FROM fin WHERE final_rank <= 6")
def hybrid_search(spark, d):
    return found(spark, d).select("query_id", "chunk_id", "score", "final_rank")


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, score, final_rank FROM fin WHERE final_rank <= 6")
def hybrid_indexed(spark, d):
    """The rows of hybrid_search from stored postings and vectors by cluster."""
    return found(spark, d, indexed=True).select("query_id", "chunk_id", "score", "final_rank")


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, score, page_start FROM fin WHERE final_rank <= 20")
def rerank_boost(spark, d):
    dense, sparse, identified, docs, qs = rankings(spark, d)
    return rt.hybrid(dense, sparse, identified, docs, payload(spark, d), qs, top_k=20).select("query_id", "chunk_id", "score", "page_start")


@query(f"WITH {HYBRID} SELECT query_id, final_rank, CAST(chunk_id AS VARCHAR) AS doc_id, page_start, situacao_doc, score FROM fin WHERE final_rank <= 6")
def citations(spark, d):
    rows = rt.citations(found(spark, d)).select("query_id", F.explode("citations").alias("c"))
    return rows.select("query_id", "c.final_rank", "c.doc_id", "c.page_start", "c.situacao_doc", "c.score")


#: The six best of each dense query, with whole texts.
CONTEXT = f"""{views.DENSE}, cx AS (
  SELECT r.query_id, r.rank AS r, d.doc_id, d.source, d.lang, d.text FROM dn r JOIN documents d ON r.chunk_id = d.doc_id WHERE r.rank <= 6
)""" + r""", cp AS (
  SELECT query_id, r, doc_id, '[' || r || '] doc_id=' || doc_id || ' | titulo=' || source || ' | ano=None | autor=' || lang || ' | situacao_doc=None | art=Art. ' || r || ' | has_revoked=' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || ' | pg 0-' || r
  || chr(10) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*\|[\s|]*$', '', 'g'), '~~\s*~~', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS part FROM cx
), ct AS (SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context, count(*) AS n FROM cp GROUP BY 1)"""


def context_hits(spark, d):
    i, r, none = F.col("doc_id"), F.col("final_rank"), F.lit(None).cast("string")
    v, q = views.dense_inputs(spark, d)
    best = vectors.dense_top_k(v, q, k=6).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").alias("final_rank"), "score")
    return best.join(table(spark, d, "documents"), "doc_id").select(
        "query_id", "final_rank", i.cast("string").alias("doc_id"), F.col("source").alias("titulo"), none.alias("ano"), F.col("lang").alias("autor"), none.alias("situacao_doc"), F.concat(F.lit("Art. "), r.cast("string")).alias("article_ref"),
        (i % 2 == 0).alias("has_revoked"), F.lit(0).alias("page_start"), r.alias("page_end"), "text", none.alias("url"), "score",
    )


@query(f"WITH {CONTEXT} SELECT query_id, md5(context) AS context_md5 FROM ct")
def context_render(spark, d):
    return rt.context(context_hits(spark, d)).select("query_id", F.md5("context").alias("context_md5"))


#: Cases: the dense queries, which expect documents of good quality among ids near their own.
CASES = f"""{views.DENSE}, ex AS (
  SELECT q.query_id AS case_id, l.doc_id FROM (SELECT DISTINCT query_id FROM qv) q JOIN labels l ON l.quality = 1 AND l.doc_id % 50 = (q.query_id // 50) % 50
), hk AS (
  SELECT q.query_id AS case_id, coalesce(bool_or(r.rank <= 1), false) AS hit_at_1, coalesce(bool_or(r.rank <= 3), false) AS hit_at_3, coalesce(bool_or(r.rank <= 5), false) AS hit_at_5, coalesce(bool_or(r.rank <= 10), false) AS hit_at_10
  FROM (SELECT DISTINCT query_id FROM qv) q LEFT JOIN ex e ON q.query_id = e.case_id LEFT JOIN dn r ON r.query_id = q.query_id AND r.chunk_id = e.doc_id GROUP BY 1
)"""


def hit_rows(spark, d):
    v, q = views.dense_inputs(spark, d)
    near = lambda c: F.floor(F.col(c) / 50) % 50
    got = vectors.dense_top_k(v, q).select(F.col("query_id").alias("case_id"), "rank", F.col("chunk_id").alias("doc_id"))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("expected")).distinct()
    found = got.where(F.col("doc_id") % 50 == near("case_id")).join(good, "doc_id")
    return ev.hits_among(q.select(F.col("query_id").alias("case_id")).distinct(), found)


@query(f"WITH {CASES} SELECT * FROM hk")
def hit_at_k(spark, d):
    return hit_rows(spark, d)


REPLIES = """rp AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no verdict ' || event_id WHEN event_id % 5 = 1 THEN 'x {"score": "' || (event_id % 6) || '", "rationale": "r' || event_id || '"} y' WHEN event_id % 5 = 2 THEN '{"score": ' || (event_id % 6) || '.5}'
    WHEN event_id % 5 = 3 THEN '{"rationale": "none"}' ELSE '{"score": oops' || chr(125) END AS reply FROM events
)"""


def replies(spark, d):
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    six = (i % 6).cast("string")
    text = F.when(i % 5 == 0, F.concat(F.lit("no verdict "), s)).when(i % 5 == 1, F.concat(F.lit('x {"score": "'), six, F.lit('", "rationale": "r'), s, F.lit('"} y'))).when(i % 5 == 2, F.concat(F.lit('{"score": '), six, F.lit(".5}"))).when(i % 5 == 3, '{"rationale": "none"}').otherwise('{"score": oops}')
    return table(spark, d, "events").select("event_id", text.alias("reply"))


JUDGED = REPLIES + """, jd AS (
  SELECT event_id, CASE event_id % 5 WHEN 1 THEN CAST(event_id % 6 AS DOUBLE) WHEN 2 THEN event_id % 6 + 0.5::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS score,
    CASE event_id % 5 WHEN 0 THEN reply WHEN 1 THEN 'r' || event_id WHEN 2 THEN '' WHEN 3 THEN 'none' END AS rationale FROM rp
)"""


@query(f"WITH {JUDGED} SELECT * FROM jd")
def judge_parse(spark, d):
    score, rationale = ev.judge_reply(F.col("reply"))
    return replies(spark, d).select("event_id", score.alias("score"), rationale.alias("rationale"))


@query(f"""WITH {CASES}, {JUDGED} SELECT (SELECT count(*) FROM hk) AS n_cases, (SELECT avg(CAST(hit_at_1 AS INTEGER)) FROM hk) AS hit_at_1, (SELECT avg(CAST(hit_at_3 AS INTEGER)) FROM hk) AS hit_at_3,
  (SELECT avg(CAST(hit_at_5 AS INTEGER)) FROM hk) AS hit_at_5, (SELECT avg(CAST(hit_at_10 AS INTEGER)) FROM hk) AS hit_at_10, round(avg(score), 9) AS judge_mean, count(score) AS judge_n FROM jd""")
def eval_summary(spark, d):
    score, _ = ev.judge_reply(F.col("reply"))
    return ev.summary(hit_rows(spark, d), replies(spark, d).select(score.alias("score"))).withColumn("judge_mean", F.round("judge_mean", 9))


@query("""SELECT event_type AS category, min(event_id) AS first_seq, count(*) FILTER (value > 50) AS n_pass, count(*) AS n, round(coalesce(avg(CASE WHEN CASE WHEN event_id % 17 = 0 THEN -1.0 ELSE value END > 0 THEN value END), 0), 6) AS avg_elapsed FROM events GROUP BY 1""")
def bench_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("passed"), F.when(F.col("event_id") % 17 == 0, -1.0).otherwise(F.col("value")).alias("elapsed"))
    return ev.benchmark_summary(e).withColumn("avg_elapsed", F.round("avg_elapsed", 6))


@query(r"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Não consta ' || text ELSE text END AS answer FROM documents) SELECT doc_id, (lower(answer) LIKE 'não consta%' OR lower(answer) LIKE 'nao consta%') AND length(answer) <= 300 AS rejected FROM a""")
def refusals(spark, d):
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Não consta "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", ev.rejected(answer).alias("rejected"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS calls_60s,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS calls_86400s FROM events""")
def rate_window(spark, d):
    return rates.trailing_counts(table(spark, d, "events")).select("event_id", "calls_60s", "calls_86400s")


@query("""WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS k FROM events
), fold(user_id, k, event_id, admitted, log) AS (
  SELECT user_id, k, event_id, true, [us] FROM ev WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, pass, CASE WHEN pass THEN list_append(kept, us) ELSE kept END FROM (
    SELECT *, len(kept) < 3 AND len(list_filter(kept, lambda t: us - t < 60000000)) < 1 AS pass FROM (
      SELECT e.user_id, e.k, e.event_id, e.us, list_filter(f.log, lambda t: e.us - t < 86400000000) AS kept FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.k = f.k + 1
    )
  )
) SELECT event_id, user_id, admitted FROM fold""")
def rate_admission(spark, d):
    from quarry.config import Config

    return rates.admitted(table(spark, d, "events").select("event_id", "user_id", "ts"), config=Config(calls_per_minute=1, calls_per_day=3)).select("event_id", "user_id", "admitted")
