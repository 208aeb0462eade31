"""The document catalog: metadata, keyed upserts, stage states, browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.ids import document_id
from quarry.functions.text import blank_to_null, clean_value, strip
from quarry.operators import trigrams

#: Fixed format of the metadata files.
METADATA = (
    "map<string,struct<registros:array<struct<titulo:string,autor:string,situacao:string,assunto:string,"
    "ementa:string,assinatura:string,publicacao:string,pdfs:array<struct<tipo:string,url:string,arquivo:string>>>>>>"
)
#: Fixed labels that values of these fields can carry.
LABELS = {"situacao": "Situação:", "assunto": "Assunto:", "assinatura": "Assinatura:", "publicacao": "Publicação:"}
STAGES = ("download", "parse", "chunk", "embed")
META_COLUMNS = ("url", "arquivo", "ano", "tipo_pdf", "titulo", "autor", "situacao_doc", "assunto", "ementa", "assinatura", "publicacao", "data_bucket", "metadata_json")


def is_pdf_url(url: Column) -> Column:
    return F.lower(F.split_part(url, F.lit("?"), F.lit(1))).endswith(".pdf")


def trimmed_kind(kind: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(kind, F.lit(""))), ":+$", ""))


def flatten_metadata(files: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per PDF of ``files`` (value: a JSON document, file_name).

    The year is that of the file name; entries without a URL, or whose URL isn't
    a PDF's, are left out. Malformed files give no rows. ``ordered`` adds
    file_name and position (bucket, record and PDF within the file).
    """
    year = F.regexp_extract("file_name", r"(\d{4})_metadados\.json$", 1)
    root = F.from_json("value", METADATA)
    entries = files.select("file_name", blank_to_null(year).cast("int").alias("ano"), F.posexplode(F.map_entries(root)).alias("_bucket", "e"))
    records = entries.select("file_name", "ano", "_bucket", F.col("e.key").alias("data_bucket"), F.posexplode("e.value.registros").alias("_record", "r"))
    pdfs = records.select("file_name", "ano", "_bucket", "_record", "data_bucket", "r", F.posexplode("r.pdfs").alias("_pdf", "p")).where(F.col("p.url").isNotNull() & (F.col("p.url") != "") & is_pdf_url(F.col("p.url")))
    field = lambda name: clean_value(F.col(f"r.{name}"), LABELS[name])
    file_name = F.coalesce(F.col("p.arquivo"), F.lit(""))
    return pdfs.select(
        document_id(file_name, F.col("p.url")).alias("doc_id"), F.col("p.url").alias("url"), file_name.alias("arquivo"), "ano", trimmed_kind(F.col("p.tipo")).alias("tipo_pdf"),
        F.col("r.titulo").alias("titulo"), F.col("r.autor").alias("autor"), field("situacao").alias("situacao_doc"), field("assunto").alias("assunto"), F.col("r.ementa").alias("ementa"),
        field("assinatura").alias("assinatura"), field("publicacao").alias("publicacao"), "data_bucket", F.to_json("r", {"ignoreNullFields": "false"}).alias("metadata_json"),
        *(["file_name", F.struct("_bucket", "_record", "_pdf").alias("position")] if ordered else []),
    )


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the largest ``by`` (nulls are smallest), summed up before anything is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*by)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*(c if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns))


def upsert(snapshot: DataFrame, records: DataFrame, sequence: str, key: str = "doc_id", statuses: tuple[str, ...] = tuple(f"status_{s}" for s in STAGES)) -> DataFrame:
    """A new snapshot: columns of ``records`` overwrite, ``statuses`` stay; new keys start pending.

    Of several records with one key the one with the largest ``sequence`` wins.
    """
    new = latest(records, [key], [sequence]).drop(sequence)
    columns = [c for c in new.columns if c != key and c not in statuses]
    old = snapshot.withColumn("_old", F.lit(True))
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in snapshot.columns else F.col(f"n.{c}")
    kept = [F.col(f"o.{c}").alias(c) for c in snapshot.columns if c not in (key, *columns, *statuses)]
    return joined.select(key, *(pick(c).alias(c) for c in columns), *(F.coalesce(F.col(f"o.{s}"), F.lit("pending")).alias(s) for s in statuses if s in snapshot.columns), *kept)


def empty_snapshot(spark: SparkSession) -> DataFrame:
    """A catalog without documents: metadata columns and the stages' statuses."""
    kinds = {"ano": "int"}
    fields = ", ".join(["doc_id string", *(f"{c} {kinds.get(c, 'string')}" for c in META_COLUMNS), *(f"status_{s} string" for s in STAGES)])
    return spark.createDataFrame([], fields)


def loaded(snapshot: DataFrame, records: DataFrame) -> DataFrame:
    """``snapshot`` with the records of metadata files; of records with one id the last one in the files' order wins.

    ``records`` may have ``file_name`` and ``position`` (flatten_metadata() with
    ``ordered``), which say what comes last.
    """
    order = [c for c in ("file_name", "position", "metadata_json") if c in records.columns]
    rows = records.withColumn("_sequence", F.struct(*order)).drop("file_name", "position")
    return upsert(snapshot, rows, "_sequence")


def mark_status(snapshot: DataFrame, deltas: DataFrame, stage: str, extra: tuple[str, ...] = (), sequence: str | None = None) -> DataFrame:
    """``deltas`` (doc_id, status, and ``extra``) applied to one stage; an error text goes once the stage is ok.

    Of several deltas for one document that of the largest ``sequence`` counts;
    without a sequence the largest status does, so 'pending' stays in front of
    'ok' and 'ok' in front of 'error'.
    """
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    by = [sequence] if sequence else ["status", *extra]
    d = latest(deltas.select("doc_id", "status", *extra, *([sequence] if sequence else [])), ["doc_id"], by)
    d = d.select("doc_id", F.col("status").alias("_status"), *(F.col(c).alias(f"_{c}") for c in extra))
    out = snapshot.join(d, "doc_id", "left").withColumn(f"status_{stage}", F.coalesce("_status", f"status_{stage}"))
    for c in extra:
        old = F.when((F.col("_status") == "ok") & F.lit(c == "error"), F.lit(None)).otherwise(F.col(c))
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), old))
    return out.select(*snapshot.columns)


def pending(catalog: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """Documents whose stage is to be done and whose earlier stages let it run; no limit: all."""
    todo = F.col(f"status_{stage}").isin("pending", "error")
    if stage != "download":
        todo &= F.col("status_download") == "ok"
    for later, before in (("chunk", "parse"), ("embed", "chunk")):
        if stage == later:
            todo &= F.col(f"status_{before}") == "ok"
    rows = catalog.where(todo).orderBy("doc_id")
    return rows.limit(limit) if limit else rows


def vision_candidates(catalog: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Downloaded and parsed documents with a page that needs vision, in the order of ids; the limit counts these only."""
    done = catalog.where("status_parse = 'ok' AND status_download = 'ok'")
    rows = done.join(pages.where("needs_vision").select("doc_id").distinct(), "doc_id", "left_semi").orderBy("doc_id")
    return rows.limit(limit) if limit else rows


def embed_work(catalog: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the documents whose embedding is pending, and status deltas of those documents that have no chunk."""
    todo = pending(catalog, "embed").select("doc_id")
    have = chunks.select("doc_id").distinct()
    return chunks.join(todo, "doc_id", "left_semi"), todo.join(have, "doc_id", "left_anti").select("doc_id", F.lit("ok").alias("status"))


def _statistics(counted: dict[str, str] | None) -> list[Column]:
    n = lambda s: F.count_if(F.col("status") == s)
    sums = (F.coalesce(F.sum(column), F.lit(0)).alias(name) for name, column in (counted or {}).items())
    return [F.count("*").alias("pending"), n("ok").alias("ok"), n("error").alias("errors"), *sums]


def job_statistics(results: DataFrame, counted: dict[str, str] | None = None) -> DataFrame:
    """One row of a stage's run: documents taken on (``pending``), done and failed, and sums of the columns in ``counted`` by name."""
    return results.agg(*_statistics(counted))


def observed(results: DataFrame, counted: dict[str, str] | None = None) -> tuple[DataFrame, Observation]:
    """``results``, and an observation that has job_statistics() of them once a job has read them all."""
    seen = Observation()
    return results.observe(seen, *_statistics(counted)), seen


def _states(catalog: DataFrame) -> DataFrame:
    return catalog.unpivot(["doc_id"], [f"status_{s}" for s in STAGES], "stage", "status").withColumn("stage", F.regexp_replace("stage", "^status_", ""))


def stage_counts(catalog: DataFrame) -> DataFrame:
    return _states(catalog).groupBy("stage", "status").agg(F.count("*").alias("n"))


def stage_progress(catalog: DataFrame) -> DataFrame:
    """Totals by stage; skipped documents don't count."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = _states(catalog).groupBy("stage").agg(n("ok").alias("ok"), n("pending").alias("pending"), n("error").alias("error"))
    total = F.col("ok") + F.col("pending") + F.col("error")
    return out.withColumn("total", total).withColumn("ok_ratio", F.when(total > 0, F.col("ok") / total).otherwise(F.lit(0.0)))


def errors(catalog: DataFrame, newest: str = "updated_at", limit: int = 200) -> DataFrame:
    wrong = F.lit(False)
    for s in STAGES:
        wrong |= F.coalesce(F.col(f"status_{s}") == "error", F.lit(False))
    return catalog.where(wrong).orderBy(F.desc_nulls_last(newest), "doc_id").limit(limit)


def payload_filter(filters: dict | None) -> Column:
    """All keys must match: a scalar by equality, a list by membership; other values are ignored."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        if isinstance(value, (bool, int, float, str)):
            out &= F.col(key) == F.lit(value)
        elif isinstance(value, (list, tuple, set)):
            out &= F.col(key).isin(*value)
    return out


def browse(catalog: DataFrame, years=None, situations=None, kinds=None, statuses: dict | None = None, search: str | None = None, limit: int = 500, index: DataFrame | None = None) -> DataFrame:
    """Rows of the browser page and whether there are more than it shows.

    With ``index`` (of trigrams.lists()) only documents that can hold the term are read.
    """
    keep = payload_filter({k: v for k, v in (("ano", years), ("situacao_doc", situations), ("tipo_pdf", kinds)) if v})
    for stage, status in (statuses or {}).items():
        keep &= F.col(f"status_{stage}") == status
    if search and search.strip():
        catalog = trigrams.holding(catalog, index, search) if index is not None else catalog.where(trigrams.held(search))
    order = [F.desc_nulls_last("ano"), F.asc("doc_id")]
    rows = catalog.where(keep).orderBy(*order).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # limit + 1 rows at most
    more = F.max("_n").over(Window.partitionBy(F.lit(0))) > limit
    return numbered.withColumn("truncated", more).where(F.col("_n") <= limit).drop("_n")


def facets(catalog: DataFrame, columns: tuple[str, ...] = ("ano", "situacao_doc")) -> DataFrame:
    """Distinct values of each column, as text."""
    return catalog.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select("f.*").where("value IS NOT NULL").distinct()


def top_values(catalog: DataFrame, column: str, limit: int = 30) -> DataFrame:
    return catalog.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)
