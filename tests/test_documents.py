"""Edge rows of catalog, pages, chunks and ids, held against plain Python."""

import hashlib
import random
import re
import uuid

from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions import ids, text
from quarry.operators import catalog, chunks, pages


def one(df):
    return [tuple(r) for r in df.collect()]


def test_strip_and_lines(spark):
    values = ["", " a ", " x ", "\x1cq\x1d", "a\nb\r\nc d\n", "no end", "\n", "a\x0b\x0cb"]
    got = one(spark.createDataFrame([(v,) for v in values], "t string").select("t", text.strip(F.col("t")), text.lines(F.col("t")), text.strip_end(F.col("t"))))
    for t, stripped, parts, end in got:
        assert stripped == t.strip() and end == t.rstrip()
        assert parts == t.splitlines()


def test_clean_value(spark):
    rows = [("Assunto: x ",), ("ASSUNTO:",), (" y",), ("",), (None,), ("Assunto:   ",)]
    got = one(spark.createDataFrame(rows, "t string").select(text.clean_value(F.col("t"), "Assunto:")))
    assert [g[0] for g in got] == ["x", None, "y", None, None, None]


def test_ids(spark):
    rows = [("a/b.c.pdf", "http://x/y.pdf"), ("", "http://x/y.pdf?q=1"), (" ", "u/.hidden"), (None, "plain")]
    got = one(spark.createDataFrame(rows, "f string, u string").select(ids.document_id(F.col("f"), F.col("u"))))
    stems = ["b.c", "y", ".hidden", "plain"]
    assert [g[0] for g in got] == [f"{s}__{hashlib.sha1(u.encode()).hexdigest()[:10]}" for s, (_, u) in zip(stems, rows)]
    names = ["", "é", "doc::0001"]
    got = one(spark.createDataFrame([(n,) for n in names], "n string").select(ids.point_id(F.col("n"))))
    assert [g[0] for g in got] == [str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), n)) for n in names]
    long = "\U0001f600" * 250
    got = one(spark.createDataFrame([("d", 12345, long)], "d string, i int, t string").select(ids.chunk_id(F.col("d"), F.col("i"), F.col("t"))))
    assert got[0][0] == "d::12345::" + hashlib.sha1(f"d|12345|{long[:200]}".encode()).hexdigest()[:16]


def test_metadata(spark):
    value = """{"b1": {"registros": [{"titulo": "t", "situacao": "SITUAÇÃO: VIGENTE", "pdfs": null}, {"titulo": " u ", "assunto": "Assunto:", "pdfs": [
      {"tipo": "Texto:: ", "url": "http://h/A.PDF?x=1", "arquivo": ""}, {"tipo": null, "url": "http://h/a.html", "arquivo": "q.pdf"}, {"url": null}]}]}, "b2": {"registros": []}}"""
    got = catalog.flatten_metadata(spark.createDataFrame([(value, "x_2021_metadados.json"), ("not json", "y.json")], "value string, file_name string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.ano, r.tipo_pdf, r.titulo, r.assunto, r.situacao_doc, r.arquivo, r.data_bucket) == (2021, "Texto", " u ", None, None, "", "b1")
    assert r.doc_id.startswith("A__")


def test_upsert_and_status(spark):
    old = spark.createDataFrame([("a", "1", "ok", "e"), ("b", "2", "error", None)], "doc_id string, titulo string, status_download string, error string")
    new = spark.createDataFrame([("a", "9", 1), ("a", None, 2), ("c", "3", 1)], "doc_id string, titulo string, seq int")
    got = {r.doc_id: tuple(r)[1:] for r in catalog.upsert(old, new, "seq").collect()}
    assert got == {"a": (None, "ok", "e"), "b": ("2", "error", None), "c": ("3", "pending", None)}
    deltas = spark.createDataFrame([("a", "ok", None)], "doc_id string, status string, error string")
    got = {r.doc_id: (r.status_download, r.error) for r in catalog.mark_status(old, deltas, "download", ("error",)).collect()}
    assert got == {"a": ("ok", None), "b": ("error", None)}


def test_pending_limits(spark):
    rows = [(i, d, p, c, e) for i, (d, p, c, e) in enumerate([("ok", "pending", "ok", "ok"), ("ok", "skipped", "pending", "error"), ("error", "error", "ok", "pending"), ("ok", "ok", "pending", "pending")])]
    cat = spark.createDataFrame(rows, "doc_id int, status_download string, status_parse string, status_chunk string, status_embed string")
    ids_ = lambda *a: [r.doc_id for r in catalog.pending(cat, *a).collect()]
    assert ids_("download") == [2] and ids_("parse") == [0] and ids_("chunk") == [3] and ids_("embed") == []
    assert ids_("parse", 0) == [0] and ids_("parse", 1) == [0]


def test_router_and_tables(spark):
    rows = [(59, True), (60, True), (60, False), (0, None)]
    got = one(spark.createDataFrame(rows, "n int, t boolean").select(pages.classify(F.col("n"), F.col("t"))))
    assert [g[0] for g in got] == ["scanned", "complex", "digital", "scanned"]
    tables = [[["a", None], ["b|c", "x\ny", "z"]], [["h"]], []]
    got = one(spark.createDataFrame([(t,) for t in tables], "rows array<array<string>>").select(pages.table_markdown(F.col("rows"))))
    assert [g[0] for g in got] == ["| a |  |  |\n| --- | --- | --- |\n| b\\|c | x y | z |", "| h |\n| --- |", ""]


def test_strikes(spark):
    span = [("d", 0, 0, i, t, x0, 0.0, x1, 10.0) for i, (t, x0, x1) in enumerate([("abc", 0.0, 10.0), ("de", 20.0, 30.0), ("zero", 40.0, 40.0), ("free", 50.0, 60.0)])]
    spans = spark.createDataFrame(span, "doc_id string, page_index int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double")
    draw = [("d", 0, "line", 0.0, 5.0, 5.5, 5.0), ("d", 0, "rect", 20.0, 4.0, 25.4, 5.0), ("d", 0, "line", 40.0, 5.0, 44.9, 5.0), ("d", 0, "line", 50.0, 9.9, 60.0, 9.9), ("d", 0, "line", 0.0, 0.0, 0.0, 9.0)]
    lines = pages.stroke_lines(spark.createDataFrame(draw, "doc_id string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double"))
    assert lines.count() == 4
    got = pages.struck(spans, lines)
    assert [r.revoked for r in got.orderBy("span_no").collect()] == [True, False, False, False]
    assert pages.spans_markdown(got).collect()[0].markdown == "~~abc~~dezerofree"


def model_blocks(lines):
    """Plain fold over (page, line)."""
    out, cur, art = [], None, None
    for page, line in lines:
        if not line:
            if cur:
                cur["t"].append("")
            continue
        if re.match(r"\s*Art\.\s*\d+[ºo]?\b", line, re.I):
            art, cur = line.strip(), {"t": [line], "s": page, "e": page, "a": line.strip()}
            out.append(cur)
        elif re.match(r"\s*(CAP[IÍ]TULO|SE[ÇC][AÃ]O|TÍTULO)\s+[IVXLCDM]+", line, re.I):
            cur = {"t": [line], "s": page, "e": page, "a": art}
            out.append(cur)
        else:
            if cur is None:
                cur = {"t": [], "s": page, "e": page, "a": art}
                out.append(cur)
            cur["t"].append(line)
            cur["e"] = page
    return [("\n".join(b["t"]).strip(), b["s"], b["e"], b["a"]) for b in out if "\n".join(b["t"]).strip()]


def test_structure(spark):
    rng = random.Random(3)
    kinds = ["", "text", "Art. 3º x", " capítulo IV", "§ 1º y", "título ii", "Parágrafo único z", "seção X"]
    docs = {d: [(p, rng.choice(kinds)) for p in range(4) for _ in range(rng.randrange(6))] for d in range(20)}
    rows = [(d, p, i, line) for d, lines in docs.items() for i, (p, line) in enumerate(lines)]
    got = chunks.structural_blocks(spark.createDataFrame(rows, "doc_id int, page_index int, line_no int, line string")).orderBy("doc_id", "block_no").collect()
    want = [(d, *b) for d, lines in docs.items() for b in model_blocks(lines)]
    assert [(r.doc_id, r.text, r.page_start, r.page_end, r.article_ref) for r in got] == want


def model_windows(t, limit, overlap):
    ps = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
    if max(1, len(t) // 4) <= limit // 4 or not ps:
        return [t]
    out, buf = [], []
    for p in ps:
        if buf and sum(map(len, buf)) + len(p) > limit:
            out.append("\n\n".join(buf))
            keep = []
            for q in reversed(buf):
                if sum(map(len, keep)) + len(q) > overlap:
                    break
                keep.insert(0, q)
            buf = keep
        buf.append(p)
    return [*out, "\n\n".join(buf)] if buf else out


def test_windows(spark):
    rng = random.Random(5)
    texts = ["", " \n\n ", "x" * 4000, "a" * 500 + "\n\n" + "b" * 100 + "\n \n" + "c" * 400]
    texts += ["\n\n".join("w" * rng.randrange(1, 120) for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    config = Config(max_tokens=100, overlap_tokens=25)
    got = one(spark.createDataFrame([(t,) for t in texts], "t string").select(chunks.window_pieces(F.col("t"), config)))
    assert [g[0] for g in got] == [model_windows(t, 400, 100) for t in texts]


def test_merge_keeps_text(spark):
    rows = [("d", i, t, i, i, "Art. 1") for i, t in enumerate(["tiny", "small", "L" * 300, "end ~~old~~", "x\n| a |\n| --- |", "tail"])]
    got = chunks.merged(spark.createDataFrame(rows, "doc_id string, piece_no int, piece string, page_start int, page_end int, article_ref string")).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["tiny\n\nsmall", "L" * 300 + "\n\nend ~~old~~", "x\n| a |\n| --- |\n\ntail"]
    assert [(r.page_start, r.page_end, r.has_revoked, r.has_table) for r in got] == [(0, 1, False, False), (2, 3, True, False), (4, 5, False, True)]


def test_flags_and_cleanup(spark):
    rows = ["| a |\n| --- |", "t\n| a |\n| --- |", "~~x~~", "~~ ~~", "a\n\n\n\nb", "x\n| | |\ny", "   "]
    got = one(spark.createDataFrame([(r,) for r in rows], "t string").select(chunks.has_table(F.col("t")), chunks.has_revoked(F.col("t")), chunks.clean_text(F.col("t"))))
    assert [g[0] for g in got][:2] == [False, True]
    assert [g[1] for g in got][2:4] == [True, True]
    assert [g[2] for g in got][3:] == ["", "a\n\nb", "x\n\ny", ""]


def test_very_many_paragraphs_take_linear_time(spark):
    import time

    times = []
    for n in (4_000, 32_000):
        df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("paragraph "), k.cast("string"))), "\n\n").alias("t"))
        start = time.time()
        got = df.select(F.size(chunks.window_pieces(F.col("t"))).alias("n"), F.length(F.array_join(chunks.window_pieces(F.col("t")), "")).alias("c")).first()
        times.append(time.time() - start)
        assert got.n > n // 300
    assert times[1] < 12 * max(times[0], 0.5)
