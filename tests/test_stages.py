"""Stages from metadata to answers, over stored tables."""

import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.config import Config
from quarry.operators import catalog, retrieval, vectors
from quarry.sources import tables


def folder(name=""):
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), name or "t")


def test_chunks_of_other_documents_stay(spark):
    path = folder("chunks")
    rows = spark.range(500).select(F.format_string("d%03d", "id").alias("doc_id"), F.lit("old").alias("text"))
    assert tables.read_chunks(spark, path, "doc_id string, text string").count() == 0
    tables.write_chunks(rows, path)
    tables.write_chunks(spark.createDataFrame([("d007", "new"), ("d007", "more")], "doc_id string, text string"), path)
    got = tables.read_chunks(spark, path, "doc_id string, text string")
    assert got.count() == 501 and sorted(r.text for r in tables.read_chunks(spark, path, "doc_id string, text string", ["d007"]).collect()) == ["more", "new"]


def test_repeated_deltas_make_one_row(spark):
    old = spark.createDataFrame([("a", "pending", None), ("b", "pending", "x")], "doc_id string, status_parse string, error string")
    deltas = spark.createDataFrame([("a", "ok", None, 1), ("a", "error", "bad", 2), ("b", "error", "y", 1), ("b", "ok", None, 2)], "doc_id string, status string, error string, n int")
    got = {r.doc_id: (r.status_parse, r.error) for r in catalog.mark_status(old, deltas, "parse", ("error",), "n").collect()}
    assert got == {"a": ("error", "bad"), "b": ("ok", None)}
    assert catalog.mark_status(old, deltas, "parse").count() == 2


def test_last_record_wins_and_statuses_stay(spark):
    files = spark.createDataFrame(
        [("x_2020_metadados.json", json.dumps({"b": {"registros": [{"titulo": "z first", "pdfs": [{"url": "u/a.pdf"}]}, {"titulo": "a last", "pdfs": [{"url": "u/a.pdf"}]}]}}))], "file_name string, value string"
    )
    records = catalog.flatten_metadata(files, ordered=True)
    one = catalog.loaded(catalog.empty_snapshot(spark), records)
    assert [(r.titulo, r.status_download) for r in one.collect()] == [("a last", "pending")]
    done = catalog.mark_status(one, one.select("doc_id", F.lit("ok").alias("status")), "download")
    again = catalog.loaded(done, records.where("titulo = 'z first'"))
    assert [(r.titulo, r.status_download, r.status_parse) for r in again.collect()] == [("z first", "ok", "pending")]


def test_command_line(spark, capsys):
    meta, cat, mirror, stored, pages, chunks, points = (folder(n) for n in ("m", "cat", "mirror", "files", "pages", "chunks", "points"))
    os.makedirs(meta), os.makedirs(mirror)
    entry = lambda k: {"titulo": f"t{k}", "situacao": "Situação: VIGENTE", "pdfs": [{"url": f"http://h/r{100 + k}.pdf", "arquivo": f"res{100 + k}_2021.pdf"}]}
    with open(f"{meta}/x_2021_metadados.json", "w") as f:
        json.dump({"b": {"registros": [entry(k) for k in range(4)]}}, f)
    for _ in range(2):  # a second run is an upsert
        main(["init", f"{meta}/x_2021_metadados.json", cat])
    ids = sorted(r.doc_id for r in tables.load(spark, cat).collect())
    assert len(ids) == 4
    for i in ids[:3]:
        with open(f"{mirror}/{i}.pdf", "wb") as f:
            f.write(b"%PDF")
    main(["download", cat, mirror, stored])
    assert sorted(r.status_download for r in tables.load(spark, cat).collect()) == ["error", "ok", "ok", "ok"]
    parsed = tables.load(spark, cat).where("status_download = 'ok'").select("doc_id", F.lit("ok").alias("status"))
    catalog.mark_status(tables.load(spark, cat), parsed, "parse").write.parquet(cat + "2")
    cat += "2"
    text = "Art. 1 energia solar " + "palavra " * 80
    spark.createDataFrame([(i, 0, f"{text} {k}", True) for k, i in enumerate(ids[:2])], "doc_id string, page_index int, page_text string, needs_vision boolean").write.parquet(pages)
    main(["vision", cat, pages, "--limit", "1"])
    main(["chunk", cat, pages, chunks])
    main(["embed", cat, chunks, points])
    main(["status", cat])
    main(["pending", cat, "embed"])
    got = {r.doc_id: (r.status_chunk, r.status_embed) for r in tables.load(spark, cat).collect()}
    assert got[ids[0]] == ("ok", "ok") and got[ids[2]] == ("error", "pending") and got[ids[3]][0] == "pending"
    questions, cases, report = folder("q.txt"), folder("cases.jsonl"), folder("report")
    with open(questions, "w") as f:
        f.write("energia solar na resolução 100\n\npalavra\n")
    with open(cases, "w") as f:
        f.write(json.dumps({"question": "resolução 101 energia", "expected_doc_ids": [ids[1]]}) + "\n")
    main(["search", points, questions, "--filters", '{"situacao_doc": "VIGENTE", "ano": [2021]}'])
    main(["qa", points, questions, "--top-k", "2"])
    main(["evaluate", points, cases, report])
    out = capsys.readouterr().out
    assert "res100_2021__" in out and [r.hit_at_1 for r in spark.read.json(report).collect()] == [True]
    main(["search", points, questions, "--filters", '{"ano": 1999}'])
    assert "res100_2021__" not in capsys.readouterr().out


def test_sparse_search_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(rng.choices(words[: rng.choice([3, 40])], k=rng.randrange(0, 30)))) for i in range(300)] + [(300, None), (301, "")]
    asked = [(i, " ".join(rng.choices([*words, "none"], k=rng.randrange(0, 8)))) for i in range(25)]
    d, q = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(asked, "query_id int, text string")
    want = []
    for i, t in asked:
        scores = [(-sum(t.split().count(w) * (x or "").split().count(w) for w in set(t.split())), k) for k, x in docs]
        want += [(i, k, float(-s), n + 1) for n, (s, k) in enumerate(sorted(x for x in scores if x[0])[:7])]
    lists, weights = vectors.term_lists(d, "doc_id", "text"), vectors.postings(q, "query_id", "text")
    stored = vectors.listed(vectors.postings(d, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id"))
    for index in (lists, stored):
        for config in (Config(), Config(query_block=6)):
            got = vectors.sparse_top_k(index, weights, 7, config).collect()
            assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got) == sorted(want)
    assert vectors.sparse_top_k(lists, weights.limit(0)).count() == 0
    plan = vectors.sparse_top_k(lists, weights)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_identifiers_meet_in_an_equi_join(spark):
    names = [(1, "res1234_2021"), (2, "a12b99999"), (3, "x 0123456"), (4, None), (5, "12")]
    asked = [(1, "number 123"), (2, "number 234 of 2021"), (3, "12345"), (4, "2021 only"), (5, "99999 and 123 of 2020")]
    df = retrieval.identifier_documents(spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame(names, "doc_id int, arquivo string"))
    assert sorted(map(tuple, df.collect())) == [(1, 1), (1, 3), (2, 1), (3, 3)]
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
