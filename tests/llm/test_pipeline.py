"""Each stage of the pipeline, and a run of all, against plain versions."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_sets import groups, marked
from test_texts import BPE, SF, plain_toxicity, plain_verdicts

from quarry.llm import packing, queries, toxicity
from quarry.session import cut


def plainly_deduplicated(rows):
    """Texts without the bytes that go; a character that would go in part stays."""
    out = {}
    for (i, t), (b, gone) in marked(rows).items():
        kept, at = [], 0
        while at < len(b):
            stop = at
            while stop < len(b) and gone[stop] == gone[at]:
                stop += 1
            run = b[at:stop]
            if gone[at]:
                head = next((k for k, x in enumerate(run) if x & 0xC0 != 0x80), len(run))
                tail = len(run)
                while tail > head and stop < len(b) and (b[stop] if tail == len(run) else run[tail]) & 0xC0 == 0x80:
                    tail -= 1
                run = run[:head] + run[tail:]
            kept.append(run)
            at = stop
        out[i] = b"".join(kept).decode()
    return out


def check_packing(rows, pieces):
    from tokenizers import Tokenizer

    lib, by_doc, by_sequence = Tokenizer.from_file(BPE), defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = np.array([*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4"), 0
        assert len(by_doc[i]) == 1 or len(ids) > packing.CAPACITY
        for k, p in enumerate(sorted(by_doc[i], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= 1.02 * sum(p.length for p in pieces) / packing.CAPACITY + 1


def test_registered_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(rows, queries.QUERIES["op4_best_fit_packing"](spark, SF).collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, seen[-1], SF))
        assert out.columns == docs.columns and out.count() <= seen[-1].count()
        seen.append(out)
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    texts = [[(i, r.text) for i, r in part.items()] for part in rows]

    want = plain_verdicts([(r.doc_id, r.text, r.lang) for r in rows[0].values()])
    assert len({i for i, (kept, _) in want.items() if kept} ^ set(rows[1])) <= 1  # a value at a bin's edge may fall to either side
    assert 0.7 * len(rows[0]) < len(rows[1]) < len(rows[0])

    weights, bias = toxicity.fit(seen[1], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: plain_toxicity(t, weights, bias) for i, t in texts[1]}
    assert {i for i, s in scores.items() if s < 0.7 - 1e-6} <= set(rows[2]) <= {i for i, s in scores.items() if s < 0.7 + 1e-6}

    assert set(rows[3]) == {i for i, (_, c) in groups(texts[2], 5).items() if c == i}

    short = plainly_deduplicated(texts[3])
    assert {i: (r.text, r.n_chars) for i, r in rows[4].items()} == {i: (t, len(t)) for i, t in short.items()}
    for before, after in zip(rows[1:4], rows[2:4]):
        assert all(after[i] == before[i] for i in after)

    check_packing(texts[4], corpus_pipeline.best_fit_packing(spark, seen[4], SF).collect())
    run = corpus_pipeline.run(spark, SF)
    assert run.select("doc_id").distinct().exceptAll(seen[4].select("doc_id")).isEmpty() and run.agg(F.sum("length")).first()[0] == sum(p.length for p in corpus_pipeline.best_fit_packing(spark, seen[4], SF).collect())
