"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has its white space marker behind another character, so a
segmentation never crosses the start of a marker run: a text is the sequence of
its chunks (a marker run and what follows up to the next run), each segmented by
itself. A task lists the distinct chunks of a batch, segments each once, and
joins ids back to the chunks' positions; decoding is the inverse table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.flat import flat, slices, strings
from quarry.session import table

MARK = "▁"
#: Entries that a task keeps of earlier batches; more only means to segment a chunk again.
TABLE_ENTRIES = 200_000
_loaded: dict[str, object] = {}
_known: dict[str, dict[bytes, tuple[str, str, int]]] = {}


def processor(path: str):
    """The model, after a check that chunks are independent in it."""
    if path not in _loaded:
        import sentencepiece
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        norm = model.normalizer_spec
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("pieces of this model can cross white space, or its normaliser changes texts")
        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def chunk_table(path: str, chunks: list[bytes]) -> list[tuple[str, str, int]]:
    """Ids joined by commas, decoded text and number of ids of each distinct chunk.

    A chunk starts with a blank in place of its first marker.
    """
    sp, known = processor(path), _known.setdefault(path, {})
    if len(known) > TABLE_ENTRIES:
        known.clear()
    new = [c for c in chunks if c not in known]
    # The encoder puts the first marker itself; it gives nothing for an empty text.
    for c, ids in zip(new, sp.encode([c[1:].decode() for c in new], num_threads=1), strict=True):
        if c == b" ":
            ids = sp.encode("a" + " ")[len(sp.encode("a")) :]
        known[c] = ",".join(map(str, ids)), " " + sp.decode(ids) if c != b" " else " ", len(ids)
    return [known[c] for c in chunks]


def chunks_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Chunks of all texts, dictionary-encoded, and n + 1 bounds by text; empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, MARK, " ")
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    buf, off = flat(marked)
    if not len(buf):
        return strings(buf, np.zeros(1, np.int64)).dictionary_encode(), np.zeros(len(off), np.int64)
    blank = buf == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(start)
    return strings(buf, np.append(starts, len(buf))).dictionary_encode(), np.searchsorted(starts, off)


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (decimal, joined by commas), n_tokens and decoded text of each row.

    Null and empty texts have no ids and decode to the empty text. Whole texts
    are encoded, whatever their length. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            coded, bounds = chunks_of(batch.column(1))
            parts = chunk_table(path, coded.dictionary.to_pylist())
            index = coded.indices.to_numpy(zero_copy_only=False)
            n = np.concatenate(([0], np.cumsum(np.array([p[2] for p in parts], np.int64)[index]))) if parts else np.zeros(1, np.int64)
            joined = []
            for k, sep in ((0, ","), (1, "")):
                values = pa.array([p[k] for p in parts], pa.string()).take(coded.indices)
                joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), sep))
            decoded = pc.utf8_slice_codeunits(joined[1], 1)  # without the marker that the encoder put first
            yield pa.RecordBatch.from_arrays([batch.column(0), joined[0], pa.array(n[bounds[1:]] - n[bounds[:-1]]), decoded], ["_id", "ids", "n_tokens", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, ids string, n_tokens bigint, decoded string").withColumnRenamed("_id", id_column)



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the texts that they decode to."""
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
