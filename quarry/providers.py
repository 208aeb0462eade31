"""Models behind interfaces, with deterministic stand-ins that need no network.

The stand-ins only keep the pipeline testable; their scores aren't those of the
models they stand for.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class HashedWords:
    """Dense vectors of hashed word counts, of unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h & 1 << 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Extract:
    """Answers with the beginning of the context's first entry."""

    def generate(self, system: str, user: str) -> str:
        body = user.split("\n", 1)[-1].strip()
        return body[:300] if body else "Não consta nos documentos."


class Fallback:
    """The second generator from the first failure of the first one on."""

    def __init__(self, first: Generator, second: Generator):
        self.first, self.second, self.switched = first, second, False

    def generate(self, system: str, user: str) -> str:
        if not self.switched:
            try:
                return self.first.generate(system, user)
            except Exception:
                self.switched = True
        return self.second.generate(system, user)


def with_retries(call: Callable, tries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result, after waits that double and vary; the last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(base * 2**n * (1 + random.random()))


def embedded(rows: DataFrame, text: str, make: Callable[[], Encoder] = HashedWords, column: str = "embedding", error: str | None = None) -> DataFrame:
    """``rows`` with dense vectors; a task makes its encoder once and works on batches.

    With ``error``, a batch that fails is encoded text by text, and a text that
    fails has no vector but its message (cut to 240 characters) in that column;
    otherwise the failure ends the job.
    """

    @F.pandas_udf("v array<float>, e string")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make()

        def single(t: str) -> tuple:
            try:
                return encoder.encode([t])[0], None
            except Exception as e:
                return None, str(e)[:240]

        for part in parts:
            texts = part.fillna("").tolist()
            try:
                out = [(v, None) for v in encoder.encode(texts)] if texts else []
            except Exception:
                if error is None:
                    raise
                out = [single(t) for t in texts]
            yield pd.DataFrame(out, columns=["v", "e"], dtype=object)

    out = rows.withColumn("_v", encode(F.col(text))).withColumn(column, F.col("_v.v"))
    return (out.withColumn(error, F.col("_v.e")) if error else out).drop("_v")


def answered(rows: DataFrame, make: Callable[[], Generator] = Extract, system: str = "Answer from the context.", tries: int = 3) -> DataFrame:
    """``rows`` (question, context) with answer, elapsed seconds and error (cut to 240 characters)."""

    @F.pandas_udf("answer string, elapsed double, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for questions, contexts in parts:
            out = []
            for q, c in zip(questions.fillna(""), contexts.fillna(""), strict=True):
                start = time.monotonic()
                try:
                    reply, error = with_retries(lambda q=q, c=c: model.generate(system, f"{q}\n{c}"), tries), None
                except Exception as e:
                    reply, error = None, str(e)[:240]
                out.append((reply, time.monotonic() - start, error))
            yield pd.DataFrame(out, columns=["answer", "elapsed", "error"])

    return rows.withColumn("_r", run("question", "context")).select("*", "_r.*").drop("_r")
