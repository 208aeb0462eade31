"""Work on documents in a child process of the task: one that kills or hangs it costs a row, not the job."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of an error text.
SHOWN = 240


def _serve(pipe, make: Callable[[], Callable[[dict], list[dict]]]) -> None:
    work = make()
    while True:
        try:
            row = pipe.recv()
        except EOFError:
            return
        try:
            answer = (work(row), None)
        except Exception as e:
            answer = (None, f"{type(e).__name__}: {e}"[:SHOWN])
        pipe.send(answer)


class Child:
    """A process that works on one row after the other; it is started anew after it has died or taken too long."""

    def __init__(self, make: Callable[[], Callable[[dict], list[dict]]], seconds: float, rows: int):
        self.make, self.seconds, self.rows, self.process = make, seconds, rows, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, own = context.Pipe()
        self.process = context.Process(target=_serve, args=(own, self.make), daemon=True)
        self.process.start()
        own.close()
        self.done = 0

    def stop(self) -> None:
        if self.process is not None:
            self.pipe.close()
            self.process.kill()
            self.process.join()
            self.process = None

    def ask(self, row: dict) -> tuple[list[dict] | None, str | None]:
        """The rows made of ``row``, or why there are none."""
        if self.process is None:
            self._start()
        try:
            self.pipe.send(row)
            if not self.pipe.poll(self.seconds):
                self.stop()
                return None, f"took longer than {self.seconds:g} s"
            answer = self.pipe.recv()
        except (EOFError, OSError):
            self.process.join(5)
            code = self.process.exitcode
            self.stop()
            return None, f"the process died ({code})"
        self.done += 1
        if self.done >= self.rows:  # what libraries leak goes with it
            self.stop()
        return answer


def isolated(rows: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: StructType, key: str = "doc_id", seconds: float = 600, rows_each: int = 200) -> DataFrame:
    """What ``make()(row)`` gives for each row, with the row's ``key`` and ``error``.

    ``make`` is called in the child and may load a library there; the function it
    returns takes a row as a dictionary and gives rows of ``schema``. A row that
    raises, dies or takes more than ``seconds`` gives one row with the error alone; one
    that gives nothing gives no row. A child works on ``rows_each`` rows at most.
    """
    out = StructType([rows.schema[key], *schema, StructField("error", StringType())])
    names = [f.name for f in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = Child(make, seconds, rows_each)
        try:
            for batch in batches:
                for row in batch.to_dict("records"):
                    made, error = child.ask(row)
                    full = [{key: row[key]} | m | {"error": None} for m in made] if error is None else [{key: row[key], "error": error}]
                    if full:
                        yield pd.DataFrame(full, columns=names, dtype=object)
        finally:
            child.stop()

    return rows.mapInPandas(run, out)
