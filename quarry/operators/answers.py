"""From hits to answers, and evaluation of whole case sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import providers
from quarry.operators import evaluation
from quarry.operators.retrieval import citations, context
from quarry.session import cut


def checked(questions: DataFrame, top_k: int | None = None) -> DataFrame:
    """Questions of 1 to 2000 characters; a ``top_k`` outside 1 to 50 is an error."""
    if top_k is not None and not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    return questions.where(F.length("question").between(1, 2000))


def answer(hits: DataFrame, questions: DataFrame, make: Callable[[], providers.Generator] = providers.Extract) -> DataFrame:
    """query_id, question, answer, elapsed, error and citations of all retrieved chunks; ``hits`` are written down, as they are read twice."""
    hits = cut(hits)
    rows = questions.join(context(hits), "query_id", "left")
    return providers.answered(rows, make).drop("context").join(citations(hits), "query_id", "left")


def evaluate(cases: DataFrame, hits: DataFrame, replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits by case, and their summary with the judge's ``replies`` (case_id, reply) to cases with a gold answer."""
    found = evaluation.hits_at(cases, hits.select(F.col("query_id").alias("case_id"), F.col("final_rank").alias("rank"), "doc_id"))
    judged = None
    if replies is not None:
        score, rationale = evaluation.judge_reply(F.col("reply"))
        judged = replies.join(cases.where("gold_answer IS NOT NULL").select("case_id"), "case_id").select("case_id", score.alias("score"), rationale.alias("rationale"))
        found = found.join(judged, "case_id", "left")
    return found, evaluation.summary(found, judged)


def benchmark_passed(answers: DataFrame) -> DataFrame:
    """``passed``: there are citations, and the answer isn't a short refusal."""
    some = F.coalesce(F.size("citations"), F.lit(0)) > 0
    return answers.withColumn("passed", some & ~F.coalesce(evaluation.rejected(F.trim(F.col("answer"))), F.lit(False)))
