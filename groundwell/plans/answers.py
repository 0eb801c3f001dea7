"""From questions to logged answers: search, compress, answer, log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.operators import lexical
from groundwell.sources.sinks import append_log, log_records


@dataclass(frozen=True)
class AnswerSettings:
    top_k: int = 5
    threshold: float = 0.1
    max_chunks: int = 4
    max_chars: int = 1200
    chat_model: str = "mock-chat"
    embedding_model: str = "mock-embedding"


def answer_requests(requests: DataFrame, chunks: DataFrame, settings: AnswerSettings = AnswerSettings()) -> DataFrame:
    """Answers of all valid requests (query_id, session_id, user_id, question, model, use_knowledge, created_at).

    A request that does not want knowledge is answered without hits; a refused one carries its reason.
    """
    judged = requests.withColumn("reject_reason", lexical.chat_reason())
    valid = judged.filter(F.col("reject_reason").isNull())
    asking = valid.filter("use_knowledge").select("query_id", "question")
    found = lexical.retrieve(asking, chunks, settings.top_k, settings.threshold).drop("question", "normalized_question")
    selected = lexical.compress(found, settings.max_chunks, settings.max_chars)
    made = lexical.answers(valid, selected, settings.max_chars)
    return judged.join(made.drop("question"), "query_id", "left")


def answer_and_log(requests: DataFrame, chunks: DataFrame, log_path: str,
                   settings: AnswerSettings = AnswerSettings()) -> None:
    answered = answer_requests(requests, chunks, settings).filter(F.col("reject_reason").isNull())
    append_log(log_records(answered, settings.chat_model, settings.embedding_model), log_path)
