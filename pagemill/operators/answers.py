"""Cited answers: prompts, one bounded repair, verdicts, history. The model is a function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.session import durable

INSTRUCTIONS = "Answer from the evidence below only. Cite the IDs of the evidence in square brackets behind what they support. If it doesn't suffice, write ABSTAIN on the first line and the reason on the next."
#: Reasons that callers tell apart.
NO_EVIDENCE = "no evidence found for this query"
NO_MODEL = "answer model not configured (set answer.model_revision)"
UNCITED = "answer contained no citations after one repair attempt"
UNKNOWN = "unknown evidence IDs after one repair attempt: "

Model = Callable[[list[dict[str, str]]], str]
MESSAGES = "array<struct<role: string, content: string>>"


def place(kind: Column, page: Column, label: Column, ref: Column, anchor: Column) -> Column:
    """Where a passage stands: a page with its label, a section with its anchor, or unknown."""
    more = lambda c, before, behind: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(behind))).otherwise(F.lit(""))
    return (
        F.when(kind == "page", F.concat(F.lit("page "), page.cast("string"), more(label, " (", ")")))
        .when(kind == "section", F.concat(F.lit("section "), ref, more(anchor, " #", "")))
        .otherwise(F.lit("location unknown"))
    )


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, known, messages) of questions (query_id, text): known lists the ids of their evidence, in order.

    evidence (query_id, evidence_id, title, place, text); a question without any has an empty list and no messages.
    """
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    block = F.concat(F.lit("["), "evidence_id", F.lit("] ("), F.coalesce("title", F.lit("untitled")), F.lit(": "), "place", F.lit(")\n"), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(number.alias("n"), "evidence_id", block.alias("block"))))
    found = evidence.groupBy("query_id").agg(listed.alias("e"))
    body = F.concat(F.lit("Question: "), "text", F.lit("\n\nEvidence:\n"), F.array_join(F.transform("e", lambda x: x["block"]), "\n"), F.lit("\n\nAnswer now, citing the evidence IDs you used."))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return questions.select("query_id", "text").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce(F.transform("e", lambda x: x["evidence_id"]), F.array().cast("array<string>")).alias("known"),
        F.when(F.col("e").isNotNull(), F.array(message("system", F.lit(INSTRUCTIONS)), message("user", body))).alias("messages"),
    )


def asked(prompts: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """(query_id, raw, error): the model's reply to messages; model() makes it once a task, and its errors are kept."""
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for f in frames:
            rows = []
            for messages in f["messages"]:
                try:
                    rows.append((own([dict(m) if isinstance(m, dict) else m.asDict() for m in messages]), None))
                except Exception as problem:  # noqa: BLE001: one question's failure is its own
                    rows.append((None, str(problem) or type(problem).__name__))
            yield pd.DataFrame({"query_id": f["query_id"], "raw": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return prompts.select("query_id", "messages").mapInPandas(run, f"query_id {kind}, raw string, error string")


def repair(raw: Column, known: Column) -> Column:
    """What to add to the messages of an answer that cites nothing, or what isn't there."""
    unknown = T.unknown_citations(raw, known)
    problem = F.when(F.size(T.citations(raw)) == 0, F.lit("it cited nothing")).otherwise(F.concat(F.lit("these IDs are not in the evidence: "), F.array_join(unknown, ", ")))
    text = F.concat(F.lit("That answer can't be used: "), problem, F.lit(". Write it anew with IDs from the list above, or ABSTAIN on the first line and the reason on the next."))
    return F.array(F.struct(F.lit("assistant").alias("role"), raw.alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))


def answers(questions: DataFrame, evidence: DataFrame, model: Callable[[], Model] | None) -> DataFrame:
    """(query_id, status, answer_text, abstain_reason, failure_reason, citations, repaired) of every question.

    Without evidence a question abstains and the model isn't asked; an answer without citations, or with unknown ones,
    is sent back once. status: answered, abstained or failed.
    """
    base = prompts(questions, evidence)
    null = lambda kind="string": F.lit(None).cast(kind)
    if model is None:
        none = F.col("messages").isNull()
        return base.select(
            "query_id", F.when(none, "abstained").otherwise("failed").alias("status"), null().alias("answer_text"), F.when(none, NO_EVIDENCE).alias("abstain_reason"),
            F.when(~none, NO_MODEL).alias("failure_reason"), F.array().cast("array<string>").alias("citations"), F.lit(False).alias("repaired"),
        )
    spark = questions.sparkSession
    # Replies are kept: a model isn't asked twice because a later step is computed anew.
    durable(spark)
    first = asked(base.filter("messages is not null"), model).checkpoint()
    judged = base.join(first, "query_id", "left").withColumn("verdict", T.verdict(F.col("raw"), F.col("known")))
    again = judged.filter(F.col("verdict").isin("missing", "unknown"))
    again = again.withColumn("messages", F.concat("messages", repair(F.col("raw"), F.col("known"))))
    second = asked(again, model).select("query_id", F.col("raw").alias("raw2"), F.col("error").alias("error2"), F.lit(True).alias("repaired")).checkpoint()
    done = judged.join(second, "query_id", "left").withColumn("repaired", F.coalesce("repaired", F.lit(False)))
    done = done.withColumn("final", F.when(F.col("repaired"), F.col("raw2")).otherwise(F.col("raw"))).withColumn("last", T.verdict(F.col("final"), F.col("known")))
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("answer model error: "), "error")).when(F.col("error2").isNotNull(), F.concat(F.lit("answer model error during repair: "), "error2"))
    none = F.col("messages").isNull()
    status = F.when(none, "abstained").when(failed.isNotNull(), "failed").when(F.col("last") == "abstain", "abstained").when(F.col("last") == "ok", "answered").otherwise("failed")
    reason = F.when(none, F.lit(None)).when(failed.isNotNull(), failed).when(F.col("last") == "missing", UNCITED)
    reason = reason.when(F.col("last") == "unknown", F.concat(F.lit(UNKNOWN), F.array_join(T.unknown_citations(F.col("final"), F.col("known")), ", ")))
    settled = done.withColumn("status", status)
    return settled.select(
        "query_id", "status", F.when((F.col("status") == "answered") | (F.col("last").isin("missing", "unknown") & failed.isNull()), F.col("final")).alias("answer_text"),
        F.when(none, NO_EVIDENCE).when(F.col("status") == "abstained", T.abstention(F.col("final"))).alias("abstain_reason"), reason.alias("failure_reason"),
        F.when(F.col("status") == "answered", T.citations(F.col("final"))).otherwise(F.array().cast("array<string>")).alias("citations"), "repaired",
    )


def history(stored: DataFrame, citations: DataFrame, n: int = 50) -> DataFrame:
    """The n newest of stored answers (answer_id, created_at, ...) with their number of citations (answer_id, ...)."""
    newest = stored.orderBy(F.desc("created_at"), F.desc("answer_id")).limit(n)
    counted = citations.groupBy("answer_id").agg(F.count("*").alias("citation_count"))
    return newest.join(counted, "answer_id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0).cast("long")))
