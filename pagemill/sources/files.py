"""File sources and reports about files: surveys, question banks, ranged reads, logs, backup checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SURVEY = "path string, size long, mtime double, format string, pages int, ocr_class string, language string, sampled int, text_chars long, error string"
QUESTION = "id: string, category: string, question: string, answerable: boolean, expected_chunks: array<string>, status: string"
CATEGORIES = ("exact_term", "conceptual", "multi_book", "cross_language", "location", "unanswerable")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Survey records, one JSON object a line; missing fields get their defaults."""
    r = spark.read.schema(SURVEY).json(path)
    return r.fillna({"ocr_class": "unknown", "language": "unknown", "sampled": 0, "text_chars": 0})


def merge_survey(old: DataFrame, new: DataFrame) -> DataFrame:
    """A resumed survey: what is known stays, only unseen paths are added."""
    return old.unionByName(new.join(old.select("path"), "path", "left_anti"))


def candidates(survey: DataFrame) -> DataFrame:
    """Records that a manifest may take, with their stratum."""
    fit = F.col("format").isin("pdf", "epub") & F.col("pages").isNotNull() & F.col("error").isNull()
    return survey.filter(fit).withColumn("stratum", F.concat_ws("|", "format", "ocr_class", "language"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question bank or data set: a JSON file with an array of questions."""
    whole = spark.read.schema(f"questions array<struct<{QUESTION}>>").option("multiLine", "true").json(path)
    return whole.select(F.inline("questions")).withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def question_problems(questions: DataFrame) -> DataFrame:
    """(id, problem) of questions that break the bank's rules."""
    counted = questions.withColumn("n", F.count("*").over(W.partitionBy("id")))
    problem = (
        F.when(F.col("n") > 1, "duplicate_id").when(F.trim(F.coalesce("question", F.lit(""))) == "", "empty_question").when(~F.col("category").isin(*CATEGORIES), "unknown_category")
        .when((F.col("category") == "unanswerable") == F.col("answerable"), "answerable_mismatch")
    )
    return counted.withColumn("problem", problem).filter("problem is not null").select("id", "problem").distinct()


def next_question_id(questions: DataFrame) -> DataFrame:
    """One row: the id after the greatest of the form q<number>."""
    n = F.coalesce(F.max(F.regexp_extract("id", r"^q(\d+)$", 1).try_cast("int")), F.lit(0)) + 1
    return questions.agg(F.format_string("q%03d", n).alias("id"))


def byte_range(content: Column, header: Column) -> Column:
    """struct(status, start, end, body) of a Range header over bytes: 200 whole, 206 a part, 416 none.

    bytes=a-b, bytes=a- and bytes=-n; an end beyond the content is clamped, a start beyond it is refused.
    """
    size = F.length(content).cast("long")
    a, b = (F.regexp_extract(F.trim(header), r"^bytes=(\d*)-(\d*)$", i).try_cast("long") for i in (1, 2))
    start = F.when(a.isNotNull(), a).when(b.isNotNull(), F.greatest(size - b, F.lit(0)))
    end = F.when(a.isNull(), size - 1).otherwise(F.least(F.coalesce(b, size - 1), size - 1))
    good = (start < size) & (start <= end) & ~(a.isNull() & (b == 0))
    status = F.when(header.isNull(), 200).when(F.coalesce(good, F.lit(False)), 206).otherwise(416)
    body = F.when(status == 200, content).when(status == 206, F.substring(content, (start + 1).cast("int"), (end - start + 1).cast("int")))
    return F.struct(status.alias("status"), F.when(status == 206, start).alias("start"), F.when(status == 206, end).alias("end"), body.alias("body"))


def log_tail(lines: DataFrame, n: int = 200) -> DataFrame:
    """The last n of lines (number, value), in order."""
    return lines.orderBy(F.desc("number")).limit(n).orderBy("number")


def job_logs(names: DataFrame, jobs: DataFrame) -> DataFrame:
    """(name, job_id, attempt, stage, state) of log files (name); names of another form are left out."""
    form = r"^(\d+)\.attempt(\d+)\.log$"
    own = names.filter(F.col("name").rlike(form)).select("name", F.regexp_extract("name", form, 1).cast("long").alias("job_id"), F.regexp_extract("name", form, 2).cast("int").alias("attempt"))
    return own.join(jobs.select("job_id", "stage", "state"), "job_id", "left")


def backup_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of a backup: expected and found (path, size, sha256); missing, extra, size or content."""
    e = expected.select("path", F.col("size").alias("e_size"), F.col("sha256").alias("e_sha"))
    both = e.join(found, "path", "full")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("e_size").isNull(), "extra").when(F.col("size") != F.col("e_size"), "size").when(F.col("sha256") != F.col("e_sha"), "content")
    return both.withColumn("problem", problem).filter("problem is not null").select("path", "problem")
