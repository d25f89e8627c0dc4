"""Message history, question routing, and SQL taken from written replies."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillframe.functions.rules import FORCED_QUESTION_WORDS, contains_any, route_analysis, route_question
from tillframe.sources.storage import materialize

# Words that make a query unsafe, and texts that stand for no query.
UNSAFE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE")
UNSAFE_PATTERN = r"(?i)\b(" + "|".join(UNSAFE_WORDS) + r")\b"
PLACEHOLDERS = ("", "...", "SELECT ...", "SELECT…")
BUCKETS = 64  # folders of the stored history


def recent_messages(messages: DataFrame, last_n: int = 20) -> DataFrame:
    """The latest messages of every session, oldest first within each session."""
    latest = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    kept = messages.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= last_n).drop("_n")
    return kept.select("session_id", "seq", "role", "content").orderBy("session_id", "seq")


def session_summary(messages: DataFrame, n: int | None = 50) -> DataFrame:
    """Messages, first and last time per session, the sessions that spoke last first."""
    per = messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at")
    )
    ordered = per.orderBy(F.desc("last_at"), "session_id")
    return ordered if n is None else ordered.limit(n)


HISTORY = "session_id string, seq long, role string, content string, sent_at timestamp"


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def append_messages(rows: DataFrame, path: str) -> None:
    """Add a batch of messages (session_id, role, content) to the stored history, numbered by their time.

    Sessions share a fixed number of folders, so their number does not matter;
    a batch adds a file to each folder at most.
    """
    sent = rows.withColumn("sent_at", F.coalesce("sent_at", F.current_timestamp()) if "sent_at" in rows.columns else F.current_timestamp())
    numbered = sent.withColumn("seq", F.unix_micros("sent_at")).withColumn("session_id", F.col("session_id").cast("string"))
    _write(numbered.select(*HISTORY_COLUMNS), path, "append")


HISTORY_COLUMNS = ("session_id", "seq", "role", "content", "sent_at")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    keyed = rows.withColumn("bucket", _bucket(F.col("session_id")) if "bucket" not in rows.columns else F.col("bucket"))
    writer = keyed.repartition("bucket").write.mode(mode).partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def delete_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Remove a session, whatever characters its id has: its folder is rewritten without it.

    A row without a session keeps a folder that has no other; readers skip it.
    """
    one = spark.createDataFrame([(session_id,)], "session_id string").withColumn("bucket", _bucket(F.col("session_id")))
    number = one.first().bucket
    stored = spark.read.schema(f"{HISTORY}, bucket int").parquet(path).where(F.col("bucket") == number)
    others = stored.where(~F.col("session_id").eqNullSafe(F.lit(session_id)) & F.col("session_id").isNotNull())
    empty = spark.createDataFrame([(None, None, None, None, None, number)], f"{HISTORY}, bucket int")
    _write(materialize(others.unionByName(empty), "history-rewrite"), path, "overwrite")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(f"{HISTORY}, bucket int").parquet(path)
    return stored.where("session_id IS NOT NULL").select(*HISTORY_COLUMNS)


def route_questions(messages: DataFrame) -> DataFrame:
    """The query template each text asks for, and whether it overrides a written query."""
    question = F.col("content")
    return messages.select(
        "session_id",
        "seq",
        route_question(question).alias("template"),
        contains_any(F.lower(question), FORCED_QUESTION_WORDS).alias("forced"),
    )


def route_analyses(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "seq", route_analysis(F.col("content")).alias("analysis"))


def _blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", F.trim(column))


JSON_STRING = r'"(?:[^"\\]|\\.)*"'


def _sql_field(reply: Column) -> Column:
    """The string that follows the key ``sql``, wherever it stands; also where the JSON around it is broken."""
    quoted = F.regexp_extract(reply, rf'(?s)"sql"\s*:\s*({JSON_STRING})', 1)
    wrapped = F.concat(F.lit('{"v":'), quoted, F.lit("}"))
    return F.when(quoted != "", F.from_json(wrapped, "v string", {"allowUnquotedControlChars": "true"})["v"])


def _bare_select(reply: Column) -> Column:
    """From the first SELECT to its LIMIT, or to a semicolon at the end of the reply."""
    start = F.regexp_instr(reply, F.lit(r"(?i)\bselect\b"))
    tail = F.when(start > 0, F.substring(reply, start, F.length(reply)))
    limited = F.regexp_extract(tail, r"(?is)^.*?\blimit\s+[0-9]+", 0)
    closed = F.rtrim(tail)
    return F.when(limited != "", limited).when(closed.endswith(";"), F.rtrim(closed, F.lit("; \n\t")))


def extract_sql(replies: DataFrame) -> DataFrame:
    """The query in each reply: a JSON field, a bare SELECT, or the routed template.

    ``replies`` has ``session_id``, ``seq``, ``question`` and ``reply``. A query
    comes without its closing semicolon.
    """
    written = F.coalesce(_blank_to_null(_sql_field(F.col("reply"))), _blank_to_null(_bare_select(F.col("reply"))))
    usable = F.col("written").isNotNull() & ~F.col("written").isin(*PLACEHOLDERS) & F.col("written").rlike(r"(?i)\bFROM\b")
    forced = contains_any(F.lower("question"), FORCED_QUESTION_WORDS)
    return replies.withColumn("written", written).select(
        "session_id",
        "seq",
        F.when(usable & ~forced, F.col("written")).alias("sql"),
        F.when(forced, "forced").when(usable, "written").otherwise("rules").alias("source"),
        F.when(~usable | forced, route_question(F.col("question"))).alias("template"),
    )


def flag_unsafe_sql(queries: DataFrame, column: str) -> DataFrame:
    """Queries with a flag for words that write or change structures."""
    return queries.withColumn("unsafe", F.coalesce(F.col(column).rlike(UNSAFE_PATTERN), F.lit(False)))


def read_only_query(spark: SparkSession, query: str, cap: int = 0) -> DataFrame:
    """Run one SELECT over the registered views.

    With a ``cap`` at most so many rows are shown, and a warning says if there
    were more.
    """
    if re.search(UNSAFE_PATTERN, query):
        raise PermissionError("only reading queries are allowed")
    if not re.match(r"\s*(SELECT|WITH)\b", query, re.IGNORECASE):
        raise PermissionError("a query must start with SELECT or WITH")
    rows = spark.sql(query)
    if cap and rows.limit(cap + 1).count() > cap:
        warnings.warn(f"only {cap} rows of the result are shown", stacklevel=2)
    return rows.limit(cap) if cap else rows


def answer_question(
    spark: SparkSession,
    question: str,
    reply: str | None,
    templates: Mapping[str, Callable[[], DataFrame]],
    analyses: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> tuple[str, DataFrame, DataFrame | None]:
    """(source, result, analysis) of a question, given what a language model replied (or nothing).

    The query in the reply is run over the registered views if it is usable and
    the question does not force a template; else the routed template is built. A
    query that is not allowed or does not run falls back to the template too.
    The analysis that the question asks for, if any, is applied to the result.
    """
    row = spark.createDataFrame([(0, 0, question, reply or "")], "session_id long, seq long, question string, reply string")
    found = extract_sql(row).first()
    fallback = row.select(route_question(F.col("question")).alias("t")).first().t
    source, result = found.source, None
    if found.sql:
        try:
            result = read_only_query(spark, found.sql)
            result.schema  # noqa: B018  analysis errors show here
        except (PermissionError, AnalysisException, ParseException):
            source = "rules"
    if result is None:
        result = templates[found.template or fallback]()
    kind = row.select(route_analysis(F.col("question")).alias("a")).first().a
    analysis = analyses[kind](result) if kind and analyses and kind in analyses else None
    return source, result, analysis
