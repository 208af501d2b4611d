"""Ingest by file streams: messages land as files by kind, streams append them to tables, verdicts are batches over a snapshot.

Nothing is evaluated while messages arrive. A snapshot is frozen by its time: its verdicts are computed when they are first asked for,
out of what had arrived by then, and read from then on; what arrives later is stored, and belongs to the next snapshot. Queries about
a module or source that a snapshot doesn't hold give no rows.

Questions about modules and sources land as messages too: a stream joins them with a frozen snapshot and writes the replies, each question's once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reachlens.operators import classify, closure, consensus
from reachlens.runtime import discard, publish, published
from reachlens.schema import World
from reachlens.sources import text

#: Kinds of messages by the name of the landing folder, and how their lines are read.
LINE_KINDS = {"jfunc": text.parse_jumps, "dlsym": text.parse_lookups, "sign": text.parse_signatures}
#: Kinds whose messages are module files.
MODULE_KINDS = ("deps", "force")


def landed(spark: SparkSession, folder: str, kind: str, whole: bool = False) -> DataFrame:
    """The stream of a kind's lines (or ``whole`` messages), with file and arrival time."""
    lines = spark.readStream.format("text").option("wholetext", whole).load(f"{folder}/{kind}")
    return lines.withColumns({"_file": F.input_file_name(), "_arrived": F.current_timestamp()})


def start(spark: SparkSession, folder: str, kind: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends a kind's parsed rows to a Parquet table, each batch exactly once; reads what is there, then stops."""
    whole = kind in MODULE_KINDS
    parse = (lambda batch: text.parse_modules(batch.withColumn("file", F.col("_file")))) if whole else LINE_KINDS[kind]

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces its own folder
        parse(batch).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return landed(spark, folder, kind, whole).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps every message of all landing folders as it came (kind, value, _file, _arrived), by kind; a folder of another name gives
    the kind ``unknown``, and empty messages aren't kept."""
    named = F.element_at(F.split("_file", "/"), -2)
    kind = F.when(named.isin(*LINE_KINDS, *MODULE_KINDS), named).otherwise("unknown")
    rows = landed(spark, folder, "*", whole=True).filter("value <> ''").withColumn("kind", kind)
    return rows.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table_path)


def stored(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.option("basePath", table_path).parquet(table_path)


def of_kind(messages: DataFrame, kind: str) -> DataFrame:
    """The parsed rows of a kind's captured messages."""
    own = messages.filter(F.col("kind") == kind)
    if kind in MODULE_KINDS:
        return text.parse_modules(own.select(F.col("_file").alias("file"), "value", "_arrived"))
    return LINE_KINDS[kind](own.select(F.explode(F.split("value", "\n")).alias("value"), "_file", "_arrived"))


def world(messages: DataFrame) -> World:
    """The closed world of captured module files, force modules and lookups."""
    return text.world_of(of_kind(messages, "deps").drop("_arrived"), of_kind(messages, "force").drop("_arrived"), of_kind(messages, "dlsym").drop("_file", "_arrived"))


def signatures(messages: DataFrame) -> DataFrame:
    """All that forwards to the signatures of the captured messages: the answer to a unit that asks before it sends its lookups."""
    return closure.signature_closure(of_kind(messages, "sign").select("func", "arg_pos"), of_kind(messages, "jfunc").drop("_file", "_arrived"))


def snapshots(rows: DataFrame, time: str, cuts: list[str]) -> DataFrame:
    """``rows`` with the snapshot they belong to: 1 up to the first cut, then one more after each."""
    number = F.lit(1)
    for cut in cuts:
        number = number + F.when(F.col(time) > F.lit(cut).cast("timestamp"), 1).otherwise(0)
    return rows.withColumn("snapshot", number)


def frozen(messages: DataFrame, cut: str, path: str, hidden_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts with linkid, consensus) of what arrived up to ``cut``, kept below ``path``: evaluated at the first call for a cut only,
    however many messages come afterwards."""
    at = f"{path}/{cut.translate(str.maketrans(' :', 'T-'))}"
    return freeze(messages.sparkSession, lambda: world(messages.filter(F.col("_arrived") <= F.lit(cut).cast("timestamp"))), at, hidden_only)


def freeze(spark: SparkSession, evaluate: Callable[[], World], at: str, hidden_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts with linkid, consensus) of the world that ``evaluate`` gives, published once at ``at``.

    An evaluation writes into an attempt's folder of its own; the manifest, put in place by a rename that never overwrites, names the attempt that counts. Of
    several first readers the first to publish decides, all read its attempt, and the others' are deleted; a failed attempt or a failed
    reading publishes nothing.
    """
    chosen = published(spark, f"{at}/manifest")
    if chosen is None:
        own, attempt = evaluate(), f"attempt-{uuid.uuid4().hex}"
        verdicts = classify.verdicts(own).join(own.modules.select("module_id", "linkid"), "module_id")
        verdicts.write.parquet(f"{at}/{attempt}/verdicts")
        found = spark.read.schema(verdicts.schema).parquet(f"{at}/{attempt}/verdicts")  # written once, for its readers and the consensus
        consensus.consensus(found, consensus.source_totals(own.objects), hidden_only).write.parquet(f"{at}/{attempt}/consensus")
        chosen = publish(spark, f"{at}/manifest", attempt)
        if chosen != attempt:
            verdicts._reachlens_path = f"{at}/{attempt}"
            discard(verdicts)
    return tuple(spark.read.parquet(f"{at}/{chosen}/{part}") for part in ("verdicts", "consensus"))


#: Questions as lines: the kind (E: the verdicts of a module by its link id, S: what a source's links agree on) and the id.
QUESTION = r"^([ES]) ?(\S+)$"


def parse_questions(lines: DataFrame) -> DataFrame:
    """(kind, id) of question lines; lines of another form are no questions."""
    own = lines.filter(F.rlike("value", F.lit(QUESTION)))
    return own.select(F.regexp_extract("value", QUESTION, 1).alias("kind"), F.regexp_extract("value", QUESTION, 2).alias("id"), *text.carried(lines))


def replies(questions: DataFrame, verdicts: DataFrame, agreed: DataFrame) -> DataFrame:
    """(kind, id, class, name, and the questions' carried columns): a row for each verdict of each question; one with a null class for
    a module or source that the snapshot doesn't hold. Questions with a column ``asked`` stand for so many equal ones, and so do their rows."""
    known = verdicts.select(F.lit("E").alias("kind"), F.col("linkid").alias("id"), "class", "name").unionByName(agreed.select(F.lit("S").alias("kind"), F.col("srcid").alias("id"), "class", "name"))
    return questions.join(known, ["kind", "id"], "left")


def answer(spark: SparkSession, folder: str, verdicts: DataFrame, agreed: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Answers the questions that landed in ``folder``/ask out of a frozen snapshot; reads what is there, then stops. A restart goes on after the last
    answered batch, and a batch that is repeated after a failure replaces its own replies, so each question is answered once. Equal questions of
    a batch are answered together: their verdicts are written once, with the questions' number as ``asked``; which files they came in, and when, stands in
    ``table_path``.asked."""

    def reply(batch: DataFrame, number: int) -> None:
        questions = parse_questions(batch)
        questions.write.mode("overwrite").parquet(f"{table_path}.asked/batch={number}")
        alike = questions.groupBy("kind", "id").agg(F.count("*").alias("asked"))
        replies(alike, verdicts, agreed).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return landed(spark, folder, "ask").writeStream.foreachBatch(reply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def module_verdicts(verdicts: DataFrame, linkid: str) -> DataFrame:
    """The point query of a linked module; no rows for one that arrived after the snapshot."""
    return verdicts.filter(F.col("linkid") == linkid)


def source_verdicts(agreed: DataFrame, srcid: str) -> DataFrame:
    """The point query of a source; no rows for an unknown one."""
    return agreed.filter(F.col("srcid") == srcid)
