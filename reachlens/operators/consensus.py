"""Is a verdict unanimous over all links that hold a source?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.schema import CLASSES


def ranked(verdicts: DataFrame, hidden_only: bool) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")) - 1
    own = verdicts.filter(F.col("srcid").isNotNull() & F.col("class").isin(*CLASSES))
    return own.withColumn("rank", F.lit(2).cast("bigint") if hidden_only else rank)


def consensus(verdicts: DataFrame, totals: DataFrame, hidden_only: bool = True) -> DataFrame:
    """(srcid, name, class, cnt): names judged in every object of their source, with the weakest class of them.

    verdicts: srcid, name, class. totals: srcid, srcid_cnt over all modules. By default all classes count as HIDDEN.
    """
    own = ranked(verdicts, hidden_only).groupBy("srcid", "name").agg(F.count("*").alias("cnt"), F.max("rank").alias("rank"))
    kept = own.join(totals, "srcid").filter("cnt = srcid_cnt")
    return kept.select("srcid", "name", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("rank").cast("int") + 1).alias("class"), "cnt")


def consensus_by_pivot(verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """The same in class mode, by counting each class: a cross-check."""
    own = verdicts.filter(F.col("srcid").isNotNull()).groupBy("srcid", "name").agg(*(F.count_if(F.col("class") == c).alias(c) for c in CLASSES))
    kept = own.join(totals, "srcid").withColumn("cnt", F.col("ELIM") + F.col("LOCAL") + F.col("HIDDEN")).filter("cnt > 0 and cnt = srcid_cnt")
    return kept.select("srcid", "name", F.when(F.col("HIDDEN") > 0, "HIDDEN").when(F.col("LOCAL") > 0, "LOCAL").otherwise("ELIM").alias("class"), "cnt")


def source_totals(objects: DataFrame) -> DataFrame:
    """(srcid, srcid_cnt): objects of each source over all modules, those of kind R and force modules included."""
    return objects.filter("srcid is not null").groupBy("srcid").agg(F.count("*").alias("srcid_cnt"))


def class_counts(found: DataFrame) -> DataFrame:
    """(srcid, n_elim, n_local, n_hidden)."""
    return found.groupBy("srcid").agg(*(F.count_if(F.col("class") == c).alias(f"n_{c.lower()}") for c in CLASSES))
