"""Ids of links and objects: XOR aggregates over 128-bit hex ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.functions.names import hex_halves, hex_of, tail_plus
from reachlens.runtime import discard, materialize


def xor_ids(digits: Column) -> Column:
    """Aggregate: the XOR of 32-digit ids."""
    high, low = hex_halves(digits)
    return hex_of(F.bit_xor(high), F.bit_xor(low))


def link_ids(inputs: DataFrame, key: str = "module_id", ident: str = "srcid") -> DataFrame:
    """(key, linkid): the XOR of a link's input ids; of a single input, one more in the last byte."""
    own = inputs.groupBy(key).agg(xor_ids(F.col(ident)).alias("x"), F.count("*").alias("n"))
    return own.select(key, F.when(F.col("n") == 1, tail_plus(F.col("x"), 1)).otherwise(F.col("x")).alias("linkid"))


def composed_ids(inputs: DataFrame, key: str = "module_id", ident: str = "srcid", made: str = "made_by") -> DataFrame:
    """(key, linkid) where inputs may be outputs of other links: rows have an id of their own, or ``made``, the key of the link that made them.

    Links whose inputs all have ids get theirs, level by level; a round works on the links not done yet. A link with an input that nothing makes, or that
    it makes itself over others, never gets an id and isn't returned.
    """
    left = materialize(inputs.select(F.col(key).alias("_key"), F.col(ident).alias("_id"), F.when(F.col(ident).isNull(), F.col(made)).alias("_made")))
    done = None
    while True:
        whole = left.groupBy("_key").agg(xor_ids(F.col("_id")).alias("x"), F.count("*").alias("n"), F.count_if(F.col("_id").isNull()).alias("open"))
        new = materialize(whole.filter("open = 0").select("_key", F.when(F.col("n") == 1, tail_plus(F.col("x"), 1)).otherwise(F.col("x")).alias("linkid")))
        if new.isEmpty():
            break
        done = new if done is None else done.unionByName(new)
        rest = left.join(new.select("_key"), "_key", "left_anti").join(new.select(F.col("_key").alias("_made"), F.col("linkid").alias("_now")), "_made", "left")
        before, left = left, materialize(rest.select("_key", F.coalesce("_id", "_now").alias("_id"), "_made"))
        discard(before)
    discard(left)
    done = new if done is None else done
    return done.select(F.col("_key").alias(key), "linkid")


def link_ids_in_order(inputs: DataFrame, key: str = "module_id", ident: str = "srcid", order: str = "seq", special: str = "special") -> DataFrame:
    """The same where inputs flagged ``special`` add 42 to the last byte at their place in the order. One link's inputs
    are folded in order; a link is one command line, so its list is bounded by the line's length."""
    own = inputs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, ident, special))).alias("v"), F.count_if(~F.col(special)).alias("n"))
    zero = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("l"))

    def step(acc: Column, x: Column) -> Column:
        high, low = hex_halves(x[ident])
        plus = acc["l"].bitwiseAND(F.lit(-256)).bitwiseOR(F.pmod(acc["l"] + 42, F.lit(256)))
        return F.when(x[special], F.struct(acc["h"].alias("h"), plus.alias("l"))).otherwise(F.struct(acc["h"].bitwiseXOR(high).alias("h"), acc["l"].bitwiseXOR(low).alias("l")))

    folded = own.withColumn("acc", F.aggregate("v", zero, step)).select(key, "n", hex_of(F.col("acc.h"), F.col("acc.l")).alias("x"))
    return folded.select(key, F.when(F.col("n") == 1, tail_plus(F.col("x"), 1)).otherwise(F.col("x")).alias("linkid"))
