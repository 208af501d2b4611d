"""The status lattice of lookups: its meet is bitwise OR, so it is an ordinary aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.operators.closure import closure_by_source

#: Fixed values, in the order of their codes 0 to 3.
STATES = ("UNDEFINED", "DYNAMIC", "CONSTANT", "PARTIALLY_CONSTANT")


def state_code(state: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STATES)), state) - 1).cast("int")


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), code + 1)


def meet(code: Column) -> Column:
    """Aggregate: the meet of state codes; of none, UNDEFINED."""
    return F.coalesce(F.bit_or(code), F.lit(0))


def looked_up(lookups: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: the met status and the sorted distinct symbols."""
    named = lookups.withColumn("_c", state_code(F.col("status")))
    return named.groupBy(*keys).agg(state_name(meet(F.col("_c"))).alias("status"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("symbols")))).alias("symbols"))


def unresolved(lookups: DataFrame) -> DataFrame:
    """Call sites whose names aren't all known: they need force modules."""
    return lookups.filter(F.col("status").isin("DYNAMIC", "PARTIALLY_CONSTANT", "UNDEFINED"))


def resolved_facts(sites: DataFrame, flows: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, status, symbol): the distinct values that can flow into each lookup site's argument, a row each however many a site has.

    sites: source, func, arg. flows: func, arg, from_func, from_arg (a caller hands its own argument on). facts: func, arg,
    status, symbol (a caller hands a value over; symbol is null unless the value is constant). Cycles of callers add nothing.
    """
    reached = closure_by_source(sites, flows, ["func", "arg"], ["from_func", "from_arg"])
    return reached.join(facts, ["func", "arg"]).select("source", "status", "symbol").distinct()


def resolved_counts(sites: DataFrame, found: DataFrame) -> DataFrame:
    """(source, status, n_symbols) of each site out of ``resolved_facts``: the meet of its values; a site that no value reaches is UNDEFINED."""
    met = found.groupBy("source").agg(meet(state_code(F.col("status"))).alias("c"), F.count_distinct("symbol").alias("n"))
    every = sites.select("source").distinct().join(met, "source", "left")
    return every.select("source", state_name(F.coalesce("c", F.lit(0))).alias("status"), F.coalesce("n", F.lit(0)).alias("n_symbols"))


def resolve_values(sites: DataFrame, flows: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, status, symbols) of each lookup site, with its symbols as one list: for sites of bounded lists; ``resolved_facts`` has a row for each."""
    found = resolved_facts(sites, flows, facts)
    lists = found.groupBy("source").agg(meet(state_code(F.col("status"))).alias("c"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    every = sites.select("source").distinct().join(lists, "source", "left")
    return every.select("source", state_name(F.coalesce("c", F.lit(0))).alias("status"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))
