"""Which entry wins, which copy answers, what arguments match: top-1 and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(entries: DataFrame, keys: list[str], rank: str, order: str) -> DataFrame:
    """Of the entries with equal ``keys`` the one with the lowest rank; of ties the first. Its other columns come along as they are."""
    rest = [c for c in entries.columns if c not in keys]
    # the least struct that begins with what decides: each column is dealt once
    best = entries.groupBy(*keys).agg(F.min(F.struct(rank, order, *(c for c in rest if c not in (rank, order)))).alias("_best"))
    return best.select(*keys, *(f"_best.{c}" for c in rest))


def first_modules(modules: DataFrame, order: str = "module_id") -> DataFrame:
    """Of modules with equal link ids the first, and how many there are."""
    own = modules.groupBy("linkid").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return own.select("linkid", order, "copies")


def unclaimed(members: DataFrame, order: str) -> DataFrame:
    """Archive members (path, offset > 0) count once, by the first claim; plain files (offset 0) always."""
    first = Window.partitionBy("path", "offset").orderBy(order)
    return members.withColumn("_k", F.when(F.col("offset") != 0, F.row_number().over(first)).otherwise(1)).filter("_k = 1").drop("_k")


def signature_calls(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Calls (caller, callee, n_args) of signature functions, one row for each position; callers that are signatures
    themselves are left out. ``fits`` tells whether the call has the argument."""
    own = calls.join(signatures.select(F.col("func").alias("caller")).distinct(), "caller", "left_anti")
    met = own.join(signatures.select(F.col("func").alias("callee"), "arg_pos"), "callee")
    return met.select("caller", "callee", "arg_pos", "n_args", (F.col("n_args") > F.col("arg_pos")).alias("fits"))


def address_taken(references: DataFrame, signatures: DataFrame) -> DataFrame:
    """References (user, func, use) that take the address of a signature function."""
    return references.filter("use = 'ADDR'").join(signatures.select("func").distinct(), "func", "left_semi")


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What was asked for and isn't known."""
    return asked.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def kept_packages(packages: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    return packages.join(ignored.select(key).distinct(), key, "left_anti")


def analysed_links(links: DataFrame) -> DataFrame:
    """Links (options array, n_objects) that are neither incremental nor empty."""
    return links.filter(~F.exists("options", lambda o: o.isin("-r", "-i", "--relocatable")) & (F.col("n_objects") > 0))


def stamped(objects: DataFrame, modules: DataFrame) -> DataFrame:
    """Objects made by incremental links carry the link's id as their source id, so ids compose over levels."""
    made = modules.filter("kind = 'R'").select(F.col("name").alias("path"), F.col("linkid").alias("_link")).distinct()
    return objects.join(made, "path", "left").withColumn("srcid", F.coalesce("_link", "srcid")).drop("_link")


def relocation_refs(relocations: DataFrame, symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """(module_id, uid, sym_ix, def_uid): which section refers to which symbol, for named sections; the relocations (module_id, uid,
    sym_ix) of a section to a symbol count once."""
    own = relocations.select("module_id", "uid", "sym_ix").distinct()
    named = sections.filter("name is not null").select("module_id", "uid")
    return own.join(named, ["module_id", "uid"], "left_semi").join(symbols.select("module_id", "sym_ix", "def_uid"), ["module_id", "sym_ix"]).select("module_id", "uid", "sym_ix", "def_uid")


def anchored(symbols: DataFrame) -> DataFrame:
    """Symbols as references see them: a local one (binding LOCAL) isn't listed, its section stands for it. Columns of ``symbols`` and
    ``listed``; a local symbol without a section stands for nothing and goes."""
    local = F.col("binding") == "LOCAL"
    return symbols.withColumn("listed", ~local).filter(F.col("listed") | F.col("def_uid").isNotNull())


def cross_object(refs: DataFrame, symbols: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What references (module_id, uid, sym_ix) become: (module_id, sym_ix, uid) of listed symbols from sections of other objects than
    the defining one (all, if undefined); and (module_id, uid, to_uid), the section edges that local symbols stand for."""
    own = refs.select("module_id", "uid", "sym_ix").distinct().join(anchored(symbols).select("module_id", "sym_ix", "def_uid", "listed"), ["module_id", "sym_ix"])
    place = sections.select("module_id", "uid", "obj_ix")
    own = own.join(place, ["module_id", "uid"]).join(place.select("module_id", F.col("uid").alias("def_uid"), F.col("obj_ix").alias("_def_obj")), ["module_id", "def_uid"], "left")
    listed = own.filter(F.col("listed") & ~F.coalesce(F.col("obj_ix") == F.col("_def_obj"), F.lit(False))).select("module_id", "sym_ix", "uid")
    return listed, own.filter(~F.col("listed")).select("module_id", "uid", F.col("def_uid").alias("to_uid")).distinct()


def jump_functions(calls: DataFrame, params: DataFrame) -> DataFrame:
    """(from_name, from_arg, to_name, to_arg): calls (caller, callee, args: array) that hand a parameter of the caller on.

    params: func, params (array of the names of its parameters).
    """
    given = calls.select("caller", "callee", F.posexplode("args").alias("to_arg", "value"))
    own = params.select(F.col("func").alias("caller"), F.posexplode("params").alias("from_arg", "value"))
    return given.join(own, ["caller", "value"]).select(F.col("caller").alias("from_name"), "from_arg", F.col("callee").alias("to_name"), "to_arg").distinct()
