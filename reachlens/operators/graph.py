"""The dependency graph of a closed world, contracted to sections and names.

Nodes are strings: ``s/<module>/<uid>`` and ``n/<name>``. A name node stands for all undefined symbols of that name, so
undefined symbols and exporting definitions meet in it and are never multiplied out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlens.functions.names import TABLE_PREFIXES, edge_section, is_text
from reachlens.runtime import if_small, packed
from reachlens.schema import World


def section_node(module: str | Column, uid: str | Column) -> Column:
    return F.concat_ws("/", F.lit("s"), *(c if isinstance(c, Column) else F.col(c) for c in (module, uid)))


def name_node(name: str | Column) -> Column:
    return F.concat(F.lit("n/"), name if isinstance(name, Column) else F.col(name))


def exporting(symbols: DataFrame) -> DataFrame:
    """Definitions that other modules can see."""
    return symbols.filter("weak <> 'U' and vis <> 'h'")


def undefined_names(symbols: DataFrame) -> DataFrame:
    return symbols.filter("weak = 'U'").select("name").distinct()


def exporters(symbols: DataFrame) -> DataFrame:
    """(name, module_id, uid): every exporting definition of every undefined name."""
    return undefined_names(symbols).join(exporting(symbols), "name").select("name", "module_id", F.col("def_uid").alias("uid"))


def lookup_targets(world: World) -> DataFrame:
    """(module_id, uid, name): what the sections of every copy of a source look up by name; the status doesn't matter."""
    named = world.sections.join(world.objects, ["module_id", "obj_ix"]).select("module_id", "uid", "srcid", F.col("name").alias("section"))
    asked = world.lookups.select("srcid", "section", F.explode("symbols").alias("name"))
    return named.join(asked, ["srcid", "section"]).select("module_id", "uid", "name").distinct()


def edge_symbol_sections(world: World) -> DataFrame:
    """(module_id, sym_ix, uid): the sections named X of the module for undefined ``__start_X`` and ``__stop_X``."""
    asked = world.symbols.filter("weak = 'U'").select("module_id", "sym_ix", edge_section(F.col("name")).alias("name")).filter("name is not null")
    asked = if_small(packed(asked))
    return asked.join(world.sections, ["module_id", "name"]).select("module_id", "sym_ix", "uid")


def table_sections(sections: DataFrame, most: int = 2) -> DataFrame:
    """(module_id, uid, to_uid): of the exception tables of each text section in its object the last ``most``."""
    # an equi-join on the text section's name: a table's name without its beginning is that, or that without its first five letters
    text = sections.select("module_id", "obj_ix", "uid", "name").filter(is_text(F.col("name")))
    rest = F.coalesce(*(F.when(F.startswith("name", F.lit(p)), F.substring("name", F.lit(len(p) + 1), F.length("name"))) for p in TABLE_PREFIXES))
    table = sections.select("module_id", "obj_ix", F.col("uid").alias("to_uid"), rest.alias("rest")).filter("rest is not null")
    table = if_small(packed(table.select("module_id", "obj_ix", "to_uid", F.explode(F.array("rest", F.concat(F.lit(".text"), "rest"))).alias("name"))))
    met = text.join(table, ["module_id", "obj_ix", "name"])
    last = Window.partitionBy("module_id", "uid").orderBy(F.desc("to_uid"))
    return met.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= most).select("module_id", "uid", "to_uid")


def resolved_symbols(world: World) -> DataFrame:
    """Symbols, with undefined ``__start_X``/``__stop_X`` that have sections turned into hidden common ones."""
    found = if_small(packed(edge_symbol_sections(world).select("module_id", "sym_ix").distinct().withColumn("_x", F.lit(True))))
    out = world.symbols.join(found, ["module_id", "sym_ix"], "left")
    return out.withColumns({"weak": F.when(F.col("_x"), "C").otherwise(F.col("weak")), "vis": F.when(F.col("_x"), "h").otherwise(F.col("vis"))}).drop("_x")


def held_symbols(world: World, symbols: DataFrame) -> DataFrame:
    """(module_id, uid, sym_ix, u_name, def_uid): the references with what their symbols stand for, a section or an undefined name (a definition without a section: neither)."""
    meant = symbols.select("module_id", "sym_ix", F.when(F.col("weak") == "U", F.col("name")).alias("u_name"), "def_uid")
    return world.refs.join(meant, ["module_id", "sym_ix"]).select("module_id", "uid", "sym_ix", "u_name", "def_uid")


def section_edges(world: World, symbols: DataFrame | None = None, once: bool = True, held: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind) of the contracted graph; ``once``: each edge once, which searches don't need. held: ``held_symbols``, if already known."""
    symbols = resolved_symbols(world) if symbols is None else symbols
    held = held_symbols(world, symbols) if held is None else held
    # one join for both kinds
    ends = F.inline(F.filter(F.array(
        F.struct(F.when(F.col("def_uid").isNotNull(), section_node("module_id", "def_uid")).alias("dst"), F.lit("symbol").alias("kind")),
        F.struct(name_node("u_name").alias("dst"), F.lit("undefined").alias("kind"))), lambda e: e["dst"].isNotNull()))
    border = if_small(packed(edge_symbol_sections(world).withColumnRenamed("uid", "to_uid")))
    parts = [
        world.deps.select(section_node("module_id", "uid").alias("src"), section_node("module_id", "to_uid").alias("dst"), F.lit("section").alias("kind")),
        table_sections(world.sections).select(section_node("module_id", "uid").alias("src"), section_node("module_id", "to_uid").alias("dst"), F.lit("table").alias("kind")),
        held.select(section_node("module_id", "uid").alias("src"), ends),
        exporters(symbols).select(name_node("name").alias("src"), section_node("module_id", "uid").alias("dst"), F.lit("export").alias("kind")),
        world.refs.join(border, ["module_id", "sym_ix"]).select(section_node("module_id", "uid").alias("src"), section_node("module_id", "to_uid").alias("dst"), F.lit("startstop").alias("kind")),
    ]
    if world.lookups is not None:
        # a looked-up name needn't be undefined anywhere, so its exporters are joined to the looked-up names as well
        asked = lookup_targets(world)
        parts.append(asked.select(section_node("module_id", "uid").alias("src"), name_node("name").alias("dst"), F.lit("lookup").alias("kind")))
        named = asked.select("name").distinct().join(exporting(symbols), "name")
        parts.append(named.select(name_node("name").alias("src"), section_node("module_id", "def_uid").alias("dst"), F.lit("export").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if once else out


def entry_symbols(world: World, symbols: DataFrame) -> DataFrame:
    """The symbols of each module named like its entry point; of several the last."""
    named = symbols.join(world.modules.select("module_id", F.col("entrypoint").alias("name")), ["module_id", "name"])
    return named.groupBy("module_id").agg(F.max_by(F.struct("sym_ix", "name", "def_uid", "weak"), "sym_ix").alias("e")).select("module_id", "e.*")


def seeds(world: World, symbols: DataFrame) -> DataFrame:
    """The nodes that are needed anyhow: used sections, and what the entry symbols stand for."""
    entry = entry_symbols(world, symbols)
    used = world.sections.filter("used").select(section_node("module_id", "uid").alias("node"))
    return used.unionByName(entry.select(F.when(F.col("def_uid").isNotNull(), section_node("module_id", "def_uid")).when(F.col("weak") == "U", name_node("name")).alias("node"))).dropna().distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in): the number of edges into each node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
