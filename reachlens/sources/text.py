"""Readers of the text formats: module files, dynamic lookups, jump functions, signatures, verdicts, consensus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reachlens import schema
from reachlens.functions.names import strip_version
from reachlens.schema import World


def parse_module(text: str) -> dict:
    """One module file. Counts come before what they count; a symbol's flags may lack the third character."""
    words = iter(text.split())
    take = lambda: next(words)
    number = lambda: int(next(words))
    kind, objects_n, _, name, entry, linkid = take(), number(), number(), take(), take(), take()
    objects, uid = [], 0
    for _ in range(objects_n):
        n, offset, path, srcid = number(), number(), take(), take()
        sections = []
        for _ in range(n):  # a section's number is its place in the file, whatever is written
            used, size, section = number(), number(), take()
            number()
            sections.append({"uid": uid, "used": used != 0, "size": size, "name": section, "deps": [number() for _ in range(number())]})
            uid += 1
        objects.append({"offset": offset, "path": path, "srcid": None if srcid.startswith("-") else srcid, "sections": sections})
    symbols = []
    for i in range(number()):
        flags, uid, symbol = take(), number(), take()
        symbols.append({
            "sym_ix": i, "weak": flags[0], "vis": flags[1], "tls": "T" if flags[2:] == "T" else "_", "def_uid": None if uid < 0 else uid,
            "name": symbol, "revdeps": [number() for _ in range(number())],
        })
    return {"kind": kind, "name": name, "entrypoint": entry, "linkid": linkid, "objects": objects, "symbols": symbols}


def read_modules(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A nested row for each module file, and its path (column file)."""
    return parse_modules(spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def parse_modules(texts: DataFrame) -> DataFrame:
    """A nested row for each text (columns file, value); columns that begin with an underscore come along."""
    ddl = "file string, " + "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in carried(texts)) + schema.MODULE_FILE
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    yield pa.RecordBatch.from_pylist([{**row, **parse_module(row.pop("value"))}], target)
                except (StopIteration, ValueError, IndexError, RuntimeError) as bad:
                    raise ValueError(f"{row['file']} is no module file") from bad

    return texts.select("file", "value", *carried(texts)).mapInArrow(run, ddl)


def carried(lines: DataFrame) -> list[str]:
    """The columns that parsers pass on: those that begin with an underscore (where a line came from, and when)."""
    return [c for c in lines.columns if c.startswith("_")]


def world_of(modules: DataFrame, forces: DataFrame | None = None, lookups: DataFrame | None = None) -> World:
    """The tables of nested module rows; ``forces`` are modules whose sections only serve as roots."""
    named = modules.withColumn("is_force", F.lit(False))
    if forces is not None:
        named = named.unionByName(forces.withColumn("is_force", F.lit(True)))
    # a link id may repeat, so a module is told by its file; the parser numbers its sections and symbols, so equal numbers meet in one list only
    named = named.withColumn("module_id", F.col("file"))
    objects = named.select("module_id", F.posexplode("objects").alias("obj_ix", "o"))
    sections = objects.select("module_id", "obj_ix", F.explode("o.sections").alias("s"))
    symbols = named.select("module_id", F.explode("symbols").alias("y"))
    return World(
        modules=named.select("module_id", "kind", "name", "entrypoint", "linkid", "is_force"),
        objects=objects.select("module_id", "obj_ix", "o.path", "o.offset", "o.srcid"),
        sections=sections.select("module_id", "s.uid", "obj_ix", "s.name", "s.size", "s.used"),
        deps=sections.select("module_id", "s.uid", F.explode(F.array_distinct("s.deps")).alias("to_uid")),
        symbols=symbols.select("module_id", "y.sym_ix", strip_version(F.col("y.name")).alias("name"), "y.weak", "y.vis", "y.tls", "y.def_uid"),
        refs=symbols.select("module_id", "y.sym_ix", F.explode(F.array_distinct("y.revdeps")).alias("uid")),
        lookups=lookups,
    )


def read_lookups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file:line:srcid:section:func:STATUS:sym,sym"""
    return parse_lookups(spark.read.text(paths))


def parse_lookups(lines: DataFrame) -> DataFrame:
    part = F.split(F.col("value"), ":", 7)
    at = lambda i: F.try_element_at(part, F.lit(i))
    names = F.filter(F.split(F.coalesce(at(7), F.lit("")), ","), lambda x: x != "")
    return lines.filter(F.size(part) >= 6).select(at(1).alias("file"), at(2).try_cast("int").alias("line"), at(3).alias("srcid"), at(4).alias("section"), at(5).alias("func"), at(6).alias("status"), names.alias("symbols"), *carried(lines))


def columns_of(lines: DataFrame, count: int) -> Column:
    return F.split(F.trim(F.col("value")), r"\s+", count + 1)


def parse_jumps(lines: DataFrame) -> DataFrame:
    """from_name from_arg to_name to_arg; lines of another form don't count."""
    part = columns_of(lines, 4)
    kept = lines.filter((F.size(part) >= 4) & part[1].try_cast("int").isNotNull() & part[3].try_cast("int").isNotNull())
    return kept.select(part[0].alias("from_name"), part[1].cast("int").alias("from_arg"), part[2].alias("to_name"), part[3].cast("int").alias("to_arg"), *carried(lines))


def parse_signatures(lines: DataFrame) -> DataFrame:
    """name position, with or without a leading count line."""
    part = columns_of(lines, 2)
    return lines.filter((F.size(part) >= 2) & part[1].try_cast("int").isNotNull()).select(part[0].alias("func"), part[1].cast("int").alias("arg_pos"), *carried(lines))


def read_jumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_jumps(spark.read.text(paths))


def read_signatures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_signatures(spark.read.text(paths))


#: sign-<name>=<position>, as a compiler option adds a signature.
OPTION = r"^sign-(.+)=(\d+)$"


def option_signatures(options: DataFrame) -> DataFrame:
    """Signatures in a table of options (column value)."""
    return options.filter(F.rlike("value", F.lit(OPTION))).select(F.regexp_extract("value", OPTION, 1).alias("func"), F.regexp_extract("value", OPTION, 2).cast("int").alias("arg_pos"))


def verdict_blocks(spark: SparkSession, paths: str | list[str], linkid: str | None = None) -> DataFrame:
    """(file, linkid, b: head and lines) of verdict files. Of equal link ids in a file the first block counts; with ``linkid``, only its block."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    # a block begins at a line of four counts and an id; a file's own rows tell which come first, so that no text is dealt out
    whole = whole.select("file", F.filter(F.split("value", r"(?m)(?=^\d+ \d+ \d+ \d+ \S+$)"), lambda x: F.length(F.trim(x)) > 0).alias("blocks"))
    ids = F.transform("blocks", lambda x: F.split(F.substring_index(x, "\n", 1), " ")[4])
    whole = whole.withColumn("ids", ids).withColumn("once", F.size(F.array_distinct("ids")) == F.size("ids"))
    first = F.filter("blocks", lambda x, i: F.array_position("ids", F.get("ids", i)) == i + 1)
    blocks = whole.select("file", F.explode(F.when(F.col("once"), F.col("blocks")).otherwise(first)).alias("block"))
    head = F.split(F.substring_index("block", "\n", 1), " ")
    blocks = blocks.select("file", head[4].alias("linkid"), F.struct(head.alias("head"), F.filter(F.split("block", "\n"), lambda x: x != "").alias("lines")).alias("b"))
    return blocks if linkid is None else blocks.filter(F.col("linkid") == linkid)


def read_verdicts(spark: SparkSession, paths: str | list[str], linkid: str | None = None) -> DataFrame:
    """Rows of verdict files: linkid, class, obj, srcid, srcid_cnt, tls, name; see ``verdict_blocks``."""
    return block_rows(verdict_blocks(spark, paths, linkid))


def block_rows(first: DataFrame) -> DataFrame:
    """The rows of verdict blocks."""
    rows = first.select("linkid", "b.head", F.posexplode("b.lines").alias("i", "line")).filter("i > 0")
    upto = lambda k: sum((F.col("head")[j].cast("int") for j in range(k)), F.lit(0))
    kind = F.when(F.col("i") <= upto(1), "ELIM").when(F.col("i") <= upto(2), "LOCAL").when(F.col("i") <= upto(3), "HIDDEN").otherwise("UNDEF")
    part = F.split("line", ":", 5)
    undefined = part[0] == "-"
    return rows.select("linkid", kind.alias("class"), F.when(~undefined, part[0]).alias("obj"), F.when(~undefined, part[1]).alias("srcid"), F.when(~undefined, part[2].try_cast("bigint")).alias("srcid_cnt"), part[3].alias("tls"), part[4].alias("name"))


def read_consensus(spark: SparkSession, paths: str | list[str], srcid: str | None = None) -> DataFrame:
    """Rows of consensus files: class, obj, srcid, name; with ``srcid``, only that source's."""
    whole = spark.read.text(paths, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"(?m)(?=^\d+ \d+ \d+$)")).alias("block")).filter(F.length(F.trim("block")) > 0)
    head = F.split(F.substring_index("block", "\n", 1), " ")
    rows = blocks.select(head.alias("head"), F.posexplode(F.filter(F.split("block", "\n"), lambda x: x != "")).alias("i", "line")).filter("i > 0")
    low, mid = F.col("head")[0].cast("int"), F.col("head")[0].cast("int") + F.col("head")[1].cast("int")
    part = F.split("line", ":", 3)
    out = rows.select(F.when(F.col("i") <= low, "ELIM").when(F.col("i") <= mid, "LOCAL").otherwise("HIDDEN").alias("class"), part[0].alias("obj"), part[1].alias("srcid"), part[2].alias("name"))
    return out if srcid is None else out.filter(F.col("srcid") == srcid)


def force_module(spark: SparkSession, name: str, names: list[str]) -> DataFrame:
    """A force module: one used section that refers to the names."""
    target = StructType.fromDDL("file string, " + schema.MODULE_FILE)
    symbols = [(i, "U", "d", "_", None, n, [0]) for i, n in enumerate(names)]
    row = (f"force:{name}", "E", name, "_start", "f" * 32, [(0, f"{name}.o", "f" * 32, [(0, True, 0, ".text", [])])], symbols)
    return spark.createDataFrame([row], target)
