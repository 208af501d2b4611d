"""Writers of the text formats: each gives a table of lines or of whole texts (column value), ready for ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.functions.names import alias_of, basename
from reachlens.sources.text import block_rows


def lines(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *(p.cast("string") for p in parts)).alias("value")


#: Blocks in a file, of modules and of sources. Readers take files whole, so a file stays some megabytes however much a task writes.
FILE_BLOCKS, FILE_SOURCES = 256, 4_096


def write_blocks(texts: DataFrame, folder: str, most: int = FILE_BLOCKS) -> None:
    """Write blocks (column value) into files of at most so many."""
    texts.select(block_lines(F.col("value"))).write.option("maxRecordsPerFile", most).text(folder)


def block_lines(text: Column) -> Column:
    """A block of lines as one value of ``write.text``, which ends each value with a newline itself."""
    return F.regexp_replace(text, r"\n\z", "").alias("value")


def jump_lines(jumps: DataFrame) -> DataFrame:
    return jumps.select(lines(*(F.col(c) for c in ("from_name", "from_arg", "to_name", "to_arg"))))


def signature_lines(signatures: DataFrame) -> DataFrame:
    return signatures.select(lines(F.col("func"), F.col("arg_pos")))


def signature_list(signatures: DataFrame) -> DataFrame:
    """Lines, in order: the number of signatures, then one each (a list sent to a compiler)."""
    own = signature_lines(signatures)
    count = own.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("k"), "value")
    return count.unionByName(own.select(F.lit(1).alias("k"), "value")).orderBy("k", "value").select("value")


def lookup_lines(lookups: DataFrame) -> DataFrame:
    return lookups.select(lines(*(F.col(c) for c in ("file", "line", "srcid", "section", "func", "status")), F.array_join("symbols", ","), sep=":"))


def module_texts(modules: DataFrame) -> DataFrame:
    """The module file (column value) of each nested module row."""
    numbers = lambda x: F.concat(F.size(x).cast("string"), F.lit(" "), F.array_join(F.transform(x, lambda d: F.concat(d.cast("string"), F.lit(" "))), ""))
    section = lambda s: F.concat(F.lit("\t"), F.concat_ws("\t", s["used"].cast("int").cast("string"), s["size"].cast("string"), s["name"], s["uid"].cast("string")), F.lit("\n\t\t"), numbers(s["deps"]), F.lit("\n"))
    one = lambda o: F.concat(F.concat_ws("\t", F.size(o["sections"]).cast("string"), o["offset"].cast("string"), o["path"], F.coalesce(o["srcid"], F.lit("-"))), F.lit("\n"), F.array_join(F.transform(o["sections"], section), ""))
    symbol = lambda y: F.concat(y["weak"], y["vis"], y["tls"], F.lit(" "), F.coalesce(y["def_uid"], F.lit(-1)).cast("string"), F.lit("\t"), y["name"], F.lit("\n\t"), numbers(y["revdeps"]), F.lit("\n"))
    total = F.aggregate("objects", F.lit(0), lambda n, o: n + F.size(o["sections"]))
    head = lines(F.col("kind"), F.size("objects"), total, F.col("name"), F.col("entrypoint"), F.col("linkid"))
    return modules.select("linkid", F.concat(head, F.lit("\n"), F.array_join(F.transform("objects", one), ""), F.size("symbols").cast("string"), F.lit("\n"), F.array_join(F.transform("symbols", symbol), "")).alias("value"))


def block(head: Column, classes: list[tuple[str, Column]], closing: str) -> Column:
    return F.concat(head, F.lit("\n"), *(F.concat(F.array_join(rows, ""), F.lit("" if k == len(classes) - 1 and not closing else "\n")) for k, (_, rows) in enumerate(classes)))


def verdict_texts(verdicts: DataFrame, modules: DataFrame) -> DataFrame:
    """A verdict block (column value) for each module that has a verdict; lists are sorted by name. A module's lists are gathered in
    one row, as large as the file's block."""
    row = F.when(F.col("class") == "UNDEF", F.concat(F.lit("-:f:-1:"), "tls", F.lit(":"), "name", F.lit("\n"))).otherwise(
        F.concat(basename(F.col("obj")), F.lit(":"), F.coalesce("srcid", F.lit("-")), F.lit(":"), F.coalesce("srcid_cnt", F.lit(0)).cast("string"), F.lit(":"), "tls", F.lit(":"), "name", F.lit("\n")))
    classes = ("ELIM", "LOCAL", "HIDDEN", "UNDEF")
    lists = verdicts.groupBy("module_id").agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("class") == c, F.struct("name", row.alias("row"))))), lambda x: x["row"]).alias(c) for c in classes))
    judged = modules.filter("kind <> 'R' and not is_force").join(lists, "module_id", "left")
    own = [(c, F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in classes]
    head = F.concat_ws(" ", *(F.size(v).cast("string") for _, v in own), F.col("linkid"))
    return judged.select("module_id", "linkid", block(head, own, "\n").alias("value"))


def consensus_texts(consensus: DataFrame, objects: DataFrame) -> DataFrame:
    """A consensus block (column value) for each source id; empty ones aren't written. A source's names are gathered in one row."""
    name = objects.filter("srcid is not null").groupBy("srcid").agg(F.min_by("path", F.struct("module_id", "obj_ix")).alias("path"))
    classes = ("ELIM", "LOCAL", "HIDDEN")
    row = F.concat(basename(F.col("path")), F.lit(":"), "srcid", F.lit(":"), "name", F.lit("\n"))
    lists = consensus.join(name, "srcid").groupBy("srcid").agg(*(F.sort_array(F.collect_list(F.when(F.col("class") == c, row))).alias(c) for c in classes))
    own = [(c, F.col(c)) for c in classes]
    return lists.select("srcid", block(F.concat_ws(" ", *(F.size(v).cast("string") for _, v in own)), own, "").alias("value"))


#: What the assembly of every module begins with.
ASSEMBLY_HEAD = ('.section .note.GNU-stack,"",%progbits', '.section .__privplug_refs,"e",%progbits')


def hide_assembly(verdicts: DataFrame) -> DataFrame:
    """Assembly lines for every symbol of a module's verdict: hidden, typed if thread-local, an alias if versioned. The module's link id comes
    along, or its number if the rows have none."""
    key = "linkid" if "linkid" in verdicts.columns else "module_id"
    plain, name = alias_of(F.col("name")), F.col("name")
    typed = F.when(F.col("tls") == "T", F.concat(F.lit(".type "), plain, F.lit(" STT_TLS\n"))).otherwise("")
    versioned = F.when(F.contains(name, F.lit("@")), F.concat(F.lit(".symver "), plain, F.lit(","), name, F.lit("\n"))).otherwise("")
    return verdicts.select(key, "name", F.concat(F.lit(".int "), plain, F.lit("-.\n.hidden "), plain, F.lit("\n"), typed, versioned).alias("value"))


def assembly(blocks: DataFrame) -> DataFrame:
    """(linkid, k, value): the assembly of each module of verdict blocks, in the order of k: its two section lines, then its symbols' lines."""
    heads = blocks.select("linkid", F.posexplode(F.array(*map(F.lit, ASSEMBLY_HEAD))).alias("k", "value")).withColumn("name", F.lit(""))
    body = hide_assembly(block_rows(blocks)).select("linkid", F.lit(len(ASSEMBLY_HEAD)).alias("k"), F.regexp_replace("value", r"\n\z", "").alias("value"), "name")
    return heads.unionByName(body).select("linkid", "k", "name", "value")


def reply_assembly(blocks: DataFrame, linkid: str) -> DataFrame:
    """The assembly of one module, its lines in order (column value). The job fails if there is no block of that link id."""
    own = blocks.filter(F.col("linkid") == linkid)
    found = own.agg(F.count("*").alias("n"))
    # an empty aggregate still has a row, whose value can't be had
    check = found.filter("n = 0").select(F.lit(linkid).alias("linkid"), F.lit(-1).alias("k"), F.lit("").alias("name"), F.raise_error(F.concat(F.lit(f"could not find linkid {linkid} in "), "n", F.lit(" blocks"))).cast("string").alias("value"))
    return assembly(own).unionByName(check).orderBy("k", "name").select("value")


def graphviz(edges: DataFrame, label: str) -> DataFrame:
    """The lines of a directed graph in the dot language."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = edges.select(F.lit(1).alias("k"), F.concat(F.lit("\t"), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("value"))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, f'digraph "{label}" {{'), (2, "}")], "k int, value string")
    return ends.unionByName(body).orderBy("k", "value").select("value")
