"""Set-semantics closures as semi-naive loops of joins: only what is new goes on, and cycles end by themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reachlens.runtime import PACKED, SMALL_ROWS, discard, packed, shared_dir

#: Rows from which a round's unchanging side is kept bucketed by the join key, so that rounds shuffle the frontier alone.
BUCKET_ROWS, BUCKETS = 20_000_000, 256


@contextmanager
def kept_by(table: DataFrame, keys: list[str], at_least: int = 0) -> Iterator[DataFrame]:
    """``table`` written once for many joins on ``keys``, bucketed by them if it is large; gone afterwards. at_least: rows that it is known to have; a table that
    is known to be large is bucketed as it is worked out, others once their rows were counted."""
    spark, met, plain = table.sparkSession, Observation(), None
    large = at_least >= BUCKET_ROWS
    if not large:
        plain = packed(table.observe(met, F.count(F.lit(1)).alias("rows")))
        large = met.get.get("rows", 0) >= BUCKET_ROWS
    name = f"reachlens_{uuid.uuid4().hex}" if large else None
    if name:
        (table if plain is None else plain).write.options(**PACKED).bucketBy(BUCKETS, *keys).sortBy(*keys).saveAsTable(name)
    try:
        yield spark.table(name) if name else plain
    finally:
        if name:
            spark.sql(f"DROP TABLE {name}")
        if plain is not None:
            discard(plain)


@contextmanager
def dropped(spark: SparkSession, name: str) -> Iterator[None]:
    """The table ``name``, if there is one by then, is gone afterwards."""
    try:
        yield
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def deal(rows: DataFrame, keys: list[str], name: str) -> None:
    """Adds ``rows`` to the table ``name``, which has as many buckets by ``keys`` as shuffles have partitions: one file a bucket, and joins on ``keys`` shuffle the other side alone."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, *keys).write.options(**PACKED).mode("append").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    rows.sparkSession.catalog.refreshTable(name)


def typed(keys: list[str], to: list[str], steps: DataFrame) -> list:
    """The seeds' columns in the types of what the steps lead to, so that all rounds' files have one schema."""
    return [F.col(k).cast(steps.schema[t].dataType).alias(k) for k, t in zip(keys, to, strict=True)]


def closure(steps: DataFrame, seeds: DataFrame, keys: list[str], to: list[str], at_least: int = 0) -> DataFrame:
    """All key tuples (columns ``keys``) that ``seeds`` reach over ``steps``, whose columns ``to`` name the next tuple. Seeds count. at_least: see ``kept_by``.

    Each round joins the frontier with ``steps``, drops what was seen, and writes the rest into the shared folder; the
    driver sees one count a round.
    """
    edge_keys = [f"_k{i}" for i in range(len(keys))]
    edges = steps.select(*(F.col(k).alias(e) for k, e in zip(keys, edge_keys, strict=True)), *(F.col(t).alias(k) for t, k in zip(to, keys, strict=True)))
    first = seeds.select(*typed(keys, to, steps)).dropna().distinct()

    def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
        met = frontier.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)))
        return edges.join(met, [met[f"_f{i}"] == edges[e] for i, e in enumerate(edge_keys)]).select(*keys).dropna()

    return rounds(first, edges, edge_keys, step, at_least=at_least)


def rounds(first: DataFrame, edges: DataFrame, edge_keys: list[str], step: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame | None = None, at_least: int = 0) -> DataFrame:
    """``first`` and all that repeated steps give, without what is ``known`` (from which nothing is followed; it counts among what was seen); each round's new rows are a folder of their own in the shared folder, which
    ``runtime.discard`` of the result deletes.

    While the frontier and what was seen are small enough to be broadcast, a round neither shuffles the edges nor what was seen: only the new
    rows meet to be told apart. Beyond that, edges are bucketed (``kept_by``), and what a round leads to is written first: if it is small, it is
    broadcast to what was seen, which isn't shuffled then; else it alone is shuffled, to what was seen in buckets (``deal``), where each row comes once.
    """
    spark, keys = first.sparkSession, first.columns
    root, paths, total, aside = f"{shared_dir(spark)}/reachlens-{uuid.uuid4().hex}", [], 0, None
    past, dealt = f"reachlens_{uuid.uuid4().hex}", 0  # what was seen in buckets, and the number of rounds that are in it
    read = lambda p: spark.read.schema(first.schema).parquet(*p)
    held = None if known is None else packed(known.select(*first.columns))
    old = [] if held is None else [held._reachlens_path]
    total = 0 if held is None else held.count()
    with kept_by(edges, edge_keys, at_least) as kept, dropped(spark, past):
        new = first if held is None else first.join(held, first.columns, "left_anti")
        while True:
            path, met = f"{root}/{len(paths)}", Observation()
            new.observe(met, F.count(F.lit(1)).alias("rows")).write.options(**PACKED).parquet(path)
            n = met.get.get("rows", 0)  # counted while writing: no job of its own
            if aside is not None:
                discard(aside)
                aside = None
            if paths and not n:
                if held is not None:
                    discard(held)
                out = read(paths)
                out._reachlens_path = root
                return out
            paths, total = [*paths, path], total + n
            frontier, seen = read(paths[-1:]), read(old + paths)
            led = step(F.broadcast(frontier) if n <= SMALL_ROWS else frontier, kept)
            if total <= SMALL_ROWS:
                new = led.join(F.broadcast(seen), first.columns, "left_anti").distinct()
            else:
                count = Observation()
                aside = packed(led.distinct().observe(count, F.count(F.lit(1)).alias("rows")))
                if count.get.get("rows", 0) <= SMALL_ROWS:
                    new = aside.join(F.broadcast(seen.join(F.broadcast(aside), keys, "left_semi")), keys, "left_anti")
                else:
                    deal(read((old + paths)[dealt:]), keys, past)
                    dealt = len(old + paths)
                    new = aside.join(spark.table(past), keys, "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, at_least: int = 0) -> DataFrame:
    """The nodes (column node) that ``seeds`` (node) reach over ``edges`` (src, dst), of which there are ``at_least`` so many."""
    return closure(edges.select(F.col("src").alias("node"), "dst"), seeds, ["node"], ["dst"], at_least)


def reach_more(known: DataFrame, edges: DataFrame, new_edges: DataFrame, new_seeds: DataFrame, at_least: int = 0) -> DataFrame:
    """The nodes that are reached after edges and seeds were added to a graph whose reached nodes are ``known``; those aren't among the result.

    Edges only add nodes, so the first frontier is what the new seeds are and what new edges from known nodes lead to; from there on it is followed over
    all ``edges`` (the new ones included), and known nodes end the search. The work is the new edges and what becomes reached. at_least: the edges that there are known to be.
    """
    entered = new_edges.join(known, new_edges["src"] == known["node"], "left_semi").select(F.col("dst").alias("node"))
    first = packed(new_seeds.select("node").unionByName(entered).dropna().distinct())
    kept = edges.select(F.col("src").alias("_k0"), F.col("dst").alias("node"))

    def step(frontier: DataFrame, kept: DataFrame) -> DataFrame:
        met = frontier.select(F.col("node").alias("_f0"))
        return kept.join(met, F.col("_f0") == F.col("_k0")).select("node")

    out = rounds(first, kept, ["_k0"], step, known, at_least)
    discard(first)
    return out


def signature_closure(base: DataFrame, jumps: DataFrame) -> DataFrame:
    """Base signatures (func, arg_pos) and all functions whose arguments jump functions forward to them."""
    steps = jumps.select(F.col("to_name").alias("func"), F.col("to_arg").alias("arg_pos"), "from_name", "from_arg")
    return closure(steps, base, ["func", "arg_pos"], ["from_name", "from_arg"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) by forward and backward reachability: component is the smallest node of the strong component.

    Colours: each node's smallest ancestor goes forward until nothing changes; nodes that reach their colour's node
    backwards within the colour are its component and leave; the rest goes on. Nodes without a cycle leave first.
    """
    edges = live = packed(edges.select("src", "dst"))  # read for the nodes too; equal edges are told apart among those that are left
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    found = None
    while True:
        # nodes without an edge in or out are alone
        while True:
            kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = packed(kept)
            same = kept.count() == live.count()
            live = kept
            if same:
                break
        if live.isEmpty():
            break
        live = packed(live.distinct())
        colour = packed(live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            offered = live.join(colour, live["src"] == colour["node"]).groupBy("dst").agg(F.min("colour").alias("c"))
            new = packed(colour.join(offered, colour["node"] == offered["dst"], "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("changed")))
            changed = not new.filter("changed").isEmpty()
            colour = new.select("node", "colour")
            if not changed:
                break
        source, target = colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inside = live.join(source, "src").join(target, "dst").filter("cs = cd")
        back = closure(inside.select(F.col("dst").alias("node"), "cs", F.col("src").alias("to"), F.col("cs").alias("to_c")), colour.filter("node = colour").select("node", F.col("colour").alias("cs")), ["node", "cs"], ["to", "to_c"])
        done = back.select("node", F.col("cs").alias("component"))
        found = packed(done if found is None else found.unionByName(done))
        left = done.select("node")
        live = packed(live.join(left, live["src"] == left["node"], "left_anti").join(left, live["dst"] == left["node"], "left_anti"))
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def closure_by_source(sources: DataFrame, steps: DataFrame, keys: list[str], to: list[str]) -> DataFrame:
    """(source, keys): what each source reaches, itself included. sources: source and ``keys``; steps: ``keys`` and ``to``.

    One loop for all sources: the source goes along with each tuple, and the steps don't know it.
    """
    edges = steps.select(*keys, *(F.col(t).alias(f"_to{i}") for i, t in enumerate(to))).dropna()
    first = sources.select("source", *typed(keys, to, steps)).dropna().distinct()
    onward = ["source", *(F.col(f"_to{i}").alias(k) for i, k in enumerate(keys))]
    return rounds(first, edges, keys, lambda frontier, edges: frontier.join(edges, keys).select(*onward))


def followed(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """The ``steps`` (_k, _to) that a search from ``seeds`` (node) can ever follow by where they begin: at a seed, or where a step leads to. Mostly the smaller part, which each round goes through."""
    heads = steps.select(F.col("_to").alias("_k")).unionByName(seeds.select(F.col("node").alias("_k"))).distinct()
    return steps.join(heads, "_k", "left_semi")


#: Sources that go along in one row of ``reach_masks``: the bits of a long.
MASK_BITS = 64


def reach_masks(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each of many sources reaches over ``edges`` (src, dst), as masks: (source, block, bit) and (node, block, mask), where a row of a node and a block of 64
    sources has the bits of those that reach it. A node and block may have several rows, each with other bits. sources: source, node.

    Semi-naive over bits: a round's rows are nodes with the bits that are new there, so there are at most nodes times blocks of them, whatever
    number of sources meet in a node. Sources are numbered in their order, as neighbours often reach the same. As in ``rounds``, beyond a million rows what a
    round leads to is written first: of what was seen only its nodes are dealt then, or it meets what was seen in buckets, where each row comes once.
    """
    spark = edges.sparkSession
    given = packed(sources.select("source", *typed(["node"], ["dst"], edges)).dropna().distinct())
    numbered = given.select("source").distinct().sort("source").withColumn("_n", F.monotonically_increasing_id())
    bits = packed(numbered.select("source", F.shiftright("_n", 6).alias("block"), (F.col("_n") % MASK_BITS).cast("int").alias("bit")))
    root, paths, total, aside = f"{shared_dir(spark)}/reachlens-{uuid.uuid4().hex}", [], 0, None
    past, dealt, keys = f"reachlens_{uuid.uuid4().hex}", 0, ["node", "block"]  # what was seen in buckets, and the number of rounds that are in it
    new = given.join(bits, "source").groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    schema, steps = new.schema, packed(edges.select(F.col("src").alias("_k"), F.col("dst").alias("_to")).dropna())
    read = lambda p: spark.read.schema(schema).parquet(*p)
    with kept_by(followed(steps, given.select("node")), ["_k"]) as kept, dropped(spark, past):
        discard(steps)
        while True:
            path, met = f"{root}/{len(paths)}", Observation()
            new.observe(met, F.count(F.lit(1)).alias("rows")).write.options(**PACKED).parquet(path)
            n = met.get.get("rows", 0)
            if aside is not None:
                discard(aside)
                aside = None
            if paths and not n:
                break
            paths, total = [*paths, path], total + n
            frontier = read(paths[-1:])
            led = kept.join(F.broadcast(frontier) if n <= SMALL_ROWS else frontier, F.col("_k") == F.col("node")).select(F.col("_to").alias("node"), "block", "mask")
            led, seen = led.groupBy(*keys).agg(F.bit_or("mask").alias("come")), read(paths)
            if total > SMALL_ROWS:
                count = Observation()
                aside = led = packed(led.observe(count, F.count(F.lit(1)).alias("rows")))
                if count.get.get("rows", 0) <= SMALL_ROWS:
                    seen = seen.join(F.broadcast(led.select(*keys)), keys, "left_semi")
                else:
                    deal(read(paths[dealt:]), keys, past)
                    dealt, seen = len(paths), spark.table(past).hint("merge")
            seen = seen.groupBy(*keys).agg(F.bit_or("mask").alias("seen"))
            new = led.join(seen, keys, "left").select(*keys, F.col("come").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint")))).alias("mask")).filter("mask <> 0")
    discard(given)
    found = spark.read.schema(schema).parquet(*paths)
    found._reachlens_path = root
    return bits, found


def retained_weight(edges: DataFrame, sources: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, weight): the summed weights (node, weight) of all nodes that each source reaches, itself included. sources: node, and
    source if one has several; the rows in between are the nodes reached times blocks of 64 sources (``reach_masks``)."""
    named = sources if "source" in sources.columns else sources.withColumn("source", F.col("node"))
    bits, found = reach_masks(edges, named)
    # nodes that the same sources reach are summed before the masks come apart
    alike = found.join(weights, "node").groupBy("block", "mask").agg(F.sum("weight").alias("weight"))
    single = alike.select("block", "weight", "mask", F.explode(F.sequence(F.lit(0), F.lit(MASK_BITS - 1))).alias("bit")).filter("getbit(mask, bit) = 1")
    return single.groupBy("block", "bit").agg(F.sum("weight").alias("weight")).join(bits, ["block", "bit"]).select("source", "weight")
