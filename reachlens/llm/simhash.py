"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
[23, 12, 7]: its key is the index of the nearest codeword, and its near keys are the nearest codewords of the words one
bit away (at most six: some codeword of radius three holds any word). Of at most four differing bits, pigeonhole
leaves two cases:

- a segment without a differing bit: the fingerprints are equal in it;
- else every segment has one, so two of them have exactly one: there, the near keys of either fingerprint hold the
  key of the other.

So a fingerprint is listed under three segments and three pairs of keys, and looks up the products of its near keys (about
87 rows). The join verifies the distance itself; nothing is left to chance and nothing is capped.

Distinct fingerprints stand for their documents. Before the join, stars join fingerprints to the least, the greatest and one
other of each list where they are close enough; the join then only has to give links between different star components, and a
list that is all of one component isn't looked up by its own fingerprints, so a group of many near copies isn't met pair by pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.llm import memo
from reachlens.llm.components import connected
from reachlens.llm.text import map_texts
from reachlens.runtime import discard, materialize

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0b101011100011
WIDTHS = (22, 21, 21)
PAIRS = tuple(combinations(range(len(WIDTHS)), 2))


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text, unsigned; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], ">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit number."""
    return map_texts(docs, lambda texts: {"fp": np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)}, "fp long", "simhash", id_col, text_col)


@functools.lru_cache(1)
def golay() -> np.ndarray:
    """The index of the nearest codeword for each word of 23 bits."""
    message = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros(1 << 12, np.int64)
    for k in range(12):
        words ^= np.where(message >> k & 1, GENERATOR << k, 0)
    nearest = np.full(1 << 23, -1, np.int16)
    for size in range(4):  # spheres of radius 3 around the codewords fill the space exactly
        for flips in combinations(range(23), size):
            nearest[words ^ sum(1 << b for b in flips)] = message
    return nearest


memo.remembers("simhash", golay.cache_clear)


def segments(fps: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum((0, *WIDTHS[:-1]))
    return [(fps.view(np.uint64) >> np.uint64(lo) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in zip(at.tolist(), WIDTHS, strict=True)]


def listed_keys(fps: np.ndarray) -> np.ndarray:
    """The keys a fingerprint is listed under: fingerprints x 6, the segments themselves first."""
    s = segments(fps)
    key = [golay()[x].astype(np.int64) for x in s]
    return np.column_stack([*((k << 32) | x for k, x in enumerate(s)), *(((3 + k) << 32) | key[a] << 12 | key[b] for k, (a, b) in enumerate(PAIRS))])


def near_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The near keys of segments, end to end; where each one's start; their numbers."""
    around = np.sort(np.column_stack([golay()[segment], *(golay()[segment ^ (1 << b)] for b in range(width))]), axis=1)
    new = np.concatenate([np.ones((len(around), 1), bool), around[:, 1:] != around[:, :-1]], axis=1)
    n = new.sum(1)
    return around[new].astype(np.int64), np.cumsum(n) - n, n


def looked_up_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which fingerprint): all keys that the fingerprints look up."""
    s = segments(fps)
    near, keys, who = [near_keys(x, w) for x, w in zip(s, WIDTHS, strict=True)], [], []
    for k, x in enumerate(s):
        keys.append((k << 32) | x)
        who.append(np.arange(len(fps)))
    for k, (a, b) in enumerate(PAIRS):
        (va, sa, na), (vb, sb, nb) = near[a], near[b]
        n = na * nb
        row = np.repeat(np.arange(len(fps)), n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys.append(((3 + k) << 32) | va[sa[row] + i // nb[row]] << 12 | vb[sb[row] + i % nb[row]])
        who.append(row)
    return np.concatenate(keys), np.concatenate(who)


def keyed(nodes: DataFrame, look_up: bool) -> DataFrame:
    """(key, fp, comp) rows of a (fp, comp) table. Spark takes them for as many as there are fingerprints, of which a look-up makes some 87 rows
    each, so the hint keeps it from sending them through the driver to be broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("simhash")
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                fps, comp = (np.asarray(batch.column(c).slice(lo, 4096)) for c in (0, 1))
                if look_up:
                    keys, who = looked_up_keys(fps)
                else:
                    own = listed_keys(fps)
                    keys, who = own.reshape(-1), np.repeat(np.arange(len(fps)), own.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, fps[who], comp[who])], ["key", "fp", "comp"])

    return nodes.select("fp", "comp").mapInArrow(run, "key long, fp long, comp long").hint("merge")


def near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def links(nodes: DataFrame, close: Column | None = None) -> DataFrame:
    """(lc, rc): components of fingerprints (fp, comp) that link, where one looks up a key that lists the other; no link between components
    is left out, since both ends of one look for each other. ``close``: what verifies a pair (lf, rf), inside the joins.

    A list of one fingerprint is met by all that look its key up. In a longer one the component with the most fingerprints is the main one: what is of that
    component itself meets only the list's others, and what isn't meets all of it, so a dense group in which some strangers are listed doesn't meet itself.
    """
    listed = keyed(nodes, look_up=False)
    sizes = listed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"))
    right = listed.join(sizes, "key").select("key", F.col("fp").alias("rf"), F.col("comp").alias("rc"), "main", "n")
    looked = keyed(nodes, look_up=True).select("key", F.col("fp").alias("lf"), F.col("comp").alias("lc"))
    good = (F.col("lf") < F.col("rf")) & (F.col("lc") != F.col("rc")) & (near("lf", "rf") if close is None else close)

    def met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        left, right = left.alias("l").hint("merge"), right.alias("r").hint("merge")  # what keys were joined to is as much too low
        same = F.lit(True)
        for c in on:
            same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
        return left.join(right, same & good).select("lc", "rc")

    single, many = right.filter("n = 1"), right.filter("n > 1")
    whole, others = many.withColumn("only", F.lit(False)), many.filter("rc <> main").withColumn("only", F.lit(True))
    # a list of one component has nothing for a fingerprint of the same
    some = looked.join(sizes.filter("n > 1"), "key").filter("comps > 1 or lc <> main").select("key", (F.col("lc") == F.col("main")).alias("only"), "lf", "lc")
    return met(looked, single, "key").unionByName(met(some, whole.unionByName(others), "key", "only"))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """(node, root): the fingerprints (distinct, column fp) that have a smaller one in their component, and the smallest."""
    nodes = fps.select("fp", F.col("fp").alias("comp"))
    listed = keyed(nodes, look_up=False).select("key", "fp")
    ends = listed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min_by("fp", F.xxhash64("fp")).alias("mid")).filter("lo < hi")
    held = listed.join(ends, "key").select("fp", F.explode(F.array("lo", "mid", "hi")).alias("to"))
    stars = held.filter(near("fp", "to")).select(F.col("fp").alias("a"), F.col("to").alias("b"))
    first = connected(stars)
    nodes = materialize(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("comp")))
    second = connected(links(nodes).select(F.least("lc", "rc").alias("a"), F.greatest("lc", "rc").alias("b")).distinct())
    discard(first)
    out = nodes.join(second, nodes["comp"] == second["node"], "left").select(F.col("fp").alias("node"), F.coalesce(second["root"], nodes["comp"]).alias("root"))
    return out.filter("node <> root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every document.

    Defined results: a null text is empty; texts without words share the fingerprint 0 and link like any other; rows
    with a null id are fingerprinted, and their ids never name a component (null if there is no other); repeated rows
    repeat; long texts are fingerprinted whole; a bit set in exactly half the hashes is 0; further columns aren't read, so they
    can't clash; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "_id"))
    fps = prints.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = link_fingerprints(fps.select("fp"))
    own = materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = own.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those that link to a document with a smaller id. Rows without an id stay; rows with equal ids go or stay together."""
    gone = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
