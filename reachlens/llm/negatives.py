"""Hard negatives by k-means inverted lists with stored radii, visited in the order of Cauchy-Schwarz bounds; exact.

Rows are dealt by a hash of their id into groups of some GROUP_ROWS. A group keeps its rows in inverted lists, one for each k-means centroid,
and each list stores its own centre and radius, so ``centre . anchor + radius * |anchor|`` bounds all its scores from above (and, with a
minus, from below). An anchor visits a group's lists from the largest bound down, skips lists outside its windows of
scores, and stops where the bound falls strictly below the k-th score found. Groups answer on their own and the answers are merged, so no
list, however many rows share a centroid, is one task's work, and a hot centroid only makes longer lists in every group.

Anchors (a stated query set) meet the groups in blocks: (blocks of ANCHOR_BLOCK anchors) x (groups) units of work of bounded memory. The work
is anchors x rows at worst: vectors without structure (the test tables') let nothing be skipped.

Defined results: rows without an id, a label or a vector, and rows with a null or non-finite component or one of LARGEST or more (whose
scores needn't fit 64 bits) take no part; of rows with one id the one with the least label, then vector, does; shorter vectors
count as padded with zeros; equal scores go to the smaller id; an anchor without positives, or a positive without negatives, gives no row.
Only the columns named are read, so further ones can't clash. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachlens.runtime import discard, materialize

#: Rows that the centroids are fitted on at most (those with the smallest hashes of their ids), and centroids at most.
SAMPLE, CENTROIDS, ROUNDS = 16_384, 128, 8
#: Rows of a group, and anchors of a block, on average. Larger groups send fewer answers, smaller ones deal the work finer.
GROUP_ROWS, ANCHOR_BLOCK = 8_192, 4_096
#: Lists between two looks at the k-th score.
AT_ONCE = 8
LARGEST = 16_384
EVERYTHING = 1 << 62

LISTS = "group long, list int, dim int, radius double, centre binary, ids binary, labels binary, vecs binary"
BLOCK = "dim int, ids binary, labels binary, vecs binary, starts binary, lows binary, highs binary"


def quantized(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: components times 256, rounded down."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < LARGEST))  # NaN is larger than all numbers
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vec_col).isNotNull()).filter(fine)
    return whole.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("vec"))


def matrix(column: pa.Array, dim: int | None = None, kind: type = np.int32) -> np.ndarray:
    """Vectors as rows, padded with zeros or cut to ``dim`` (their longest's length by default)."""
    sizes = np.diff(column.offsets.to_numpy())
    dim = int(sizes.max(initial=0)) if dim is None else dim
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    for row, start, size in zip(out, np.cumsum(sizes) - sizes, np.minimum(sizes, dim), strict=True):
        row[:size] = flat[start : start + size]
    return out


def widened(rows: np.ndarray, dim: int) -> np.ndarray:
    return rows if rows.shape[1] == dim else np.pad(rows, ((0, 0), (0, dim - rows.shape[1])))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (rows @ centroids.T), axis=1) if len(rows) else np.zeros(0, int)


def fitted(sample: np.ndarray) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds, as many as the root of its rows."""
    centroids = sample[: max(1, min(CENTROIDS, int(len(sample) ** 0.5)))].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centroids)
        n = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, groups: int) -> DataFrame:
    """Every row with its group and its nearest centroid's list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(matrix(batch.column(3), centroids.shape[1], np.float32), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["group", "vec_id", "label", "vec", "list"])

    dealt = rows.select(F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(groups)).alias("group"), "vec_id", "label", "vec")
    return dealt.mapInArrow(run, "group long, vec_id long, label long, vec array<int>, list int")


def listed(table: pa.Table) -> pa.Table:
    """A group's rows as inverted lists: a row each, with centre and radius."""
    rows, out = matrix(table["vec"].combine_chunks()), {c.split()[0]: [] for c in LISTS.split(", ")}
    own, ids, labels = (table[c].to_numpy() for c in ("list", "vec_id", "label"))
    for k in np.unique(own):
        at = np.flatnonzero(own == k)
        members = rows[at].astype(float)
        centre = members.mean(0)
        radius = float(np.sqrt(((members - centre) ** 2).sum(1).max()))
        for name, v in zip(out, (table["group"][0].as_py(), int(k), rows.shape[1], radius, centre.tobytes(), ids[at].tobytes(), labels[at].tobytes(), rows[at].tobytes()), strict=True):
            out[name].append(v)
    return pa.table({n: pa.array(v, pa.int32() if n in ("list", "dim") else None) for n, v in out.items()})


class Group:
    """A group's lists, side by side."""

    def __init__(self, table: pa.Table, dim: int) -> None:
        col = {c: table[c].to_pylist() for c in ("dim", "radius", "centre", "ids", "labels", "vecs")}
        vecs = [widened(np.frombuffer(v, np.int32).reshape(len(i) // 8, d), dim) for v, i, d in zip(col["vecs"], col["ids"], col["dim"], strict=True)]
        self.rows = np.concatenate(vecs).astype(np.int64)
        self.ends = np.cumsum([len(v) for v in vecs])
        self.ids = np.concatenate([np.frombuffer(x, np.int64) for x in col["ids"]])
        self.labels = np.concatenate([np.frombuffer(x, np.int64) for x in col["labels"]])
        self.centres = np.stack([np.pad(np.frombuffer(c), (0, dim - d)) for c, d in zip(col["centre"], col["dim"], strict=True)])
        self.radii = np.array(col["radius"])
        self.top = int(np.abs(self.rows).max(initial=0))
        self.floats = self.rows.astype(float)
        self.visited = 0

    def bounds(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a list's scores can't be below or above; rounding is allowed for."""
        middle, reach = self.centres @ vec.astype(float), self.radii * np.sqrt(float((vec.astype(float) ** 2).sum()))
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def best(self, vec: np.ndarray, allowed: tuple[int, int, bool], lows: np.ndarray, highs: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first ``most`` rows in each window of scores. allowed: the anchor's id and label, and whether labels must equal it."""
        key, label, same = allowed
        exact = self.top * int(np.abs(vec).max(initial=0)) * max(1, len(vec)) < 1 << 53  # then sums of doubles are whole numbers
        rows, vec_of = (self.floats, vec.astype(float)) if exact else (self.rows, vec.astype(np.int64))
        low, high = self.bounds(vec)
        order = np.argsort(-high, kind="stable")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lows)
        floor = np.asarray(lows, np.int64).copy()  # what a score must reach: the window's end, later the k-th score
        for at in range(0, len(order), AT_ONCE):
            visit = order[at : at + AT_ONCE]
            open_ = high[visit[0]] >= floor
            if not open_.any():
                break
            reach = open_[None, :] & (high[visit, None] >= floor[None, :]) & (low[visit, None] <= highs[None, :])
            visit = visit[reach.any(1)]
            if not len(visit):
                continue
            self.visited += len(visit)
            spans = [slice(self.ends[k - 1] if k else 0, self.ends[k]) for k in visit]
            scores = np.concatenate([rows[s] @ vec_of for s in spans]).astype(np.int64)
            ids, labels = (np.concatenate([x[s] for s in spans]) for x in (self.ids, self.labels))
            fits = (labels == label) & (ids != key) if same else labels != label
            ids, scores = ids[fits], scores[fits]
            for w in np.flatnonzero(open_):
                take = (scores >= floor[w]) & (scores <= highs[w])
                if not take.any():
                    continue
                i, s = np.concatenate([found[w][0], ids[take]]), np.concatenate([found[w][1], scores[take]])
                first = np.lexsort((i, -s))[:most]
                found[w] = i[first], s[first]
                if len(first) == most:
                    floor[w] = max(floor[w], s[first[-1]])
        return found


def packed(table: pa.Table) -> pa.Table:
    """A block of anchors (anchor_id, label, vec, lows, highs) as one row."""
    rows = matrix(table["vec"].combine_chunks())
    lows, highs = (table[c].combine_chunks() for c in ("lows", "highs"))
    flat = {"ids": table["anchor_id"].to_numpy(), "labels": table["label"].to_numpy(), "vecs": rows, "starts": lows.offsets.to_numpy().astype(np.int64) - lows.offsets[0].as_py(), "lows": lows.flatten().to_numpy(), "highs": highs.flatten().to_numpy()}
    return pa.table({"block": table["block"].slice(0, 1), "dim": pa.array([rows.shape[1]], pa.int32()), **{k: pa.array([v.tobytes()]) for k, v in flat.items()}})


def search(lists: DataFrame, groups: int, anchors: DataFrame, blocks: int, same: bool, most: int) -> DataFrame:
    """(anchor_id, slot, found_id, score): the first ``most`` rows of each group in each window of each anchor, to be merged by ``first``.

    anchors: anchor_id, label, vec, and the windows' ends lows and highs.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            (block,) = right.select([c.split()[0] for c in BLOCK.split(", ")]).to_pylist()
            dim = max(block["dim"], max(left["dim"].to_pylist()))
            group = Group(left, dim)
            vecs = widened(np.frombuffer(block["vecs"], np.int32).reshape(-1, block["dim"]) if block["dim"] else np.zeros((len(block["ids"]) // 8, 0), np.int32), dim)
            ids, labels, starts, lows, highs = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels", "starts", "lows", "highs"))
            for k, vec in enumerate(vecs):
                own = slice(starts[k], starts[k + 1])
                for slot, (found, scores) in enumerate(group.best(vec, (ids[k], labels[k], same), lows[own], highs[own], most)):
                    out.append((np.full(len(found), ids[k]), np.full(len(found), slot, np.int32), found, scores))
        return pa.table(dict(zip(("anchor_id", "slot", "found_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "anchor_id"), F.lit(blocks)))
    held = dealt.groupBy("block").applyInArrow(packed, "block long, " + BLOCK).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    spread = lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return spread.groupBy("group", "block").cogroup(held.groupBy("group", "block")).applyInArrow(meet, "anchor_id long, slot int, found_id long, score long")


def first(answers: DataFrame, most: int) -> DataFrame:
    """The groups' answers merged: the first ``most`` of each window, with their rank."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor_when: str, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, vec of whole numbers) where ``anchor_when`` (an SQL condition) holds.

    An anchor's positives are its first rows of the same label by inner product; for each, the first rows of other labels whose scores are
    within ``window`` per cent of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    each = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")
    own = materialize(each)
    found_anchors = own.filter(anchor_when).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    n, n_anchors, dim = own.agg(F.count("*"), F.count_if(F.expr(anchor_when)), F.max(F.size("vec"))).first()
    groups, blocks = max(1, -(-n // GROUP_ROWS)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    sample = own.select("vec").orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(SAMPLE).toArrow()["vec"].combine_chunks()
    centroids = fitted(matrix(sample, dim or 0, np.float32)) if n else np.zeros((1, 0), np.float32)
    lists = materialize(assigned(own, centroids, groups).groupBy("group").applyInArrow(listed, LISTS))

    all_of_it = found_anchors.withColumns({"lows": F.array(F.lit(-EVERYTHING)), "highs": F.array(F.lit(EVERYTHING))})
    near = first(search(lists, groups, all_of_it, blocks, True, positives), positives)
    near = materialize(near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = window
    hundredth = lambda x: F.floor(x / F.lit(100).cast("decimal(3,0)")).cast("long")  # noqa: E731 exact, unlike a division of doubles
    ends = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p")).select(
        "anchor_id", F.transform("p", lambda p: -hundredth(-p["positive_score"] * low)).alias("lows"), F.transform("p", lambda p: hundredth(p["positive_score"] * high)).alias("highs"))
    far = first(search(lists, groups, found_anchors.join(ends, "anchor_id"), blocks, False, negatives), negatives)
    out = materialize(far.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    for done in (own, lists, near):
        discard(done)
    return out


#: The query in SQL, for tables small enough to compare all pairs.
SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.vec, r.vec)::BIGINT AS score FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id)::INT AS rank, n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) <= 10"""
