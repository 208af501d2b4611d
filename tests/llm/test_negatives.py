"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, group string"


def plain(rows):
    """The query by all pairs: rows (vec_id, embedding, label)."""
    best = {}
    for key, vec, label in rows:
        if key is None or label is None or vec is None or any(x is None or not np.isfinite(x) or abs(x) >= negatives.LARGEST for x in vec):
            continue
        row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in vec])
        best[key] = min(best.get(key, row), row)
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731 the shorter one counts as padded
    for anchor, (label, vec) in best.items():
        if anchor % 100:
            continue
        scored = sorted((-score(vec, v), k, own == label) for k, (own, v) in best.items() if k != anchor)
        for p, positive, _ in [x for x in scored if x[2]][:5]:
            near = [(n, k) for n, k, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(anchor, positive, r, k, -p, -n) for r, (n, k) in enumerate(near, 1)}
    return out


def made(seed, n, dim=8, centres=6):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim))
    rows = []
    for i in range(n):
        v = mid[rng.integers(centres)] + rng.normal(size=dim) * rng.choice([0.05, 0.3])
        rows.append((i * 10, [float(np.float32(x)) for x in v], int(rng.integers(10))))
    for i in range(n // 3):  # a third of all rows are one vector: ties that ids decide
        rows[3 * i] = (rows[3 * i][0], rows[0][1], rows[3 * i][2])
    rows[4], rows[5], rows[6], rows[7], rows[8], rows[9] = (40, None, 1), (50, rows[5][1], None), (60, [None] * dim, 2), (70, [float("nan")] * dim, 3), (80, [1.0] * (dim - 2), 4), (90, [float("inf")] + [0.0] * (dim - 1), 5)
    return rows + [rows[20], (210, rows[22][1], 0), (None, rows[1][1], 1), (-100, rows[11][1], 3), (100_000, [], 2), (100_001, [1e6] * dim, 2)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def found(spark, rows):
    got = negatives.hard_negatives(negatives.quantized(frame(spark, rows).repartition(3)), "vec_id % 100 = 0").collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("size", [None, 30])
def test_against_all_pairs(spark, monkeypatch, size):
    if size:  # many groups and blocks
        monkeypatch.setattr(negatives, "GROUP_ROWS", size)
        monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    rows = made(3, 300)
    random.Random(1).shuffle(rows)
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 300


def test_nothing_and_little(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0], 1), (1, [0.5], 2)]) == set()  # no positive
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == {(0, 1, 1, 2, 65536, 32768)}
    assert found(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.0], 3)]) == set()  # a negative window is empty


def test_bounds_skip_lists():
    """On vectors in tight clusters most lists are never scored, and none that holds an answer is left out."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    mid = np.where(np.eye(16) > 0, 1.0, 0.0) * 200
    rows = np.concatenate([mid[k] + rng.integers(-5, 6, (50, 16)) for k in range(16)]).astype(np.int32)
    table = pa.table({"group": pa.array([0] * 800), "vec_id": pa.array(range(800)), "label": pa.array([k % 3 for k in range(800)]), "vec": pa.array(rows.tolist(), pa.list_(pa.int32())), "list": pa.array([k // 50 for k in range(800)], pa.int32())})
    group = negatives.Group(negatives.listed(table), 16)
    scores = rows.astype(np.int64) @ rows[3].astype(np.int64)
    want = [k for k in np.lexsort((np.arange(800), -scores)) if k % 3 == 0 and k != 3][:5]
    ((ids, got),) = group.best(rows[3], (3, 0, True), np.array([-negatives.EVERYTHING]), np.array([negatives.EVERYTHING]), 5)
    assert ids.tolist() == want and got.tolist() == scores[want].tolist()
    assert group.visited <= negatives.AT_ONCE < len(group.ends)


def test_sums_beyond_doubles(spark):
    rows = [(0, [16000.0] * 64, 1), (1, [16000.0] * 64, 1), (2, [8000.0] * 63 + [8000.01], 2), (3, [8000.0] * 64, 2)]
    assert found(spark, rows) == plain(rows)
