"""Publication of snapshots, answers by a stream, marks that grow with new edges, ids over levels, replies as assembly."""

import random
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reachlens import runtime
from reachlens.operators import classify, closure, fingerprint
from reachlens.sources import render, text
from reachlens.streaming import ingest
from tests import worlds as w


def world(spark, tmp_path, name, *bodies):
    (tmp_path / name).mkdir()
    for k, body in enumerate(bodies):
        (tmp_path / name / f"deps-{k}").write_text(body)
    return text.world_of(text.read_modules(spark, str(tmp_path / name)))


def test_first_to_publish_decides(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    assert runtime.published(spark, path) is None
    assert runtime.publish(spark, path, "one") == "one" and runtime.publish(spark, path, "two é") == "one" and runtime.published(spark, path) == "one"
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["manifest"]


def test_concurrent_first_readings_give_one_result(spark, tmp_path):
    small, large = world(spark, tmp_path, "small", w.APP), world(spark, tmp_path, "large", w.APP, w.LIB)
    ready, got = threading.Barrier(2), {}

    def read(name, own):
        def evaluate():
            ready.wait(60)  # both found nothing published
            return own

        got[name] = ingest.freeze(spark, evaluate, f"{tmp_path}/at", hidden_only=False)

    threads = [threading.Thread(target=read, args=a) for a in (("a", small), ("b", large))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = [sorted(map(repr, got[k][0].collect())) for k in "ab"]
    assert rows[0] == rows[1] and rows[0]
    assert len([x for x in (tmp_path / "at").iterdir() if x.name.startswith("attempt-")]) == 1  # the other's is gone


def test_failures_publish_and_overwrite_nothing(spark, tmp_path):
    def fail():
        raise RuntimeError("no world")

    with pytest.raises(RuntimeError):
        ingest.freeze(spark, fail, f"{tmp_path}/at")
    own = world(spark, tmp_path, "own", w.APP, w.LIB)
    first, _ = ingest.freeze(spark, lambda: own, f"{tmp_path}/at")
    want = sorted(map(repr, first.collect()))
    again, _ = ingest.freeze(spark, fail, f"{tmp_path}/at")  # published: not evaluated
    assert sorted(map(repr, again.collect())) == want
    attempt = runtime.published(spark, f"{tmp_path}/at/manifest")
    (tmp_path / "at" / attempt / "consensus").rename(tmp_path / "away")
    with pytest.raises(PySparkException):  # what was published can't be read: an error, not a second evaluation
        ingest.freeze(spark, lambda: own, f"{tmp_path}/at")
    assert runtime.published(spark, f"{tmp_path}/at/manifest") == attempt


def test_questions_are_answered_once(spark, tmp_path):
    own = world(spark, tmp_path, "own", w.APP, w.LIB)
    verdicts, agreed = ingest.freeze(spark, lambda: own, f"{tmp_path}/at", hidden_only=False)
    (tmp_path / "ask").mkdir()
    ask = lambda name, body: (tmp_path / "ask" / name).write_text(body)
    run = lambda: ingest.answer(spark, str(tmp_path), verdicts, agreed, f"{tmp_path}/replies", f"{tmp_path}/state").awaitTermination(120)
    ask("q0", f"E {w.B}\nS{w.S3}\nwhat\n")
    run()
    ask("q1", f"E {w.C}\n")
    run()
    run()
    rows = {(r.kind, r.id, r["class"], r.name) for r in spark.read.parquet(f"{tmp_path}/replies").collect()}
    assert rows == {("E", w.B, "ELIM", "api_close"), ("E", w.B, "LOCAL", "helper"), ("E", w.B, "HIDDEN", "inner"), ("S", w.S3, "HIDDEN", "inner"), ("E", w.C, None, None)}
    assert spark.read.parquet(f"{tmp_path}/replies").count() == 5


def test_equal_questions_are_answered_together(spark, tmp_path):
    """Equal questions of a batch share their rows, which have their number, whatever files they came in; those of another batch have rows of their own."""
    own = world(spark, tmp_path, "own", w.APP, w.LIB)
    verdicts, agreed = ingest.freeze(spark, lambda: own, f"{tmp_path}/at", hidden_only=False)
    (tmp_path / "ask").mkdir()
    run = lambda: ingest.answer(spark, str(tmp_path), verdicts, agreed, f"{tmp_path}/replies", f"{tmp_path}/state").awaitTermination(120)
    (tmp_path / "ask" / "q0").write_text(f"E {w.B}\nE{w.B}\nE {w.C}\nE {w.B}\n")
    (tmp_path / "ask" / "q1").write_text(f"E {w.C}\n")
    run()
    (tmp_path / "ask" / "q2").write_text(f"E {w.B}\n")
    run()
    rows = sorted((r.batch, r.id, r["class"] or "", r.asked) for r in spark.read.parquet(f"{tmp_path}/replies").collect())
    classes = ("ELIM", "HIDDEN", "LOCAL")
    assert rows == sorted([(k, w.B, c, n) for c in classes for k, n in ((0, 3), (1, 1))] + [(0, w.C, "", 2)])
    came = sorted((r.id, r._file[-2:]) for r in spark.read.parquet(f"{tmp_path}/replies.asked").collect())
    assert came == sorted([(w.B, "q0")] * 3 + [(w.C, "q0"), (w.C, "q1"), (w.B, "q2")])


@pytest.mark.parametrize("seed", [1, 2])
def test_marks_grow_with_new_edges(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(75)})
    table = spark.createDataFrame([(a, b, rng.randrange(3)) for a, b in edges], "src int, dst int, part int")
    seeds = spark.createDataFrame([(0, 0), (1, 0), (7, 2)], "node int, part int")
    known = closure.reach(table.filter("part = 0"), seeds.filter("part = 0").select("node"))
    for part in (1, 2):
        more = closure.reach_more(known, table.filter(f"part <= {part}"), table.filter(f"part = {part}"), seeds.filter(f"part = {part}"))
        assert more.join(known, "node", "left_semi").isEmpty()
        known = known.unionByName(more)
        whole = closure.reach(table.filter(f"part <= {part}"), seeds.filter(f"part <= {part}").select("node"))
        assert sorted(r.node for r in known.collect()) == sorted(r.node for r in whole.collect())


def test_ids_over_levels(spark):
    rows = [("a", "1" * 32, None), ("b", None, "a"), ("b", "2" * 32, None), ("c", None, "b"), ("d", None, "d"), ("e", None, "lost"), ("f", None, "e"), ("f", "3" * 32, None)]
    got = {r.module_id: r.linkid for r in fingerprint.composed_ids(spark.createDataFrame(rows, "module_id string, srcid string, made_by string")).collect()}
    a = "1" * 30 + "12"
    b = f"{int(a, 16) ^ int('2' * 32, 16):032x}"
    assert got == {"a": a, "b": b, "c": b[:30] + f"{(int(b[30:], 16) + 1) % 256:02x}"}


def test_reply_as_assembly(spark, tmp_path):
    own = world(spark, tmp_path, "own", w.APP, w.LIB)
    found = classify.verdicts(own)
    render.verdict_texts(found, own.modules).select(render.block_lines(F.col("value"))).write.text(f"{tmp_path}/vis")
    (tmp_path / "vis" / "more.txt").write_text(f"0 0 0 0 {w.C}\n\n\n\n\n")
    blocks = text.verdict_blocks(spark, f"{tmp_path}/vis/*.txt")
    lines = [r.value for r in render.reply_assembly(blocks, w.B).collect()]
    assert lines[:2] == list(render.ASSEMBLY_HEAD) and lines[2:] == [f".int {n}-.\n.hidden {n}" for n in ("api_close", "helper", "inner")]
    assert [r.value for r in render.reply_assembly(blocks, w.C).collect()] == list(render.ASSEMBLY_HEAD)
    with pytest.raises(PySparkException, match="could not find linkid"):
        render.reply_assembly(blocks, "9" * 32).collect()


def test_snapshots_of_one_reading(spark, monkeypatch):
    from reachlens.plans import catalog, synth

    read = []
    monkeypatch.setattr(synth, "table", lambda spark, at, name, plain=synth.table: read.append(name) or plain(spark, at, name))
    catalog.queries()["verdicts_by_snapshot"](spark, "/root/testdata/sf0.001")
    assert read.count("lineitem") == 1


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_known_nodes_are_dealt_once(spark, monkeypatch, small):
    dealt, plain = [], closure.deal
    monkeypatch.setattr(closure, "SMALL_ROWS", small)
    monkeypatch.setattr(closure, "deal", lambda rows, keys, name: dealt.append(rows.count()) or plain(rows, keys, name))
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(3, 40), (40, 41), (41, 2), (41, 42)], "src long, dst long")
    known = spark.createDataFrame([(k,) for k in range(20)], "node long")
    more = closure.reach_more(known, edges, edges.filter("src = 3 and dst = 40"), known.limit(0))
    assert sorted(r.node for r in more.collect()) == [40, 41, 42]
    assert dealt == ([] if small else [21, 1])  # the last node leads nowhere
