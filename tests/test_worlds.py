"""Golden worlds: verdicts, consensus, force roots, lookups, and round trips of the text formats."""

import pytest

from reachlens.operators import classify, consensus
from reachlens.sources import render, text
from tests import worlds as w


def world(spark, tmp_path, files, forces=(), lookups=None):
    for name, body in {**files, **dict(forces)}.items():
        (tmp_path / name).write_text(body)
    read = lambda names: text.read_modules(spark, [str(tmp_path / n) for n in names])
    looked = None
    if lookups:
        (tmp_path / "dlsym").write_text(lookups)
        looked = text.read_lookups(spark, str(tmp_path / "dlsym"))
    return text.world_of(read(files), read(dict(forces)) if forces else None, looked)


def classes(found, modules):
    named = {r.module_id: r.name for r in modules.collect()}
    out = {}
    for r in found.collect():
        out.setdefault(named[r.module_id], {}).setdefault(r["class"], set()).add(r["name"])
    return out


W1 = {"app": {"ELIM": {"dead_fn"}, "LOCAL": {"main"}, "HIDDEN": {"_start"}, "UNDEF": {"api_close"}}, "libx.so": {"ELIM": {"api_close"}, "LOCAL": {"helper"}, "HIDDEN": {"inner"}}}
W2 = {"app": {"ELIM": {"dead_fn"}, "LOCAL": {"main"}, "HIDDEN": {"_start"}}, "libx.so": {"LOCAL": {"helper"}, "HIDDEN": {"inner"}}}


def test_every_class(spark, tmp_path):
    own = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB})
    assert classes(classify.verdicts(own), own.modules) == W1


def test_lookup_keeps_a_name(spark, tmp_path):
    own = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB}, lookups=f"app.c:9:{w.S1}:.text.main:main:CONSTANT:api_close\n")
    assert classes(classify.verdicts(own), own.modules) == W2


def test_force_module_is_a_root_without_verdict(spark, tmp_path):
    own = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB}, forces=[("force-1", w.FORCE)])
    assert classes(classify.verdicts(own), own.modules) == W2


def test_conflicting_classes_take_the_weakest(spark, tmp_path):
    own = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB, "deps-3": w.APP2})
    found = classify.verdicts(own)
    got = classes(found, own.modules)
    assert got["app2"] == {"HIDDEN": {"dead_fn"}, "ELIM": {"main", "_start"}}
    totals = consensus.source_totals(own.objects)
    strict = {(r.srcid, r.name): r["class"] for r in consensus.consensus(found, totals, hidden_only=False).collect()}
    assert {k[1]: v for k, v in strict.items() if k[0] == w.S1} == {"dead_fn": "HIDDEN", "main": "LOCAL", "_start": "HIDDEN"}
    pivot = {(r.srcid, r.name): r["class"] for r in consensus.consensus_by_pivot(found, totals).collect()}
    assert pivot == strict
    assert {r["class"] for r in consensus.consensus(found, totals).collect()} == {"HIDDEN"}


def test_module_file_round_trip(spark, tmp_path):
    (tmp_path / "deps-1").write_text(w.LIB)
    (tmp_path / "deps-2").write_text(w.FORCE)
    read = text.read_modules(spark, [str(tmp_path / "deps-1"), str(tmp_path / "deps-2")])
    for row in render.module_texts(read).collect():
        (tmp_path / "again").write_text(row.value)
        again = text.read_modules(spark, str(tmp_path / "again")).drop("file").collect()
        assert again == read.filter(read.linkid == row.linkid).drop("file").collect()
    assert [y.tls for y in read.filter("name = 'force'").first().symbols] == ["_"]


def test_broken_module_file_is_an_error(spark, tmp_path):
    (tmp_path / "deps-1").write_text(w.LIB[:60])
    with pytest.raises(Exception, match="no module file"):
        text.read_modules(spark, str(tmp_path / "deps-1")).collect()


def test_verdict_and_consensus_files(spark, tmp_path):
    own = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB})
    found = classify.verdicts(own).cache()
    texts = {r.linkid: r.value for r in render.verdict_texts(found, own.modules).collect()}
    assert texts[w.A] == f"1 1 1 1 {w.A}\na.o:{w.S1}:1:_:dead_fn\n\na.o:{w.S1}:1:_:main\n\na.o:{w.S1}:1:_:_start\n\n-:f:-1:_:api_close\n\n"
    assert texts[w.B].startswith(f"1 1 1 0 {w.B}\n")
    (tmp_path / "merged.vis").write_text("".join(texts.values()) + texts[w.A].replace("dead_fn", "again"))
    back = {(r.linkid, r["class"], r.name) for r in text.read_verdicts(spark, str(tmp_path / "merged.vis")).collect()}
    ids = {r.module_id: r.linkid for r in own.modules.collect()}
    assert back == {(ids[r.module_id], r["class"], r.name) for r in found.collect()}
    assert {r.linkid for r in text.read_verdicts(spark, str(tmp_path / "merged.vis"), w.A).collect()} == {w.A}
    agreed = consensus.consensus(found, consensus.source_totals(own.objects), hidden_only=False)
    blocks = {r.srcid: r.value for r in render.consensus_texts(agreed, own.objects).collect()}
    assert blocks[w.S1] == f"1 1 1\na.o:{w.S1}:dead_fn\n\na.o:{w.S1}:main\n\na.o:{w.S1}:_start\n"
    (tmp_path / "gcc").write_text("".join(blocks.values()))
    assert {(r.srcid, r.name, r["class"]) for r in text.read_consensus(spark, str(tmp_path / "gcc")).collect()} == {(r.srcid, r.name, r["class"]) for r in agreed.collect()}


def test_hide_assembly(spark):
    rows = spark.createDataFrame([("m", "plain", "_"), ("m", "f@@V1", "T")], "module_id string, name string, tls string")
    got = {r.name: r.value for r in render.hide_assembly(rows).collect()}
    assert got["plain"] == ".int plain-.\n.hidden plain\n"
    assert got["f@@V1"] == ".int __privplug_f_@V1-.\n.hidden __privplug_f_@V1\n.type __privplug_f_@V1 STT_TLS\n.symver __privplug_f_@V1,f@@V1\n"


def test_start_stop_symbols_hold_their_sections(spark, tmp_path):
    body = w.module("E", "app", "_start", w.A, [("/a.o", w.S1, [(".text", 0, 1, []), ("hooks", 0, 1, []), ("other", 0, 1, [])])],
                    [("Dd_", 0, "_start", []), ("Ud_", -1, "__start_hooks", [0]), ("Dd_", 1, "hook", []), ("Dd_", 2, "lost", [])])
    own = world(spark, tmp_path, {"deps-1": body})
    assert classes(classify.verdicts(own), own.modules)["app"] == {"HIDDEN": {"_start"}, "LOCAL": {"hook"}, "ELIM": {"lost"}}


def test_exception_tables_keep_the_last_two(spark, tmp_path):
    names = [".text.f", ".gcc_except_table.f", ".ARM.extab.text.f", ".ARM.exidx.text.f", ".text.fx", "gap"]
    body = w.module("E", "app", "_start", w.A, [("/a.o", w.S1, [(n, 0, 1, []) for n in names])], [("Dd_", 0, "_start", [])])
    own = world(spark, tmp_path, {"deps-1": body})
    from reachlens.operators import graph

    assert {(r.uid, r.to_uid) for r in graph.table_sections(own.sections).collect()} == {(0, 2), (0, 3)}


def test_order_of_modules_does_not_matter(spark, tmp_path):
    first = world(spark, tmp_path, {"deps-1": w.APP, "deps-2": w.LIB, "deps-3": w.APP2})
    second = world(spark, tmp_path, {"deps-9": w.APP, "deps-5": w.LIB, "deps-4": w.APP2})
    assert classes(classify.verdicts(first), first.modules) == classes(classify.verdicts(second), second.modules)


def test_batch_jobs(spark, tmp_path):
    from reachlens.plans import batch

    for name, body in {"deps-1": w.APP, "deps-2": w.LIB, "jfunc-0": "wrap 1 dlsym 1\n", "base": "dlsym 1\n"}.items():
        (tmp_path / name).write_text(body)
    batch.main(["merge", str(tmp_path / "out"), "--deps", str(tmp_path / "deps-1"), str(tmp_path / "deps-2"), "--class-mode"])
    assert {r.linkid for r in text.read_verdicts(spark, str(tmp_path / "out/merged.vis/*.txt")).collect()} == {w.A, w.B}
    assert {(r.name, r["class"]) for r in text.read_consensus(spark, str(tmp_path / "out/merged.vis.gcc/*.txt"), w.S3).collect()} == {("inner", "HIDDEN")}
    batch.main(["signatures", str(tmp_path / "sign"), "--base", str(tmp_path / "base"), "--jfunc", str(tmp_path / "jfunc-0")])
    assert {tuple(r) for r in text.read_signatures(spark, str(tmp_path / "sign")).collect()} == {("dlsym", 1), ("wrap", 1)}


def test_force_module_from_names(spark, tmp_path):
    (tmp_path / "deps-1").write_text(w.APP)
    (tmp_path / "deps-2").write_text(w.LIB)
    read = text.read_modules(spark, [str(tmp_path / "deps-1"), str(tmp_path / "deps-2")])
    own = text.world_of(read, text.force_module(spark, "mine", ["api_close"]))
    assert classes(classify.verdicts(own), own.modules) == W2


def test_snapshot_is_frozen_at_its_first_reading(spark, tmp_path):
    from pyspark.sql import functions as F

    from reachlens.plans import batch
    from reachlens.streaming import ingest

    land, kept, state, results = (str(tmp_path / x) for x in ("land", "kept", "state", "results"))
    for kind, files in {"deps": {"deps-0": w.APP, "deps-1": w.LIB, "deps-2": ""}, "jfunc": {"jfunc-0": "wrap 1 dlsym 1\n"}, "sign": {"base": "dlsym 1\n"}, "noise": {"noise-0": "what is this"}}.items():
        (tmp_path / "land" / kind).mkdir(parents=True)
        for name, body in files.items():
            (tmp_path / "land" / kind / name).write_text(body)
    ingest.capture(spark, land, kept, state).awaitTermination(120)
    messages = ingest.stored(spark, kept)
    assert sorted(r.kind for r in messages.collect()) == ["deps", "deps", "jfunc", "sign", "unknown"]  # the empty one isn't kept
    cut = str(messages.agg(F.max("_arrived").cast("string").alias("t")).first().t)
    (tmp_path / "land" / "deps" / "deps-3").write_text(w.APP2)
    (tmp_path / "land" / "dlsym").mkdir()
    (tmp_path / "land" / "dlsym" / "dlsym-0").write_text(f"app.c:9:{w.S1}:.text.main:main:CONSTANT:api_close\n")
    ingest.capture(spark, land, kept, state).awaitTermination(120)
    messages = ingest.stored(spark, kept)
    assert messages.count() == 7

    def by_class(found, linkid):
        out = {}
        for r in ingest.module_verdicts(found, linkid).collect():
            out.setdefault(r["class"], set()).add(r.name)
        return out

    first, agreed = ingest.frozen(messages, cut, results, hidden_only=False)
    assert {"app": by_class(first, w.A), "libx.so": by_class(first, w.B)} == W1  # neither the late lookup nor the late module counts
    assert by_class(first, w.C) == {}  # it arrived after the snapshot
    assert {r.name for r in ingest.source_verdicts(agreed, w.S3).collect()} == {"inner"} and ingest.source_verdicts(agreed, "0" * 32).isEmpty()
    again, _ = ingest.frozen(messages.limit(0), cut, results, hidden_only=False)  # read, not evaluated again
    assert sorted(map(repr, again.collect())) == sorted(map(repr, first.collect()))
    later, _ = ingest.frozen(messages, "2999-01-01 00:00:00", results, hidden_only=False)
    assert by_class(later, w.B) == W2["libx.so"] and by_class(later, w.C)
    assert {tuple(r) for r in ingest.signatures(messages).collect()} == {("dlsym", 1), ("wrap", 1)}
    batch.main(["restart", str(tmp_path / "out"), "--captured", kept, "--class-mode"])
    back = {(r.linkid, r["class"], r.name) for r in text.read_verdicts(spark, str(tmp_path / "out/merged.vis/*.txt")).collect()}
    assert back == {(r.linkid, r["class"], r.name) for r in later.collect()}
    assert {tuple(r) for r in text.read_signatures(spark, str(tmp_path / "out/sign")).collect()} == {("dlsym", 1), ("wrap", 1)}


def test_module_stream_keeps_file_and_arrival(spark, tmp_path):
    from reachlens.streaming import ingest

    (tmp_path / "land/deps").mkdir(parents=True)
    (tmp_path / "land/deps/deps-0").write_text(w.LIB)
    ingest.start(spark, str(tmp_path / "land"), "deps", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    row = ingest.stored(spark, str(tmp_path / "out")).first()
    assert row.linkid == w.B and row.file.endswith("deps-0") and row._arrived is not None and len(row.symbols) == 4


def test_a_task_writes_many_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(render, "FILE_BLOCKS", 3)
    blocks = [f"1 0 0 0 {k:032x}\no.o:{k:032x}:1:_:name{k}\n\n\n\n" for k in range(10)]
    render.write_blocks(spark.createDataFrame([(b,) for b in blocks], "value string").coalesce(1), str(tmp_path / "vis"), render.FILE_BLOCKS)
    assert len(list((tmp_path / "vis").glob("*.txt"))) == 4
    back = text.read_verdicts(spark, str(tmp_path / "vis")).collect()
    assert sorted((r.linkid, r["class"], r.name) for r in back) == [(f"{k:032x}", "ELIM", f"name{k}") for k in range(10)]


def test_verdict_files_of_queries_are_small(spark, tmp_path, monkeypatch):
    from reachlens.plans import catalog

    monkeypatch.setattr(catalog, "scratch", lambda spark: str(tmp_path / "vis"))
    monkeypatch.setattr(render.write_blocks, "__defaults__", (7,))
    rows = catalog.queries()["merge_text"](spark, "/root/testdata/sf0.001").count()
    files = [p.read_text() for p in (tmp_path / "vis").glob("*.txt")]
    heads = [sum(1 for x in f.split("\n") if len(x.split(" ")) == 5) for f in files]
    assert rows > 0 and sum(heads) == 10 and max(heads) <= 7


def test_references_of_a_module_file_are_dealt_nowhere(spark, tmp_path):
    symbols = [("Dd_", 0, "one", [1, 1, 2]), ("Ud_", -1, "two", [2, 2])]
    body = w.module("E", "app", "one", w.A, [("/tmp/a.o", w.S1, [(".text.a", 1, 1, [2, 2]), (".text.b", 0, 1, []), (".text.c", 0, 1, [0])])], symbols)
    found = world(spark, tmp_path, {"app": body})
    assert sorted((r.sym_ix, r.uid) for r in found.refs.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert sorted((r.uid, r.to_uid) for r in found.deps.collect()) == [(0, 2), (2, 0)]
    for rows in (found.refs, found.deps):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
