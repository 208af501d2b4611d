"""Packing, mixing, URL filters and the pipeline."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlens.llm import mixing, packing, quality, queries, simhash, suffix_dedup, urls
from tests.llm import data
from tests.llm.test_duplicates import plain_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")


def all_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 0], np.uint32) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_is_whole_and_gapless(spark):
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(data.rows())]
    pieces = packing.pack(data.frame(spark, rows).repartition(3), PATH, with_ids=True).collect()
    ids = dict(enumerate(all_ids([r[1] for r in rows])))
    by_doc, by_sequence, steps = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids == part.tolist() and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) == len(ids[k])
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        n = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert n == own[0].sequence_length <= 1024 and n & (n - 1) == 0
        steps[own[0].step_group] += n
    assert max(steps.values()) == packing.STEP and sum(v != packing.STEP for v in steps.values()) <= 3


@pytest.mark.parametrize("text", ["", "a  b", "a   b", " a", "a ", "x\n\n y", "<|endoftext|> b", "it's 12 !! ?", "　x é\r\n z", "a\u00a0 b \u00a0c", "😀 😀"])
def test_ids_are_the_library_s(text):
    assert packing.ids_of(PATH).of([text])[0].tolist() == all_ids([text])[0].tolist()


def test_ids_of_no_break_spaces_between_spaces():
    texts = ["price \u00a0 \u00a0 per unit", "a \u00a0 \u00a0b", "x \u00a0 \u00a0 \u00a0 \u00a0 y", "a \u00a0 b \u00a0 c", "a \n\u00a0 \u00a0 \n b", "a\u00a0 \u00a0 b"]
    for text in texts:
        assert packing.Ids(PATH).of([text])[0].tolist() == all_ids([text])[0].tolist()
    # new words side by side, that merge when they are learned together
    apart = ["one \u00a0 two", "three \u00a0\u00a0 four", "five \u00a0\n six later words"]
    ids = packing.Ids(PATH)
    flat, _, sizes = ids.words(["\u00a0", "\u00a0\u00a0", "\u00a0", "word"])
    assert len(sizes) == 4 and sizes.sum() == len(flat)
    some = ["word", "\u00e9t\u00e9", "Apples", "x1", "don't", "Zebra", "a", "end."]
    flat, starts, sizes = ids.words(some)
    assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [x[:-1].tolist() for x in all_ids([" " + w for w in some])]
    for some in (apart, texts + apart):
        for mine, whole in zip(packing.Ids(PATH).of(some), all_ids(some), strict=True):
            assert mine.tolist() == whole.tolist()


def test_ids_beyond_what_is_remembered(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 40)
    ids, texts = packing.Ids(PATH), [r[1] or "" for r in data.rows()]
    want = [x.tolist() for x in all_ids(texts)]
    for _ in range(2):
        assert [x.tolist() for lo in range(0, len(texts), 7) for x in ids.of(texts[lo : lo + 7])] == want
    assert len(ids.number) == 40


def test_packer_cuts_and_fills():
    packer, sizes = packing.Packer((4, 8, 16)), [3, 5, 16, 9, 1, 2, 40, 7, 4]
    got = [s for i, n in enumerate(sizes) for s in packer.add(i, n)]
    got += [*packer.round(), *packer.rest()]
    seen = collections.Counter()
    for size, items in got:
        assert size & (size - 1) == 0 and sum(x[2] for x in items) == size
        for doc, start, length in items:
            for k in range(start, start + length):
                seen[doc, k] += 1
    assert seen == {(i, k): 1 for i, n in enumerate(sizes) for k in range(n)}


def test_nothing_to_pack(spark):
    assert packing.pack(data.frame(spark, []), PATH).count() == 0
    assert [r.length for r in packing.pack(data.frame(spark, [(1, None, None, None, None)]), PATH).collect()] == [1]


def oracle(spark, tmp_path, tables, sql, df):
    import duckdb

    con = duckdb.connect()
    for name, t in tables.items():
        t.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))
    return len(want)


def test_mixing_against_sql(spark, tmp_path):
    rng_rows = [*data.rows(120, 9), (4, "a table | of | words", "de", "src9", 1)]
    docs = data.frame(spark, rng_rows)
    assert oracle(spark, tmp_path, {"documents": docs}, mixing.sql(), mixing.digest(mixing.mix(docs))) > 0


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([(s, lang, t, 10 * (i + 1)) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("x", "y", "z") for t in "pq")], "source string, lang string, topic string, n_tokens long").withColumn("factor", F.lit(1.0))
    share = lambda name, values: spark.createDataFrame(list(values.items()), f"{name} string, share double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.3, "z": 0.5}, "topic": {"p": 0.9, "q": 0.1}}
    raked = mixing.rake(cells, {k: share(k, v) for k, v in targets.items()}, rounds=12).collect()
    total = sum(r.n_tokens * r.factor for r in raked)
    for name, want in targets.items():
        for value, s in want.items():
            assert abs(sum(r.n_tokens * r.factor for r in raked if r[name] == value) / total - s) < 1e-5


def test_raking_tells_when_targets_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "p", 10, 1.0), ("b", "y", "q", 10, 1.0)], "source string, lang string, topic string, n_tokens long, factor double")
    targets = {c: spark.createDataFrame(v, f"{c} string, share double") for c, v in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.1), ("y", 0.9)]))}
    with pytest.warns(UserWarning, match="off its target by 80.00%"):
        mixing.rake(cells, targets, rounds=2)


def test_raking_goes_on_until_targets_are_met_or_nothing_changes(spark):
    cells = spark.createDataFrame([(s, lang, "p", 7 * i * i + 3, 1.0) for i, (s, lang) in enumerate((s, lang) for s in "abc" for lang in "xyz")], "source string, lang string, topic string, n_tokens long, factor double")
    raked = mixing.rake(cells, mixing.even_targets(cells, {"source": 0.2, "lang": 0.3})).collect()
    assert max(r.off for r in raked) <= mixing.CLOSE
    contrary = spark.createDataFrame([("a", "x", "p", 10, 1.0), ("b", "y", "q", 10, 1.0)], cells.schema)
    targets = {c: spark.createDataFrame(v, f"{c} string, share double") for c, v in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.1), ("y", 0.9)]))}
    with pytest.warns(UserWarning, match="off its target by 80.00%"):
        assert max(r.off for r in mixing.rake(contrary, targets).collect()) == pytest.approx(0.8)


def test_one_small_cell_does_not_decide_what_stays(spark):
    rows = [(s, lang, t, 1000 * (i + 1), 1.0) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("x", "y", "z") for t in "pq")]
    for more in ([], [("new", "x", "p", 60, 1.0)], [("new", "w", "p", 60, 1.0)]):
        cells = spark.createDataFrame(rows + more, "source string, lang string, topic string, n_tokens long, factor double")
        raked = mixing.rake(cells, mixing.even_targets(cells, mixing.EVEN), rounds=3, keep=0.8)
        top, got = mixing.divisor(raked, 0.8), raked.collect()
        chance = {(r.source, r.lang, r.topic): min(1.0, r.factor / top) for r in got}
        assert abs(sum(r.n_tokens * chance[r.source, r.lang, r.topic] for r in got) / sum(r.n_tokens for r in got) - 0.8) < 1e-6
        assert all(chance[r[:3]] == 1 for r in more)


def test_mixing_keeps_columns_and_repeats(spark):
    docs = data.frame(spark).withColumns({c: F.lit(c) for c in ("weight", "topic", "_mix", "_cell", "_F")})
    assert all(r["_mix"] == "_mix" and r["__mix"].n_tokens >= 0 for r in mixing.mix(docs).collect())
    first, again = (sorted(map(str, mixing.mix(docs).select(*docs.columns).collect())) for _ in range(2))
    assert first == again and 0 < len(first) <= docs.count()
    assert mixing.mix(data.frame(spark, [])).count() == 0


URLS = [
    "http://www.Example.com/en/a", "http://example.com/en/a", "http://x.example.com/en", "http://example.net/es/1", "http://net/fr/2?x=1#y", "http://a.org/p/", "https://m.a.org/p?utm_source=q#t",
    "http://a.org/p?b=2&a=1", "http://www.a.org/p/?a=1&ref=z&b=2", "http://b.org", "no url", "", None, "ftp://c.org?x://y", "http://a.org/p", "http://com", "http://com/", "http://www.www.example.com/en/", "x://", "http://d.org/a b\nc",
]


def test_url_filter_against_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string")
    got = urls.url_filter(pages, urls.crawled_twice(pages), urls.RULES)
    pick = ["page_id", "host", "path", "rule", "verdict"]
    assert oracle(spark, tmp_path, {"pages": pages.select("page_id", "url", "html")}, urls.SQL, got.select(*pick)) == 2 * len(URLS)
    once = spark.createDataFrame([("http://WWW.b.org/#x",)], "u string")
    said = {r.page_id: r.verdict for r in urls.url_filter(pages, once, []).collect()}
    assert {URLS[i % len(URLS)] for i, v in said.items() if v == "block"} == {"http://b.org"}
    assert urls.url_filter(pages.limit(0), once, []).count() == 0 and urls.url_filter(pages, once.limit(0), []).filter("verdict = 'block'").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.createDataFrame([(f"host{i}/p?",) for i in range(3000)], "u string")
    words = urls.bloom(listed, "u", 180)
    h = F.xxhash64("u")
    asked = listed.unionByName(spark.createDataFrame([(f"other{i}/p?",) for i in range(3000)], "u string")).withColumn("_block", urls.block(h, 180)).join(words, "_block", "left")
    hit = F.lit(True)
    for k, m in enumerate(urls.bits(h)):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(m) == m)
    got = asked.filter(hit).select("u").collect()
    assert sum(r.u.startswith("host") for r in got) == 3000 and sum(r.u.startswith("other") for r in got) < 60


def write_world(spark, path):
    rows = [r for r in data.rows(120, 11)]
    docs = data.frame(spark, rows)
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    data.labels(spark, 120).write.parquet(f"{path}/labels.parquet")
    return docs


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = write_world(spark, str(tmp_path))
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        rows = [(r.doc_id, r.text) for r in now.collect()]
        if name == "quality rules":
            judged = quality.quality_rules(docs, quality.fit(docs, data.labels(spark, 120))).collect()
            assert {r[0] for r in rows} == {r.doc_id for r in judged if r.kept}
        elif name == "near duplicates":
            assert set(rows) <= before
            first = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(sorted(before, key=str), "doc_id long, text string")).collect() if r.doc_id is None or r.doc_id == r.component_id}
            assert {r[0] for r in rows} == first
        elif name == "repeated passages":
            want = {w[0]: w for w in plain_dedup(sorted(before, key=str), suffix_dedup.LENGTH)}
            assert {r[0] for r in rows} == {i for i, n, gone, *_ in want.values() if n == 0 or gone < n}
        else:
            assert set(rows) <= before
    pieces = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    ids = collections.defaultdict(int)
    for p in pieces:
        ids[p.doc_id] += p.length
    assert set(ids) == {r.doc_id for r in now.collect()}
    final = pipeline.run(spark, str(tmp_path))
    assert final.columns[:8] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] and final.count() > 0


def test_registry():
    names = list(queries.queries())
    assert names[0] == "pipeline" and sorted(int(n[2:].split("_")[0]) for n in names[1:]) == list(range(1, 14))
