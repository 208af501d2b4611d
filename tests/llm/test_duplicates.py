"""SimHash, connected components, suffix-array dedup and the exchange helpers against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from reachlens import runtime
from reachlens.llm import components, exchange, simhash, suffix_dedup
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys, close):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if close(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_near_duplicates(spark):
    rows = data.rows()
    got = simhash.near_duplicates(data.frame(spark)).collect()
    assert len(got) == len(rows)
    print_of = {r[0]: plain_fingerprint(r[1]) for r in rows}
    fps = sorted(set(print_of.values()))
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, f in print_of.items():
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    for r in got:
        f = print_of[r.doc_id]
        assert (r.fingerprint, r.component_id) == (f"{f:016x}", first.get(root[f]))
    kept = simhash.keep_first(data.frame(spark).withColumnRenamed("lang", "component_id")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((r[0] for r in rows if r[0] is None or first[root[print_of[r[0]]]] == r[0]), key=str)


def test_no_documents(spark):
    none = data.frame(spark, [])
    assert simhash.near_duplicates(none).count() == suffix_dedup.dedup(none).count() == suffix_dedup.deduped(none).count() == simhash.keep_first(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_keys_meet_within_four_bits(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    fps = np.array([x, y], np.uint64).view(np.int64)
    keys, who = simhash.looked_up_keys(fps)
    assert set(keys[who == 0].tolist()) & set(simhash.listed_keys(fps)[1].tolist())


def test_dense_group_of_near_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = 0x0123456789ABCDEF
    some = {base}
    while len(some) < 300:
        x = rng.choice(sorted(some)[-40:])
        some.add(int(x) ^ (1 << int(rng.integers(0, 20))))
    far = [int(x) for x in rng.integers(0, 2**62, 50)]
    fps = sorted(some | set(far))
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert {r.node: r.root for r in got} == {f: r for f, r in root.items() if r != f}


def test_large_group_of_near_fingerprints(spark):
    rng = np.random.default_rng(5)
    base, some = 0x5A5A_0123_4567_1DEF, set()
    while len(some) < 20_000:
        x = base
        for b in rng.integers(0, 63, 3):
            x ^= 1 << int(b)
        some.add(x)
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in sorted(some | {base})], "fp long"))
    assert got.count() == 20_000 and [r.root for r in got.select("root").distinct().collect()] == [min(some)]


def test_strangers_in_a_dense_group(spark):
    """A large group whose lists hold two strangers that share two segments with it: work stays linear, and what is linked is linked."""
    rng = np.random.default_rng(6)
    base, some = 0x5A5A_0123_4567_1DEF, set()
    while len(some) < 20_000:
        x = base
        for b in rng.integers(0, 63, 3):
            x ^= 1 << int(b)
        some.add(x)
    some.add(base)
    strangers = [base ^ 0x0FFF_F000_0000_0000, base ^ 0x7FF0_F000_0000_0000]  # the upper segment alone differs, by far more than four bits
    nodes = spark.createDataFrame([(x, min(some)) for x in some] + [(x, x) for x in strangers], "fp long, comp long")
    assert simhash.links(nodes, F.lit(True)).count() < 40 * len(some)  # all candidates, verified or not
    near_one = strangers[0] ^ 0b1011
    got = {r.node: r.root for r in simhash.link_fingerprints(nodes.select("fp").unionByName(spark.createDataFrame([(near_one,)], "fp long"))).collect()}
    assert len(got) == 20_000 + 1 and got[max(near_one, strangers[0])] == min(near_one, strangers[0]) and strangers[1] not in got


def test_looked_up_keys_are_not_broadcast(spark):
    fps = np.unique(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 20_000))
    nodes = simhash.materialize(spark.createDataFrame([(int(x), int(x)) for x in fps], "fp long, comp long"))
    plan = simhash.links(nodes)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_many_links(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200)], "a long, b long")
    expected = sorted([(k, 0) for k in range(1, 41)] + [(200, 100)])
    monkeypatch.setattr(runtime, "SMALL_ROWS", 10)
    assert sorted(map(tuple, components.connected(edges).collect())) == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 0}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_dedup(rows, length):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if order(first[raw[k : k + length]]) < order(i):
                mask[k : k + length] = True
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        spans = int((np.diff(mask.astype(int), prepend=0) > 0).sum())
        out.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "length", "anchor"), [(1 << 20, 50, 20), (3000, 50, 20), (3000, 16, 8)])
def test_suffix_dedup(spark, block, length, anchor):
    rows = data.rows()
    got = suffix_dedup.dedup(data.frame(spark), length, anchor, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_dedup([r[:2] for r in rows], length)


def hot_rows(n):
    """Documents with one common line amid surroundings of their own."""
    rng = np.random.default_rng(8)
    own = lambda: rng.bytes(60).hex()
    return [(i, f"{own()} all of them have this long line, and what stands around it is another text in each of them {own()}") for i in range(n)]


@pytest.mark.parametrize(("block", "crowd"), [(1 << 20, 300), (3000, 300), (3000, 0)])
def test_suffix_dedup_of_a_crowded_anchor(spark, block, crowd):
    rows = [r[:2] for r in data.rows()] + [(1000 + i, t) for i, t in hot_rows(60)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block, crowd=crowd)
    assert sorted(map(tuple, got.collect()), key=str) == plain_dedup(rows, 50)


def test_windows_of_a_crowded_anchor_spread():
    rows = hot_rows(500)
    table = pa.table({"_id": pa.array([i for i, _ in rows]), "_text": pa.array([t for _, t in rows])})
    block = suffix_dedup.Block(table, 50, 20)
    top = int(np.argmax(block.loads()))
    assert block.loads()[top] * suffix_dedup.UNIT > 5000  # the edges: distinct windows in each document
    own, key, check, first = block.crowded(np.arange(len(block.anchors)) == top)
    texts = b"".join(t.encode() for _, t in rows)
    windows = [texts[a + k : a + k + 50] for a, n in zip(own.start.tolist(), own.windows.tolist(), strict=True) for k in range(n)]
    place = np.concatenate([suffix_dedup.places(key, check, k, c) for _, k, c in block.hashed(own)])
    assert len(key) == len(set(windows)) == len(set(zip(windows, place.tolist(), strict=True))) > 5000
    sizes = [s.stop - s.start for s in exchange.parts(key, 50)[1]]
    assert len(sizes) == 50 and max(sizes) < 2 * len(key) / 50


def common_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=12, max_size=70), min_size=1, max_size=8), st.sampled_from([8, 12, 19]), st.randoms())
def test_suffix_arrays_and_previous_factors(texts, length, rng):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    texts = [x for x in texts if len(x) >= length]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    docs = np.array([rng.randint(0, 3) for _ in texts], np.uint64)
    windows = np.array([len(x) - length + 1 for x in texts], np.int64)
    starts = np.cumsum([0, *(len(x) for x in texts)])[:-1]
    at, doc = suffix_dedup.ragged(starts, windows), np.repeat(docs, windows)
    if not len(at):
        return
    word = [bytes(raw[a : a + length]) for a in at]
    order, common = suffix_dedup.suffix_array(raw, at, length)
    assert [word[i] for i in order] == sorted(word)
    assert common.tolist() == [0, *(common_prefix(word[i], word[j]) for i, j in zip(order, order[1:], strict=False))]
    factor = suffix_dedup.longest_previous(doc[order], common, 1)  # followed to the end: exact from one byte on
    want = [max((common_prefix(word[i], word[j]) for j in order if doc[j] < doc[i]), default=0) for i in order]
    assert factor.tolist() == want
    earlier = suffix_dedup.found_earlier(raw, starts, windows, docs, length)
    assert earlier.tolist() == [any(doc[j] < doc[i] and word[j] == word[i] for j in range(len(at))) for i in range(len(at))]


def test_suffix_dedup_of_long_repetitive_texts(spark):
    unit = b"all work and no play makes a dull text, "
    long_ = (unit * (3_000_000 // len(unit))).decode()
    rows = [(1, "x" * 400_000 + long_), (2, long_[7:] + "#the end of its own"), (3, "y" + long_[:100] + "z"), (4, "x" * 700_000)]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = [rows[0][1], "#the end of its own", "yz", ""]
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, len(long_) - 7, 100, 700_000]
    assert [got[i].kept_sha256 for i in (1, 2, 3, 4)] == [hashlib.sha256(x.encode()).hexdigest() for x in own]
    assert all(got[i].n_spans == 1 for i in (2, 3, 4))


def test_equal_rows_are_dealt_over_many_blocks(spark):
    rows = spark.createDataFrame([(5, "one text in all rows")] * 4000, "doc_id long, text string").repartition(16)
    sizes = [r["count"] for r in exchange.in_blocks(rows, 64).groupBy("_block").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1500


def test_deduped_documents_keep_their_columns(spark):
    frame = data.frame(spark).withColumnRenamed("lang", "kept")
    got = suffix_dedup.deduped(frame)
    assert got.columns == frame.columns
    rows = {r.doc_id: r for r in got.collect()}
    full = {r[0]: r for r in data.rows()}
    for i, r in rows.items():
        assert r.kept == full[i][2] and r.source == full[i][3] and r.n_chars == len(r.text) and (r.text in (full[i][1] or "") or len(r.text) < len(full[i][1]))
    assert rows[24].text == "" and rows[0].text == full[0][1]  # an empty text stays
    gone = set(full) - set(rows)
    assert gone and all(i % 3 == 0 for i in gone if i is not None)


def test_suffix_dedup_of_texts_without_windows(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "short", "x" * 49])]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=16)
    assert sorted(map(tuple, got.collect()), key=str) == plain_dedup(rows, 50)


def test_rows_with_one_id_are_in_many_blocks(spark):
    own = exchange.in_blocks(spark.createDataFrame([(None, f"text {i}") for i in range(64)], "doc_id long, text string"), 8)
    assert own.select("_block").distinct().count() > 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9))
def test_packed_messages(numbers, buckets):
    keys = np.unique(np.array(numbers, np.uint64))
    assert (exchange.unpack_keys(exchange.pack_keys(keys)) == keys).all()
    cut = exchange.bounds(keys, buckets)
    assert all((int(k) * buckets) >> 64 == b for b in range(buckets) for k in keys[cut[b] : cut[b + 1]])
    filled, parts = exchange.parts(keys, buckets)
    assert [k for s in parts for k in keys[s].tolist()] == keys.tolist() and (np.diff(filled) > 0).all() and len(filled) <= len(keys)
    assert all((int(k) * buckets) >> 64 in (b, b + 1) for b, s in zip(filled.tolist(), parts, strict=True) for k in keys[s])
    small = (keys & np.uint64(0x7FFF_FFFF)).astype(np.int64)
    assert (exchange.unpack_numbers(exchange.pack_numbers(small)) == small).all()
    own, place, n = exchange.distinct(np.array(numbers, np.uint64))
    assert (own[place] == np.array(numbers, np.uint64)).all() and n.sum() == len(numbers)
