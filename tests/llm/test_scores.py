"""Language-model scores, token counts, media columns, quality rules and toxicity against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from reachlens.llm import jpeg, linear, lm, media, packing, quality, token_counts, toxicity
from reachlens.llm.text import words_of
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_key(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (2, 2000), (3, 2000), (3, 1 << 20), (4, 9000)])
def test_lm_scores(spark, order, block):
    rows = data.rows()
    got = by_key(lm.score_texts(data.frame(spark), order=order, priors=(7.0, 3.0, 2.0), block_bytes=block))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = collections.Counter()
    for i, text, *_ in rows:
        if not held(i):
            words = [None, *WORD.findall(lower(text)), None]
            for at in range(1, len(words)):
                for k in range(1, min(order, at + 1) + 1):
                    count[tuple(words[at - k + 1 : at + 1])] += 1
    total, size = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def p(word, history):
        if not history:
            return (count[(word,)] + 0.1) / (total + 0.1 * (size + 1))
        below = p(word, history[1:])
        prior = (7, 3, 2)[len(history) - 1]
        return (count[(*history, word)] + prior * below) / (count[history] + prior) if count[history] else below

    for r, (i, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        words = [None, *WORD.findall(lower(text)), None]
        base = sum(math.log10(p(w, ())) for w in words[1:])
        score = sum(math.log10(p(words[k], tuple(words[max(0, k - order + 1) : k]))) for k in range(1, len(words)))
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(words) - 1, sum(count[(w,)] > 0 for w in words[1:]), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


@pytest.mark.parametrize("texts", [[], [None], ["", " \t", "A bé\v\f\r\nÉ \x1f\x1cx\0y  ", "\u00a0 \u2003 z"], ["one"]])
def test_words_are_those_of_the_contract(texts):
    words, sizes = words_of(pa.array(["cut", *texts], pa.string())[1:])
    want = [WORD.findall(lower(t)) for t in texts]
    assert words.to_pylist() == [w for own in want for w in own] and sizes.tolist() == [len(w) for w in want]


def test_lm_states_are_normalized():
    texts = [b"a b a c", b"b a b a", b"c c a b", b"a b a"]
    block = lm.Block([1, 2, 3, 4], pa.array(texts).cast(pa.string()), 3)
    counts = [g.counts for g in block.grams]
    auto = lm.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (9.0, 2.0))
    assert len(auto.fail) > len(counts[0]) + 1 and auto.start
    arcs = collections.defaultdict(dict)
    for k, g in enumerate(block.grams):
        for i in np.flatnonzero(auto.seen[k]):
            arcs[int(auto.source[k][i])][int(g.token[i])] = float(auto.weight[k][i])
    unknown = math.log10(0.1 / (counts[0].sum() + 0.1 * (len(counts[0]) + 1)))

    def weight(state, token):
        if token in arcs[state]:
            return arcs[state][token]
        return auto.fail_weight[state] + weight(int(auto.fail[state]), token) if state else unknown

    for state in range(len(auto.fail)):
        assert math.isclose(sum(10 ** weight(state, token) for token in [*range(len(counts[0])), "unknown"]), 1)


def test_lm_pieces_carry_their_state():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"d"], n)) for n in (0, 1, 2, 255, 256, 257, 511, 1500)]
    block = lm.Block(list(range(1, 9)), pa.array(texts).cast(pa.string()), 3)
    counts = [g.counts for g in block.grams]
    auto = lm.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (9.0, 2.0))
    want = []
    for first, n in zip(block.first.tolist(), block.sizes.tolist(), strict=True):
        state, score = np.array([auto.start]), 0.0
        for at in range(first, first + n):
            score += float(auto.read(state, np.array([at]))[0])
        want.append(score)
    assert np.allclose(lm.traverse(block, auto), want)


def test_empty_tables(spark):
    none = data.frame(spark, [])
    path = public_tokenizers.path("piece_bpe_32k.model")
    for df in (lm.score_texts(none), token_counts.token_counts(none, path), media.text_media(none), quality.quality_rules(none, None), toxicity.toxicity(none, toxicity.fit(none, data.labels(spark)))):
        assert df.count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_key(token_counts.token_counts(data.frame(spark), path, limit=100))
    for r, (i, text, *_) in zip(got, sorted(data.rows(), key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        n = len(sp.encode(text or ""))
        assert tuple(r) == (i, len((text or "").encode()), n, n > 100)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "▁a", "\n a\t b", "<s> </s> <unk>", "ﬁ ① 　x", "é" * 50 + " 😀 12,345.6", "x" * 3000])
def test_token_counts_of_odd_texts(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_texts([text], path) == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))]


def test_shortcut_words_are_single_tokens():
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = sorted(token_counts.prove(path))
    assert len(words) > 10_000 and all(len(x) == 1 for x in token_counts.processor(path).encode(words))


def test_media_round_trip(spark):
    got = by_key(media.text_media(data.frame(spark), with_media=True))
    for r, (i, text, *_) in zip(got, sorted(data.rows(), key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert jpeg.thumbnails([bytes(r.media)])[0][2].tobytes() == padded


def test_media_of_long_texts_are_files_end_to_end(spark):
    """Three files and a bit, beside short texts, with clashing columns."""
    texts = ["x" * 700_000 + "é" * 400_000 + "end", "", "short", "y" * (64 * jpeg.MOST_ROWS), "z" * (64 * jpeg.MOST_ROWS + 1)]
    docs = spark.createDataFrame([(k, t, 7, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media string")
    got = media.text_media(docs, with_media=True).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        payload = media.padded(text.encode())
        (whole,) = jpeg.store([payload])
        ((width, height, thumb),) = jpeg.thumbnails([bytes(row.media)])
        assert bytes(row.media) == whole and thumb.tobytes() == payload and (row.width, row.height) == (width, height)
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.media_sha256 == hashlib.sha256(whole).hexdigest() and row.n_bytes == len(text.encode())
        assert row.tail_crc32 == zlib.crc32(payload[-64:]) and row.feature == f"{width}x{height}:{jpeg.average_hash(thumb)}"


def test_memories_are_bounded_by_characters(monkeypatch):
    """Long and many words: the same counts and ids, and no more remembered than allowed."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [" ".join(f"word{k * j}qz" for k in range(200)) for j in range(1, 20)] + ["漢字かな" * 90 + " tail", "a" * 5000 + " b"]
    want = [len(x) for x in token_counts.processor(path).encode(texts)]
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 3_000)
    token_counts.memory.cache_clear()
    token_counts.held.cache_clear()
    assert [n for x in texts for n in token_counts.count_texts([x], path)] == want and token_counts.count_texts(texts, path) == want
    assert token_counts.held(path)[0] <= 3_000 and max(map(len, set(token_counts.memory(path)) - token_counts.prove(path)), default=0) <= token_counts.LONG
    monkeypatch.setattr(packing, "MEMO_CHARS", 2_000)
    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [own.encode([x])[0].tolist() + [packing.END_ID] for x in texts]
    assert [own.of([x])[0].tolist() for x in texts] == plain and [x.tolist() for x in own.of(texts)] == plain
    assert sum(map(len, own.number)) == own.chars <= 2_000 and len(own.sizes) == len(own.number)


def test_jpeg_files_and_broken_bytes(spark):
    noise = np.random.default_rng(1).integers(0, 256, 64 * 8200, dtype=np.uint8).tobytes()
    file = jpeg.store([noise])[0]
    frame = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"no jpeg")), (4, bytearray(file[:-900])), (5, bytearray())], "k int, data binary")
    got = {r.k: r for r in media.jpeg_columns(frame, "k", "data").collect()}
    assert bytes(got[1].thumbnail) == noise and (got[1].width, got[1].height) == (512, 8 * 8200)
    assert got[2].error is None and got[2].width is None
    assert got[3].error and got[4].error and got[5].error


def encode_blocks(table, symbols):
    """A scan without restart markers, written symbol by symbol: [(code table, symbol, extra bits, their number)]."""
    bits = ""
    for which, symbol, extra, n in symbols:
        code, k = 0, 0
        for size, count in enumerate(table[which][0], 1):
            for _ in range(count):
                if table[which][1][k] == symbol:
                    bits += f"{code:0{size}b}"
                code, k = code + 1, k + 1
            code <<= 1
        bits += f"{extra:0{n}b}" if n else ""
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_jpeg_with_ac_symbols_and_subsampled_colour():
    dc = (jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)
    ac = ((0, 2, 2, *[0] * 13), (0x00, 0x11, 0xF0, 0x23))
    rng, symbols, want, pred = np.random.default_rng(2), [], [], 0
    for _ in range(2):  # two MCUs of 4 luminance blocks and one of each colour
        for block in range(6):
            d = int(rng.integers(-60, 61))
            cat = abs(d).bit_length()
            symbols.append(("dc", cat, d if d >= 0 else d + (1 << cat) - 1, cat))
            symbols += [("ac", 0x11, 1, 1), ("ac", 0xF0, 0, 0), ("ac", 0x23, 5, 3), ("ac", 0x00, 0, 0)]
            if block < 4:
                pred += d
                want.append(pred)
    data_ = encode_blocks({"dc": dc, "ac": ac}, symbols)
    seg = jpeg.segment
    file = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, b"\x08\x00\x10\x00\x1c\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00") + seg(0xC4, b"\x00" + bytes(dc[0]) + bytes(dc[1])) + seg(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1]))
    file += seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + data_ + b"\xff\xd9"
    # the decoder keeps one prediction a part, so colour differences don't touch luminance
    width, height, thumb = jpeg.thumbnails([file])[0]
    grid = np.array(want).reshape(2, 2, 2).transpose(1, 0, 2).reshape(2, 4)
    assert (width, height) == (28, 16) and (thumb == np.clip(grid + 128, 0, 255)).all()


def plain_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(words) < 50 or 100 * len(again) > 50 * len(words))


def test_quality_counts(spark):
    rows = [*data.rows(), (900, "a b c a b c\nx y\nx y\n \n \n#*$%&|<> é", None, None, None)]
    got = by_key(quality.quality_rules(data.frame(spark, rows), None))
    for r, (i, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (i, *plain_rules(text)), text
        assert r.kept == (not r.base_failed) and r.quality_probability is None


def junk_world(spark, n=400):
    import random

    rng = random.Random(5)
    rows, marks = [], []
    for i in range(n):
        text = data.prose(rng, 80)
        if i % 4 == 0:
            text = " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in text.split())
            text += " buy now, click here"
        if i % 5 == 1:
            words = text.split()
            for k in range(0, 80, 20):
                words[k] = rng.choice(["moron", "scumbag", "worthless"])
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(i % 4 != 0), int(i % 5 == 1)))
    return data.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_models_on_held_out_documents(spark):
    docs, labels = junk_world(spark)
    train = labels.filter("doc_id < 250")
    model = quality.fit(docs, train)
    judged = quality.quality_rules(docs, model).join(labels, "doc_id").filter("doc_id >= 250")
    assert judged.filter("kept = (quality = 1)").count() >= 0.97 * judged.count()
    chain = toxicity.fit(docs, train)
    flagged = toxicity.toxicity(docs, chain).join(labels, "doc_id").filter("doc_id >= 250").collect()
    assert sum(r.is_toxic == (r.toxic == 1) for r in flagged) >= 0.97 * len(flagged)
    junk = [(r.p_junk > 0.5) == (r.quality == 0) for r in flagged]
    assert sum(junk) >= 0.9 * len(junk) and any(r.p_toxic_junk > 0.5 for r in flagged if r.toxic and not r.quality)


def test_chain_scores_are_the_sums_of_its_models():
    rng = np.random.default_rng(6)
    words = [f"word{i}".encode() for i in range(40)] + [b"Moron", b"scum!bag"]
    texts = [b" ".join(rng.choice(words, 30)) for _ in range(60)] + [b"", b"MORON scum,bag new"]
    marks = np.array([(b"Moron" in t, i % 3 > 0) for i, t in enumerate(texts[:60])], bool)
    held = [np.unique(np.array([h for w in set(toxicity.words_of(t)) for h in toxicity.hashes(w)], np.uint32)) for t in texts[:60]]
    chain = toxicity.fit_rows(held, marks)
    for text, p in zip(texts, toxicity.chain_scores(texts, chain, "test"), strict=True):
        mine = {chain.index[h] for w in toxicity.words_of(text) for h in toxicity.hashes(w) if h in chain.index}
        before = []
        for k in range(3):
            z = chain.weights[k][-1] + sum(chain.weights[k][f] for f in mine) + sum(q * chain.weights[k][len(chain.index) + j] for j, q in enumerate(before))
            before.append(1 / (1 + math.exp(-z)))
        assert np.allclose(p, before)
    # a fold picks features without looking at the documents it scores
    sample, inside = toxicity.Sample(held), np.arange(60) % 3 > 0
    wanted = np.column_stack([~marks[:, 1], marks[:, 0], marks[:, 0] & ~marks[:, 1]]).astype(float)
    other = wanted.copy()
    other[~inside] = 1 - other[~inside]
    assert (sample.pick(wanted, inside) == sample.pick(other, inside)).all()


def test_samples_take_each_id_once_and_no_long_text(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * (linear.LONGEST + 1)), (3, None), (None, "c"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = linear.labelled_sample(docs, labels, ["quality", "toxic"], 10).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0, "a"), (3, 1, 1, "")]


def test_no_labels_no_model(spark):
    docs, labels = data.frame(spark), data.labels(spark)
    assert quality.fit(docs, labels.limit(0)) is None and toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert toxicity.toxicity(docs, None).filter("is_toxic or p_toxic > 0").count() == 0


def test_the_driver_does_not_fit(spark, monkeypatch):
    """Features are put together and fitted on by a task: the driver's memory holds the weights alone."""
    docs, labels = data.frame(spark, data.rows(120)), data.labels(spark, 120)
    monkeypatch.setattr(quality, "sample_features", lambda *_: pytest.fail("the driver fits"))
    model = quality.fit(docs, labels)
    assert model.weights.shape == (quality.KINDS << quality.BITS,) and model.weights.dtype == np.float32 and model.slope


def test_simple_words_take_no_call_of_the_library(spark, monkeypatch):
    """Words of Latin letters, a mark at their end, and the same on the next line: the merges of their parts give the ids that whole texts have."""
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["and,", "éa.", "es.\nThon", "Ünder!\nöß?", "plain", "ɏé"]
    want = ids.encode(["x " + " ".join(words)])[0][1:].tolist()
    monkeypatch.setattr(ids, "encode", lambda *_: pytest.fail("encoded by the library"))
    flat, starts, sizes = ids.words(words)
    assert [k for lo, n in zip(starts, sizes, strict=True) for k in flat[lo : lo + n].tolist()] == want
