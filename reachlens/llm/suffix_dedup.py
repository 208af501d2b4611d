"""Suffix-array dedup: bytes of a document that a smaller document has too, in a common string of LENGTH bytes or more.

A window is a string of LENGTH bytes. Every window has an anchor, the least hash among its ANCHOR-byte strings, so equal
windows have equal anchors, and neighbouring windows mostly share one: a text falls apart into stretches of windows
with the same anchor. The steps, each a grouping in blocks of documents or in buckets of anchors (see ``exchange``):

1. blocks send their distinct anchors; buckets answer which of them more than one document has;
2. blocks send the stretches with such anchors, each distinct one (by its bytes) once with its smallest document;
3. buckets build the suffix array of their stretches by prefix doubling, cut off at LENGTH bytes, and the common prefixes of
   neighbours in it. From each suffix the nearest one before and the nearest one after it with a smaller document (previous and next
   smaller, PSV and NSV) give its longest previous factor: the longer of the prefixes shared with those two. Buckets answer
   which windows have one of LENGTH bytes;
4. blocks remove what those windows cover. The first document with a window keeps it, all later ones lose it.

The inner stretches of a passage of many documents come once from each block. Those at its edges take in the surroundings, so
they differ in every document though their anchor is the passage's. So anchors with more than CROWD windows in all are crowded:
their windows don't go as stretches to the anchor's bucket, but one by one to buckets of their own hashes (128 bits, not
linear), each distinct one once from each block with the block's smallest document. There the order of the hashes stands for that
of the suffixes, which only has to bring equal windows together, and the same PSV and NSV pass follows.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows with equal ids are never matched with each
other, and lose the same; a null id counts as larger than all others; repeated rows repeat; long texts are worked off CHUNK bytes at a time;
an empty table gives an empty one; further columns aren't read unless carried, under names of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import exchange as ex
from reachlens.llm import memo
from reachlens.llm.text import as_bytes, whole

LENGTH, ANCHOR = 50, 20
#: An odd multiplier for polynomial hashes modulo 2**64 (of anchors, where a collision only costs work), and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Windows hashed at once (arrays of eight times the size stay in the cache).
CHUNK = 1 << 18
#: Bytes of text in a block, about, and buckets a block: what a task holds at once is a multiple of them.
BLOCK_BYTES, SPREAD = 5 << 20, 2
#: Parts of a bucket's range of anchors, which are worked off one after the other: each is a suffix array of its own.
PORTIONS = 16
#: Windows of one anchor that are sorted together at most, and the unit in which blocks count them (rounded up).
CROWD, UNIT = 1 << 16, 64
NO_ID = np.uint64((1 << 64) - 1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(max(n, CHUNK + 1), np.uint64)
        got[1:] = np.uint64(base)
        _powers[base] = got = np.multiply.accumulate(got)
    return got[:n]


memo.remembers("suffix_dedup", _powers.clear)


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def ordered_ids(ids: list) -> np.ndarray:
    """Ids as unsigned numbers in the same order, null last."""
    return np.array([NO_ID if i is None else i + (1 << 63) for i in ids], np.uint64)


@dataclass
class Stretches:
    """Runs of windows with one anchor, in text order: document, first byte in the block, windows, anchor."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray

    def where(self, keep: np.ndarray) -> Stretches:
        return Stretches(*(getattr(self, f)[keep] for f in self.__dataclass_fields__))


def stretches(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Stretches:
    """The stretches of texts that stand end to end in ``raw``; a stretch ends where a chunk does."""
    made = []
    for a in range(0, len(raw) - length + 1, CHUNK):
        part = raw[a : a + CHUNK + length - 1]
        n = len(part) - length + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
        grams = ex.mixed((sums[anchor:] - sums[:-anchor]) * powers(BASE_INVERSE, len(part) + 1)[: len(part) - anchor + 1])
        least = least_in(grams, length - anchor + 1)
        some = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + n - 1, "right") + 1)
        doc = np.repeat(some, np.diff(np.clip(ends[some], a, a + n), prepend=a))
        fits = np.arange(a, a + n) + length <= ends[doc]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new & fits)  # the windows that fit in a document are one run of positions
        count = np.concatenate([[0], np.cumsum(fits)])
        after = np.flatnonzero(new)
        stop = np.append(after, n)[np.searchsorted(after, start, "right")]
        made.append((doc[start], start + a, count[stop] - count[start], least[start]))
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return Stretches(*(np.concatenate(x) for x in zip(*made, strict=True))) if made else Stretches(*(np.zeros(0, k) for k in kinds))


class Block:
    """A block of documents in the order of their ids; a later copy of a text isn't looked at again."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        memo.only("suffix_dedup")
        ids, texts = table.column("_id").to_pylist(), as_bytes(whole(table.column("_text")))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.order = order
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.length = length
        rank = ordered_ids(self.ids)
        seen: dict[bytes, int] = {}
        self.copy = np.zeros(len(ids), bool)  # of a text whose first document has a smaller id
        for i, x in enumerate(self.texts):
            self.copy[i] = rank[seen.setdefault(x, i)] < rank[i]
        del seen, texts
        own = [x for x, c in zip(self.texts, self.copy, strict=True) if not c]
        self.joined, self.ends = b"".join(own), np.cumsum([len(x) for x in own], dtype=np.int64)
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.rank = rank[~self.copy]
        self.found = stretches(self.raw, self.ends, length, anchor)
        self.anchors, self.at, _ = ex.distinct(self.found.anchor)

    def twice(self) -> np.ndarray:
        """Of each anchor: do two documents of the block have it?"""
        many = max(1, len(self.ends))
        pairs = np.unique(self.at * many + self.found.doc)
        return np.bincount(pairs // many, minlength=len(self.anchors)) > 1

    def loads(self) -> np.ndarray:
        """Windows of each anchor in the block, in whole units."""
        return np.bincount(self.at, self.found.windows, len(self.anchors)).astype(np.int64) // UNIT

    def shared(self, flags: np.ndarray) -> tuple[Stretches, np.ndarray, np.ndarray]:
        """The stretches with flagged anchors; the first of each distinct one, by anchor; each one's place among those."""
        own = self.found.where(flags[self.at])
        number: dict[bytes, int] = {}
        size = own.windows + self.length - 1
        place = np.array([number.setdefault(self.joined[a : a + n], len(number)) for a, n in zip(own.start.tolist(), size.tolist(), strict=True)], np.int64)
        del number
        _, one = np.unique(place, return_index=True)  # documents stand in order, so the first has the smallest id
        by_anchor = np.argsort(own.anchor[one], kind="stable")
        to = np.empty(len(one), np.int64)
        to[by_anchor] = np.arange(len(one))
        return own, one[by_anchor], to[place]

    def hashed(self, own: Stretches) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some stretches at a time, and the two hashes of their windows, end to end."""
        for a, b in some_at_a_time(own.windows):
            yield slice(a, b), *window_hashes(self.raw, own.start[a:b], own.windows[a:b], self.length)

    def crowded(self, flags: np.ndarray) -> tuple[Stretches, np.ndarray, np.ndarray, np.ndarray]:
        """The stretches with flagged anchors; of their distinct windows, by key: key, check, smallest document."""
        own, got, held = self.found.where(flags[self.at]), [], 0
        for some, key, check in self.hashed(own):
            got.append(first_windows(key, check, np.repeat(self.rank[own.doc[some]], own.windows[some])))
            held += len(got[-1][0])
            if held > 8 * CHUNK:  # a text of few distinct windows stays as small as they are
                got = [first_windows(*map(np.concatenate, zip(*got, strict=True)))]
                held = len(got[0][0])
        none = (np.zeros(0, np.uint64),) * 3
        return own, *first_windows(*map(np.concatenate, zip(none, *got, strict=True)))


def first_windows(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows by key and check, and the smallest document of each."""
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    return key[new], check[new], doc[new]


def places(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where the windows (key, check) stand among the distinct ones (by key and check), each of which is there."""
    at = np.searchsorted(keys, key)
    while (other := checks[at] != check).any():  # another window with the same key comes first
        at[other] += 1
    return at


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges start .. start + size, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def some_at_a_time(windows: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of stretches with about CHUNK windows each."""
    load = np.cumsum(windows)
    edges = np.unique(np.searchsorted(load, np.arange(0, int(load[-1]) if len(load) else 0, CHUNK), "right").tolist() + [0, len(load)])
    return list(zip(edges.tolist(), edges[1:].tolist()))


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros beyond the end) as a number that sorts as they do."""
    padded, out = np.concatenate([raw, np.zeros(7, np.uint8)]), np.zeros(len(raw), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def window_hashes(raw: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each window of the stretches, end to end: its words, stirred in one after the other."""
    size = windows + length - 1
    word, at = words_at(raw[ragged(starts, size)]), ragged(np.cumsum(size) - size, windows)
    key, check = np.full(len(at), BASE, np.uint64), np.full(len(at), BASE_INVERSE, np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        x = word[at + k]
        key, check = ex.mixed(key + x), ex.mixed((check ^ x) * np.uint64(BASE))
    return key, check


def suffix_array(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start ``at`` by their first ``length`` bytes (ties as they come), and the common prefix of
    each with the one before it, up to ``length``."""

    def ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        run = key[order]
        out = np.empty(len(key), np.uint32)
        out[order] = np.cumsum(np.append(False, run[1:] != run[:-1]) if len(run) else run, dtype=np.uint32)
        return out

    pair = lambda a, b: a.astype(np.uint64) << np.uint64(32) | b
    word = words_at(raw)
    levels = [(8, ranks(word))]  # of the strings of 8, 16, 32 ... bytes from each position on
    while (size := levels[-1][0]) * 2 <= length:
        r = levels[-1][1]
        levels.append((2 * size, ranks(pair(r[:-size], r[size:]))))
    key = pair(levels[-1][1][at], levels[-1][1][at + (length - size)])
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(a), np.int64)
    for size, r in reversed(levels):
        common += np.where((common + size <= length) & (r[np.minimum(a + common, len(r) - 1)] == r[np.minimum(b + common, len(r) - 1)]), size, 0)
    rest = common < length
    apart = word[a[rest] + common[rest]] ^ word[b[rest] + common[rest]]
    common[rest] += sum((apart >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    return order, np.append(0, np.minimum(common, length))[: len(at)]


def smaller_before(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """In suffix order: the prefix that each suffix shares with the nearest one before it that has a smaller document. Once it is
    under ``length`` bytes it isn't followed further."""
    to, shares = np.arange(-1, len(doc) - 1), common.copy()
    held = np.arange(len(doc))
    while True:
        held = held[(shares[held] >= length) & (doc[to[held]] >= doc[held])]  # only the first has none before it, and shares 0
        if not len(held):
            return shares
        on = to[held]  # what stands between an entry and its ``to`` has no smaller document, so both may skip it
        on, shared = to[on], np.minimum(shares[held], shares[on])
        to[held], shares[held] = on, shared


def longest_previous(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix, exact from ``length`` on. doc, common: in suffix order."""
    after = smaller_before(doc[::-1], np.append(0, common[:0:-1]), length)[::-1] if len(doc) else common
    return np.maximum(smaller_before(doc, common, length), after)


def found_earlier(raw: np.ndarray, starts: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of the stretches, end to end: is it in a stretch of a smaller document?"""
    at, own = ragged(starts, windows), np.repeat(doc, windows)
    if not len(at):
        return np.zeros(0, bool)
    by_doc = np.argsort(own, kind="stable")
    order, common = suffix_array(raw, at[by_doc], length)
    out = np.zeros(len(at), bool)
    out[by_doc[order]] = longest_previous(own[by_doc[order]], common, length) >= length
    return out


def hashes_earlier(key: np.ndarray, check: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The same for windows given by their hashes."""
    order = np.lexsort((doc, check, key))
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where((key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1]), length, 0)
    out = np.zeros(len(order), bool)
    out[order] = longest_previous(doc[order], common, length) >= length
    return out


def pack_wide(x: np.ndarray) -> bytes:
    return ex.squeeze(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_wide(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(ex.expand(packed), np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def removed_spans(block: Block, flags: np.ndarray, earlier: np.ndarray, full: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of what goes from the block's own texts. earlier: by window of the distinct shared stretches; known: by
    distinct window of the crowded anchors; do other blocks have it in a smaller document?"""
    own, one, place = block.shared(flags)
    hit = np.zeros(len(block.raw) + 1, bool)
    upto = np.cumsum(own.windows[one]) - own.windows[one]
    for a, b in some_at_a_time(own.windows):
        n, to = own.windows[a:b], place[a:b]
        again = np.repeat(block.rank[own.doc[a:b]] > block.rank[own.doc[one[to]]], n)
        hit[ragged(own.start[a:b], n)[again | earlier[ragged(upto[to], n)]]] = True
    if full.any():
        own, keys, checks, first = block.crowded(full)
        for some, key, check in block.hashed(own):
            at = places(keys, checks, key, check)
            hit[ragged(own.start[some], own.windows[some])[known[at] | (first[at] < np.repeat(block.rank[own.doc[some]], own.windows[some]))]] = True
    start = np.flatnonzero(hit[:-1] & ~np.append(False, hit[:-2])) if len(block.raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(hit[:-1] & ~hit[1:]) + block.length
    doc = np.searchsorted(block.ends, start, "right")
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    last = np.append(new[1:], True) if len(new) else new
    return doc[new], start[new], end[last]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes of the spans."""
    if not spans:
        return text
    return b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that have a byte outside of them."""
    inner = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inner(a):
            a += 1
        while a < b and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 of every whole text; ``with_text`` adds ``kept``, the remaining text
    without cut characters (a character goes only if all its bytes do), and ``spans``, the removed (start, end) bytes;
    ``carry`` names further columns of ``docs`` to come along."""
    if not 8 <= anchor <= length:
        raise ValueError("anchors have 8 bytes or more, and no more than windows")
    blocks = ex.count_blocks(docs, text_col, block_bytes)
    own = ex.in_blocks(docs, blocks, id_col, text_col, carry).repartition(blocks, "_block")
    buckets = SPREAD * blocks
    portion = lambda anchors: ((anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(28) & np.uint64(PORTIONS - 1)).astype(np.uint8)
    deal = lambda df, key: df.repartition(blocks, key).groupBy(key)  # noqa: E731 as many partitions as blocks, whatever the session's setting

    def ask_anchors(table: pa.Table) -> pa.Table:
        number, block = table.column("_block")[0].as_py(), Block(table, length, anchor)
        (filled, parts), twice, loads = ex.parts(block.anchors, buckets), block.twice(), block.loads()
        cols = ([ex.pack_keys(block.anchors[s]) for s in parts], [np.packbits(twice[s]).tobytes() for s in parts], [ex.pack_numbers(loads[s]) for s in parts])
        return pa.table([pa.array(filled, pa.int32()), pa.array([number] * len(filled), pa.int32()), *(pa.array(x, pa.binary()) for x in cols)], ["_bucket", "_block", "keys", "twice", "loads"])

    def tell_shared(batch: pa.Table) -> pa.Table:
        keys = [ex.unpack_keys(x) for x in batch.column("keys").to_pylist()]
        flags = [unpack_bits(x, len(k)) for x, k in zip(batch.column("twice").to_pylist(), keys, strict=True)]
        loads = [ex.unpack_numbers(x) + 1 for x in batch.column("loads").to_pylist()]
        _, place, n = ex.distinct(np.concatenate(keys))
        many = (n > 1) | (np.bincount(place, np.concatenate(flags), len(n)) > 0)
        full = many & (np.bincount(place, np.concatenate(loads), len(n)) * UNIT > crowd)
        edges = np.cumsum([len(k) for k in keys])[:-1]
        cols = ([np.packbits(x).tobytes() for x in np.split(many[place], edges)], [np.flatnonzero(x).astype("<u4").tobytes() for x in np.split(full[place], edges)])
        return pa.table([batch.column("_block"), batch.column("_bucket"), *(pa.array(x, pa.binary()) for x in cols)], ["_block", "_bucket", "flags", "full"])

    def flags_of(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[bytes, bytes]]]:
        """Of each anchor: do several documents have it, and isn't it crowded? Is it crowded? And the packed flags by bucket. ``answers``: by bucket."""
        (filled, parts), answers = ex.parts(block.anchors, buckets), answers.filter(answers.column("flags").is_valid())
        packed = list(zip(answers.column("flags").to_pylist(), answers.column("full").to_pylist(), strict=True))
        many, full = np.zeros(len(block.anchors), bool), np.zeros(len(block.anchors), bool)
        for (x, y), s in zip(packed, parts, strict=True):
            many[s] = unpack_bits(x, s.stop - s.start)
            full[s.start + np.frombuffer(y, "<u4").astype(np.int64)] = True
        return many & ~full, full, dict(zip(filled.tolist(), packed, strict=True))

    def ask_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        number, block = texts.column("_block")[0].as_py(), Block(texts, length, anchor)
        flags, full, packed = flags_of(block, answers.sort_by("_bucket"))
        shared, one, _ = block.shared(flags)
        one = shared.where(one)
        _, key, check, first = block.crowded(full)
        some, singly = dict(zip(*ex.parts(one.anchor, buckets), strict=True)), dict(zip(*ex.parts(key, buckets), strict=True))
        filled = sorted({*packed, *map(int, singly)})
        cols: list[list] = [[] for _ in range(9)]
        for b in filled:
            s, t = some.get(b, slice(0, 0)), singly.get(b, slice(0, 0))
            text = b"".join(block.joined[a : a + n] for a, n in zip(one.start[s].tolist(), (one.windows[s] + length - 1).tolist(), strict=True))
            row = (*packed.get(b, (None, None)), ex.squeeze(portion(one.anchor[s]).tobytes()), ex.pack_numbers(one.windows[s]), pack_wide(block.rank[one.doc[s]]), ex.squeeze(text), ex.pack_keys(key[t]), pack_wide(check[t]), pack_wide(first[t]))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return pa.table([pa.array(filled, pa.int32()), pa.array([number] * len(filled), pa.int32()), *(pa.array(x, pa.binary()) for x in cols)], ["_bucket", "_block", "flags", "full", "portion", "windows", "doc", "text", "key", "check", "first"])

    def tell_windows(batch: pa.Table) -> pa.Table:
        col = {c: batch.column(c).to_pylist() for c in ("portion", "windows", "doc", "text", "key", "check", "first")}
        sizes = [ex.unpack_numbers(x) for x in col["windows"]]
        n, doc, joined = np.concatenate(sizes), np.concatenate([unpack_wide(x) for x in col["doc"]]), b"".join(map(ex.expand, col["text"]))
        size, which = n + length - 1, np.frombuffer(b"".join(map(ex.expand, col["portion"])), np.uint8)
        start, upto = np.cumsum(size) - size, np.cumsum(n) - n
        earlier = np.zeros(int(n.sum()), bool)
        for p in range(PORTIONS):
            mine, number = np.flatnonzero(which == p), {}
            place = np.array([number.setdefault(joined[a : a + k], len(number)) for a, k in zip(start[mine].tolist(), size[mine].tolist(), strict=True)], np.int64)
            by = np.lexsort((doc[mine], place))  # each distinct stretch with its smallest document
            one = mine[by[np.diff(place[by], prepend=-1) > 0]]
            raw, at = np.frombuffer(b"".join(number), np.uint8), np.cumsum(size[one]) - size[one]
            del number
            found = found_earlier(raw, at, n[one], doc[one], length)
            first = np.cumsum(n[one]) - n[one]
            earlier[ragged(upto[mine], n[mine])] = found[ragged(first[place], n[mine])] | np.repeat(doc[mine] > doc[one[place]], n[mine])
        rows = np.split(earlier, np.cumsum([int(own.sum()) for own in sizes])[:-1])
        keys = [ex.unpack_keys(x) for x in col["key"]]
        known = hashes_earlier(np.concatenate(keys), np.concatenate([unpack_wide(x) for x in col["check"]]), np.concatenate([unpack_wide(x) for x in col["first"]]), length)
        packed = lambda flags: pa.array([ex.squeeze(np.packbits(x).tobytes()) for x in flags], pa.binary())
        counts = lambda items: pa.array([len(x) for x in items], pa.int64())
        known = np.split(known, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([*(batch.column(c) for c in ("_block", "_bucket", "flags", "full")), packed(rows), counts(rows), packed(known), counts(known)], ["_block", "_bucket", "flags", "full", "earlier", "n_earlier", "known", "n_known"])

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts, length, anchor)
        answers = answers.sort_by("_bucket")
        flags, full, _ = flags_of(block, answers)
        bits = lambda c: np.concatenate([np.zeros(0, bool), *(unpack_bits(ex.expand(x), k) for x, k in zip(answers.column(c).to_pylist(), answers.column(f"n_{c}").to_pylist(), strict=True))])
        doc, start, end = removed_spans(block, flags, bits("earlier"), full, bits("known"))
        begins, cuts, rows, k = block.ends - np.diff(block.ends, prepend=0), np.searchsorted(doc, np.arange(len(block.ends) + 1)), [], 0
        for i, text in enumerate(block.texts):
            if block.copy[i]:
                spans = [(0, len(text))] if len(text) >= length else []
            else:
                own = slice(cuts[k], cuts[k + 1])
                spans = list(zip((start[own] - begins[k]).tolist(), (end[own] - begins[k]).tolist(), strict=True))
                k += 1
            row = [block.ids[i], len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(text, spans)).hexdigest()]
            if with_text:
                row += [without(text, whole_characters(text, spans)), [{"start": a, "end": b} for a, b in spans]]
            rows.append(row)
        carried = [texts.column(f"_carry{k}").take(pa.array(block.order)) for k in range(len(carry))]
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * with_text
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.table([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *carried], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] * with_text), *(f"_carry{k}" for k in range(len(carry)))])

    questions = own.groupBy("_block").applyInArrow(ask_anchors, "_bucket int, _block int, keys binary, twice binary, loads binary")
    shared = deal(questions, "_bucket").applyInArrow(tell_shared, "_block int, _bucket int, flags binary, full binary")
    asked = own.groupBy("_block").cogroup(deal(shared, "_block")).applyInArrow(ask_windows, "_bucket int, _block int, flags binary, full binary, portion binary, windows binary, doc binary, text binary, key binary, check binary, first binary")
    told = deal(asked, "_bucket").applyInArrow(tell_windows, "_block int, _bucket int, flags binary, full binary, earlier binary, n_earlier long, known binary, n_known long")
    out = own.groupBy("_block").cogroup(deal(told, "_block")).applyInArrow(remove, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * with_text + "".join(f", _carry{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)))
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the removed passages: ``text_col`` is what remains and ``chars_col`` its length. A document of which
    nothing remains goes; one that was empty before stays."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col, chars_col))
    out = dedup(docs, with_text=True, carry=rest, id_col=id_col, text_col=text_col).filter("n_bytes = 0 or n_removed < n_bytes")
    made = {id_col: F.col(id_col), text_col: F.col("kept"), chars_col: F.length("kept").cast("long"), **{c: F.col(f"_carry{k}") for k, c in enumerate(rest)}}
    return out.select(*(made[c].alias(c) for c in docs.columns))
