"""Hierarchical multi-length packing.

A document's ids are cut into full windows of the longest tier; what is left (and every shorter document) is routed
to the smallest tier that holds it. Tiers are packed from the longest down: a sequence opens with an item of its tier, its gap is
filled with the largest fitting items of the shorter tiers, and where none fits an item of the shortest tier is cut to
fill the gap to the last id. Tier sizes are powers of two, so full sequences need no padding. Sequences are dealt into
step groups of equal token numbers, longest first, which powers of two always fill exactly.

Packing is done partition by partition with a bounded pool of waiting documents, so nothing is shuffled; only what is
left at a partition's end is cut into ever smaller powers of two (its last step group may be short).

Defined results: a null text is empty and has the end id alone; repeated rows are packed as often as they occur; an
empty table gives an empty one. Items of equal length are taken in the order they came; long texts are cut into windows, whole;
further columns aren't read, so they can't clash.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlens.llm import memo
from reachlens.llm.text import runs

TIERS = (128, 256, 512, 1024)
#: Ids waiting in the tiers before a round of packing, and ids in a step group.
POOL, STEP = 1 << 16, 1 << 13
#: Words remembered by a worker at most, and characters of them; further ones are encoded again in each slice of texts, of about so many bytes, that has them.
MEMO, MEMO_CHARS, SLICE = 100_000, 2_000_000, 1 << 20
END_ID = 0
#: Words whose parts are known: Latin letters, a mark, a line's end and the same again.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?))?")


class Ids:
    """Ids as the library gives them. Merges across a single space end in a token that holds a space after its first
    character; where no such token can be in a text, its words are encoded alone, each once while it is remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words can be taken alone only where the library itself parts texts before " word"
        parts = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b\n c")] if self.tokenizer.pre_tokenizer else []
        self.by_word = self.tokenizer.normalizer is None and [x[:1] for x in parts] == ["a", "Ġ", "Ċ", "Ġ"]
        self.model, parts = self.tokenizer.model, [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a bC, éa.\nEf")] if parts else []
        self.by_letters = self.by_word and parts == ["a", "ĠbC", ",", "ĠÃ©a", ".", "Ċ", "Ef"]
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "")[:1] == "Ġ" for i in range(self.tokenizer.get_vocab_size())])
        # a merge across a space gives one of these tokens (here: spaces and no-break spaces in turn), so texts that hold one are encoded whole
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        spell = {c: b for b, c in byte_characters().items()}
        inner = [bytes(spell[c] for c in x) for x in tokens if "Ġ" in x[1:] and set(x) <= spell.keys()]
        self.across = sorted({x.decode("utf-8", "ignore") for x in inner if b"  " not in x} - {""})
        self.by_word = self.by_word and all(x.encode() in inner and " " in x[1:] for x in self.across)
        self.number: dict[str, int] = {}  # the words remembered
        self.chars = 0  # and their characters
        self.parts: dict[str, list[int]] = {}
        # their ids, where each one's begin, and how many they are
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, part: str) -> list[int]:
        """The ids of a mark or a line's end, remembered."""
        if part not in self.parts:
            self.parts[part] = [t.id for t in self.model.tokenize(part)]
        return self.parts[part]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words that each follow a space; where each one's begin among them, and how many they are. Of words of Latin letters, with a mark
        at their end or one more such word on the next line (``SIMPLE``), it is known where the library parts them, so the merges of these parts alone give their ids. Of
        others many go in one call; the ids that open a word (they hold its space) tell them apart, unless neighbours have merged."""
        merge, met, got, sizes = self.model.tokenize, SIMPLE.fullmatch, [], np.zeros(len(words), np.int64)
        for i in range(0, len(words) if self.by_letters else 0, 5000):
            flat, many = [], []
            for w in words[i : i + 5000]:
                before, m = len(flat), met(w)
                if m:
                    head, mark, tail, last = m.groups()
                    flat += [t.id for t in merge("Ġ" + (head if head.isascii() else spelled(head)))]
                    if mark:
                        flat += self.single(mark)
                    if tail:
                        flat += self.single("Ċ")
                        flat += [t.id for t in merge(tail if tail.isascii() else spelled(tail))]
                        if last:
                            flat += self.single(last)
                many.append(len(flat) - before)
            sizes[i : i + 5000] = many
            got.append(np.array(flat, np.uint32))
        plain = sizes > 0
        rest, found = [words[k] for k in np.flatnonzero(~plain).tolist()], [np.zeros(0, np.int64)]
        for i in range(0, len(rest), 50):
            some = rest[i : i + 50]
            own = self.encode([" " + " ".join(some)])
            starts = np.flatnonzero(self.opens[own[0]])
            if len(starts) == len(some):
                found.append(np.diff(np.append(starts, len(own[0]))))
            else:
                own = self.encode([" " + w for w in some])
                found.append(np.array([len(x) for x in own], np.int64))
            got += own
        sizes[~plain] = np.concatenate(found)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([np.zeros(0, np.uint32), *got]), starts, sizes

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        odd = lambda x: x and (not self.by_word or "  " in x or x[0] == " " or x[-1] == " " or any(s in x for s in self.special) or any(s in x for s in self.across))
        whole = [i for i, x in enumerate(texts) if odd(x)]
        rest = sorted(set(range(len(texts))).difference(whole))
        out = dict(zip(whole, self.encode([texts[i] for i in whole]), strict=True))
        split = pc.split_pattern(pa.array([texts[i] for i in rest], pa.large_string()), " ")
        coded, edges = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = [words[k] for k in index[edges[:-1]].tolist()]  # no space before them
        # ids of each distinct word: remembered, or encoded now; those met first, mostly frequent ones, stay remembered
        at = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(at < 0).tolist()]
        flat, starts, sizes = self.words(new)
        known = len(self.sizes)
        at[at < 0] = known + np.arange(len(new))
        flat, starts, sizes = np.concatenate([self.flat, flat]), np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.sizes, sizes])
        lengths = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        if room := max(0, min(MEMO - known, int(np.searchsorted(lengths, MEMO_CHARS - self.chars, "right")))):
            self.chars += int(lengths[room - 1])
            self.number.update(zip(new[:room], range(known, known + room), strict=True))
            self.flat, self.starts, self.sizes = flat, starts[: known + room].copy(), sizes[: known + room].copy()
        later = np.ones(len(index), bool)
        later[edges[:-1]] = False
        k = at[index[later]]
        n, lo = sizes[k], starts[k]
        upto = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(lo - upto[:-1], n) + np.arange(upto[-1])]
        cut = upto[edges - np.arange(len(edges))].tolist()
        for j, (i, head) in enumerate(zip(rest, self.encode(heads), strict=True)):
            out[i] = np.concatenate([head, ids[cut[j] : cut[j + 1]]])
        end = np.array([END_ID], np.uint32)
        return [np.concatenate([out[i], end]) for i in range(len(texts))]


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_SPELL = byte_characters()


def spelled(word: str) -> str:
    return word.encode().decode("latin-1").translate(_SPELL)


@functools.lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


memo.remembers("packing", ids_of.cache_clear)


class Packer:
    """Takes documents, gives sequences: (size, [(document, start, length), ...]), every size a power of two."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.waiting, self.held = tiers, {t: deque() for t in tiers}, 0

    def put(self, item: tuple) -> None:
        self.waiting[next(t for t in self.tiers if t >= item[2])].append(item)
        self.held += item[2]

    def take(self, tier: int) -> tuple:
        item = self.waiting[tier].popleft()
        self.held -= item[2]
        return item

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list]]:
        window = self.tiers[-1]
        for start in range(0, length - window + 1, window):
            yield window, [(doc, start, window)]
        if rest := length % window:
            self.put((doc, length - rest, rest))

    def round(self) -> Iterator[tuple[int, list]]:
        """Full sequences out of what waits, longest tier first; an item whose gap nothing fills goes on waiting."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, shorter = self.tiers[k], self.tiers[:k]
            while self.waiting[tier]:
                items = [self.take(tier)]
                gap = tier - items[0][2]
                while gap:
                    fit = next((t for t in reversed(shorter) if t <= gap and self.waiting[t]), None)
                    if fit is None:  # of an item that may not fit, take as much as the gap holds
                        fit = next((t for t in self.tiers[: k + 1] if self.waiting[t]), None)
                    if fit is None:
                        break
                    doc, start, length = self.take(fit)
                    if length > gap:
                        self.put((doc, start + gap, length - gap))
                        length = gap
                    items.append((doc, start, length))
                    gap -= length
                if gap:
                    for x in items:
                        self.put(x)
                    break
                yield tier, items

    def rest(self) -> Iterator[tuple[int, list]]:
        """All that still waits, as sequences of ever smaller powers of two."""
        left = deque(x for t in reversed(self.tiers) for x in self.waiting[t])
        total, size, items = sum(x[2] for x in left), self.tiers[-1], []
        self.waiting, self.held = {t: deque() for t in self.tiers}, 0
        while total:
            while size > total:
                size >>= 1
            gap, items = size, []
            while gap:
                doc, start, length = left.popleft()
                if length > gap:
                    left.appendleft((doc, start + gap, length - gap))
                    length = gap
                items.append((doc, start, length))
                gap -= length
            total -= size
            yield size, items


def step_groups(sequences: list[tuple[int, list]], step: int = STEP, last: bool = False) -> tuple[list[list], list]:
    """Groups of exactly ``step`` ids each, longest sequences first, and the sequences left over (``last``: none are)."""
    order = sorted(sequences, key=lambda s: -s[0])
    n = sum(s[0] for s in order) // step
    groups, rest, at = [[] for _ in range(n)], [], 0
    room = [step] * n
    for s in order:
        for _ in range(n):  # dealt in turn, so that long and short sequences spread over the groups
            if room[at] >= s[0]:
                break
            at = (at + 1) % n
        if n and room[at] >= s[0]:
            groups[at].append(s)
            room[at] -= s[0]
            at = (at + 1) % n
        else:
            rest.append(s)
    if last and rest:
        groups.append(rest)
        rest = []
    return groups, rest


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group."""
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    window = tiers[-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("packing")
        base = TaskContext.get().partitionId() << 36
        ids, packer = ids_of(tokenizer_path), Packer(tiers)
        open_docs: dict[int, tuple] = {}  # number: (id, ids, ids not yet placed)
        full: list[tuple[int, list]] = []
        number = sequence = group = 0
        kind = None

        def emit(groups: list[list]) -> pa.RecordBatch:
            nonlocal sequence, group
            cols: list[list] = [[] for _ in range(9 + with_ids)]
            for own in groups:
                for size, items in own:
                    offset = 0
                    for doc, start, length in items:
                        key, all_ids, left = open_docs[doc]
                        part = all_ids[start : start + length]
                        row = (key, start, length, zlib.crc32(part), len(all_ids), base + sequence, offset, size, base + group, part)
                        for c, v in zip(cols, row):  # noqa: B905 the ids may not be asked for
                            c.append(v)
                        offset += length
                        if left == length:
                            del open_docs[doc]
                        else:
                            open_docs[doc] = (key, all_ids, left - length)
                    sequence += 1
                group += 1
            types = [kind, *[pa.int64()] * 8, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [id_col, *names, *(["ids"] * with_ids)])

        for batch in batches:
            kind = batch.column(0).type
            for lo, hi in runs(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                for key, own in zip(part.column(0).to_pylist(), ids.of([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    open_docs[number] = (key, own, len(own))
                    full += packer.add(number, len(own))
                    number += 1
                    if packer.held >= POOL:
                        full += packer.round()
                groups, full = step_groups(full)
                if groups:
                    yield emit(groups)
        if kind is not None:
            full += packer.round()
            full += packer.rest()
            groups, _ = step_groups(full, last=True)
            if groups:
                yield emit(groups)

    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers) or window > STEP:
        raise ValueError("tiers must be ascending powers of two")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"`{n}` long" for n in names) + ", ids array<int>" * with_ids)
