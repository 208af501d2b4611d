"""Quality rules: fixed counting rules, then a hashed n-gram logistic regression with calibrated probabilities.

Features are relative frequencies of hashed lower-case words, word pairs and character n-grams of the whole text. The model is
fitted on at most ``sample`` labelled documents (a bounded sample, see ``linear.labelled_sample``), calibrated on
out-of-fold scores, and scored in Arrow batches against a fixed threshold.

Defined results: a null text has no words and fails the base rules; without labels of both kinds there is no model
and what passes the base rules is kept, with a null probability; a probability equal to the threshold is kept; repeated
rows give repeated results, and a repeated labelled id is fitted on once; long texts are judged whole, but only labelled ones of
up to ``linear.LONGEST`` bytes are fitted on; further columns aren't read (``keep`` hands them on untouched); an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import linear, memo
from reachlens.llm.text import as_bytes, runs

BITS = 17
CHAR_SIZES = (3, 4)
#: Feature kinds: words, word pairs, and a kind for each size of character n-grams; each has 2**BITS slots.
KINDS = 2 + len(CHAR_SIZES)
#: Fixed odd multipliers of the hashes.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
SAMPLE, MIN_DOCS, FOLDS, THRESHOLD = 1500, 5, 3, 0.5
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Characters counted as symbols, and the white space that parts words: fixed values.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"

_IS_SYMBOL, _IS_SPACE = np.zeros(256, bool), np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE[list(SPACES)] = True


@dataclass
class Model:
    weights: np.ndarray  # float32, KINDS << BITS
    bias: float
    slope: float
    offset: float


def char_slots(raw: np.ndarray, size: int) -> np.ndarray:
    """The slot of the n-gram that starts at each byte; the last ``size`` - 1 have none."""
    n = max(0, len(raw) - size + 1)
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h += raw[k : k + n] * np.uint32(MIX[k])
    h ^= h >> np.uint32(15)
    h *= np.uint32(MIX[2])
    return h >> np.uint32(32 - BITS)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def pair_slots(h: np.ndarray) -> np.ndarray:
    x = h[:-1] * np.uint32(MIX[0]) + h[1:] * np.uint32(MIX[1])
    x ^= x >> np.uint32(13)
    return (x * np.uint32(MIX[3])) >> np.uint32(32 - BITS)


def document_slots(text: bytes) -> list[np.ndarray]:
    """The slots of a text's n-grams, by kind."""
    h, raw = word_hashes(text.lower().split()), np.frombuffer(text, np.uint8).astype(np.uint32)
    return [h >> np.uint32(32 - BITS), pair_slots(h), *(char_slots(raw, n) for n in CHAR_SIZES)]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and relative frequencies of one text."""
    cols, vals = [], []
    for kind, slots in enumerate(document_slots(text)):
        if len(slots):
            own, n = np.unique(slots, return_counts=True)
            cols.append(own.astype(np.int32) + np.int32(kind << BITS))
            vals.append((n / len(slots)).astype(np.float32))
    return (np.concatenate(cols), np.concatenate(vals)) if cols else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def sample_features(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows, cols, vals, y of a sample's features (_id, _y, cols, vals), and the slots that MIN_DOCS documents have, which ``cols`` number; the slots of
    rarer n-grams go before the documents' features are put together."""
    got = got.take(np.lexsort((got["_y"].to_numpy(), got["_id"].to_numpy())))
    y, seen = got["_y"].to_numpy() > 0, np.zeros(KINDS << BITS, np.int32)
    for x in got["cols"]:
        seen[np.frombuffer(x.as_buffer(), np.int32)] += 1  # a slot occurs once a document
    slots = np.flatnonzero(seen >= MIN_DOCS)
    small = np.full(KINDS << BITS, -1, np.int32)
    small[slots] = np.arange(len(slots))
    rows, cols, vals = [], [], []
    for i, (c, v) in enumerate(zip(got["cols"], got["vals"], strict=True)):
        own = small[np.frombuffer(c.as_buffer(), np.int32)]
        keep = own >= 0
        cols.append(own[keep])
        vals.append(np.frombuffer(v.as_buffer(), np.float32)[keep])
        rows.append(np.full(len(cols[-1]), i, np.int32))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(rows, np.int32), join(cols, np.int32), join(vals, np.float32), y.astype(float), slots


def fitted(sample: pa.Table) -> Model | None:
    """The model of a sample's features, or None without labels of both kinds."""
    rows, cols, vals, y, slots = sample_features(sample)
    if len(y) < 2 * FOLDS or not 0 < y.mean() < 1:
        return None
    fold, out = linear.folds(len(y), FOLDS), np.zeros(len(y))
    for k in range(FOLDS):
        inside = fold != k
        if not 0 < y[inside].mean() < 1:
            return None
        w, b = linear.fit_sparse(rows, cols, vals, y, len(slots), inside)
        out += np.where(inside, 0, np.bincount(rows, vals * w[cols], len(y)) + b)
    w, b = linear.fit_sparse(rows, cols, vals, y, len(slots))
    weights = np.zeros(KINDS << BITS, np.float32)
    weights[slots] = w
    return Model(weights, b, *linear.platt(out, y))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model, or None without labels of both kinds. The sample's features are made where its texts are and fitted on by one task, as they
    are bounded; the driver gets the weights alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(made), pa.int32()), batch.column(0), batch.column(2), pa.array([c.tobytes() for c, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["_all", "_id", "_y", "cols", "vals"])

    def learn(own: pa.Table) -> pa.Table:
        memo.only("quality")
        model = fitted(own)
        found = [] if model is None else [(model.weights.tobytes(), model.bias, model.slope, model.offset)]
        return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.binary(), pa.float64(), pa.float64(), pa.float64()))], ["weights", "bias", "slope", "offset"])

    some = linear.labelled_sample(docs, labels, [label], sample, id_col, text_col).select("_id", "_text", F.col("_y0").alias("_y"))
    made = some.mapInArrow(run, f"_all int, _id {some.schema['_id'].dataType.simpleString()}, _y int, cols binary, vals binary")
    for x in made.groupBy("_all").applyInArrow(learn, "weights binary, bias double, slope double, offset double").collect():
        return Model(np.frombuffer(bytes(x.weights), np.float32), x.bias, x.slope, x.offset)
    return None


def repeated_words(words: list[bytes], h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, each word position once."""
    if len(words) < 4:
        return 0
    wide = h.astype(np.uint64)
    keys = np.sort((wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:])
    if not (keys[1:] == keys[:-1]).any():  # equal windows have equal keys
        return 0
    number: dict = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, inv, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[inv] > 1
    mark = np.zeros(len(words), bool)
    for k in range(3):
        mark[k : k + len(twice)] |= twice
    return int(mark.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    own = [x for x in lines if x and x.strip()]
    return len(own) - len(set(own))


def judge(texts: list[bytes], model: Model | None) -> dict:
    """The columns of ``quality_rules`` for a slice of texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    starts = ends - [len(x) for x in texts]
    upto = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[ends] - c[starts]
    spaces, symbols, points = upto(_IS_SPACE[raw]), upto(_IS_SYMBOL[raw]), upto((raw & 0xC0) != 0x80)
    score = np.full(len(texts), model.bias if model else 0.0)
    if model:
        wide = raw.astype(np.uint32)
        for i, n in enumerate(CHAR_SIZES):
            total = np.concatenate([[0], np.cumsum(model.weights[char_slots(wide, n) + np.uint32((2 + i) << BITS)], dtype=np.float64)])
            last = np.clip(ends - n + 1, 0, len(total) - 1)
            many = last - starts
            score += np.where(many > 0, (total[last] - total[np.minimum(starts, len(total) - 1)]) / np.maximum(many, 1), 0)
    n_words, lines, again = [], [], []
    for i, x in enumerate(texts):
        words = x.split()
        h = word_hashes(words)
        n_words.append(len(words))
        lines.append(duplicate_lines(x))
        again.append(repeated_words(words, h))
        if model and words:
            h = word_hashes(x.lower().split())
            score[i] += float(model.weights[h >> np.uint32(32 - BITS)].mean())
            if len(words) > 1:
                score[i] += float(model.weights[pair_slots(h) + np.uint32(1 << BITS)].mean())
    n, rep = np.array(n_words, np.int64), np.array(again, np.int64)
    failed = (n < MIN_WORDS) | (100 * rep > MOST_REPEATED_PERCENT * n)
    p = linear.sigmoid(model.slope * score + model.offset) if model else np.full(len(texts), np.nan)
    return {
        "n_words": n, "word_chars": points - spaces, "n_symbols": symbols, "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": rep,
        "base_failed": failed, "kept": ~failed & ((p >= THRESHOLD) if model else True), "quality_probability": pa.array(p, from_pandas=True),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double"


def quality_rules(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id_col`` and the rules' columns for every whole text; ``keep``: instead, the rows of ``docs`` that are kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: KINDS << BITS floats
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    names = docs.columns if keep else [id_col, text_col]
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("quality")
        for batch in batches:
            for lo, hi in runs(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                made = judge(as_bytes(part.column(at)), held.value)
                if keep:
                    yield part.filter(pa.array(made["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], [id_col, *fields])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
