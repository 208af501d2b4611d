"""Toxicity by a classifier chain: each category's model sees the probabilities of the categories before it.

The categories, in the chain's order, each have labels of their own: ``junk`` (labelled as of low quality), ``toxic`` (labelled
so) and ``toxic_junk`` (both). Features are the presence of hashed lower-case words and word beginnings, picked by their
association with the labels. Each later model also sees the probabilities of the earlier categories, and is trained with
out-of-fold ones, so it learns from what it will see when scoring; each fold picks its own features and knows nothing of the
documents it scores.

Fitted on at most ``sample`` labelled documents (of up to ``linear.LONGEST`` bytes, each id once); every whole text, however long,
is scored. Defined results: a null text is empty and gets the probabilities of no feature; without toxic and other labels all
probabilities are 0 and nothing is toxic; a category that no sampled document has, or each, gets probability 0; a probability equal
to the threshold is toxic; of features with equal association those with the smaller hashes are picked; repeated rows give
repeated results; further columns aren't read, so they can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reachlens.llm import linear, memo
from reachlens.llm.text import as_bytes, map_texts

#: The categories in the chain's order, and the label columns they are made of.
CATEGORIES = ("junk", "toxic", "toxic_junk")
LABELS = ("toxic", "quality")
SAMPLE, MIN_DOCS, FOLDS, THRESHOLD = 5000, 4, 3, 0.5
#: Features picked for each category at most.
FEATURES = (60, 300, 60)
#: Lengths in bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5)
#: Words remembered by a worker at most, each of at most LONG bytes; beyond, it starts anew.
MEMO, LONG = 400_000, 64
#: ASCII punctuation parts words like white space.
_PART = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)


@dataclass
class Chain:
    index: dict[int, int]  # hash: feature
    weights: np.ndarray  # categories x (features + earlier categories + bias), zeros where a category sees less
    present: tuple[bool, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PART).split()


def hashes(word: bytes) -> list[int]:
    return [zlib.crc32(word), *(zlib.crc32(word[:n] + b"*") for n in BEGINNINGS if len(word) > n)]


def sample_words(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """By document: distinct feature hashes; the labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.unique(np.array([h for w in set(words_of(x)) for h in hashes(w)], np.uint32)).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(blobs, pa.binary())], ["_id", "_y0", "_y1", "h"])

    kind = sample.schema["_id"].dataType.simpleString()
    got = sorted(sample.select("_id", "_text", "_y0", "_y1").mapInArrow(run, f"_id {kind}, _y0 int, _y1 int, h binary").collect())  # ``sample`` rows
    return [np.frombuffer(r["h"], np.uint32) for r in got], np.array([(r["_y0"] > 0, r["_y1"] > 0) for r in got], bool).reshape(-1, 2)


def pick(rows: np.ndarray, where: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
    """The features (of ``size``) whose presence goes with a category the most, by chi-square. rows, where: which document has
    which; wanted: documents x categories."""
    seen, picked = np.bincount(where, minlength=size), [np.zeros(0, np.int64)]
    for y, most in zip(wanted.T, FEATURES, strict=True):
        share = y.mean()
        if 0 < share < 1:
            gap = np.bincount(where, y[rows], size) - seen * share
            chi = gap**2 / (np.maximum(seen, 1) * share * (1 - share) * np.maximum(1 - seen / len(y), 1e-9))
            chi[seen < MIN_DOCS] = 0
            some = np.argsort(-chi, kind="stable")[:most]
            picked.append(some[chi[some] > 0])
    return np.unique(np.concatenate(picked))


class Sample:
    """Sampled documents as rows of features."""

    def __init__(self, held: list[np.ndarray]):
        self.every, self.where = np.unique(np.concatenate(held), return_inverse=True)
        self.rows, self.size = np.repeat(np.arange(len(held)), [len(h) for h in held]), len(held)

    def pick(self, wanted: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The features picked by the documents ``inside`` alone."""
        number, some = np.cumsum(inside) - 1, inside[self.rows]
        return pick(number[self.rows[some]], self.where[some], len(self.every), wanted[inside])

    def matrix(self, picked: np.ndarray) -> np.ndarray:
        column = np.full(len(self.every), -1)
        column[picked] = np.arange(len(picked))
        x, at = np.zeros((self.size, len(picked))), column[self.where] >= 0
        x[self.rows[at], column[self.where][at]] = 1
        return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """The chain, or None without toxic and other labels."""
    return fit_rows(*sample_words(linear.labelled_sample(docs, labels, list(LABELS), sample, id_col, text_col)))


def fit_rows(held: list[np.ndarray], marks: np.ndarray) -> Chain | None:
    """The chain of documents given by their feature hashes and labels (toxic, of good quality)."""
    toxic, good = marks.T
    if len(marks) < 2 * FOLDS or not 0 < toxic.mean() < 1:
        return None
    wanted = np.column_stack([~good, toxic, toxic & ~good]).astype(float)
    rows = Sample(held)
    fold, inside_of = linear.folds(len(marks), FOLDS), []
    for f in range(FOLDS):
        inside_of.append((fold != f, rows.matrix(rows.pick(wanted, fold != f))))
    picked = rows.pick(wanted, np.ones(len(marks), bool))
    x, ahead = rows.matrix(picked), np.zeros((len(marks), 0))
    weights, present = np.zeros((len(CATEGORIES), len(picked) + len(CATEGORIES) + 1)), []
    for k, y in enumerate(wanted.T):
        out = np.zeros(len(y))
        present.append(bool(0 < y.mean() < 1))
        if present[-1]:
            for inside, own in inside_of:
                inputs = np.column_stack([own, ahead])
                w = linear.fit_dense(inputs[inside], y[inside])
                out[~inside] = linear.sigmoid(inputs[~inside] @ w[:-1] + w[-1])
            w = linear.fit_dense(np.column_stack([x, ahead]), y)
            weights[k, : len(picked) + k], weights[k, -1] = w[:-1], w[-1]
        ahead = np.column_stack([ahead, out])
    return Chain({int(h): i for i, h in enumerate(rows.every[picked])}, weights, tuple(present))


_memo: dict[str, dict] = {}
memo.remembers("toxicity", _memo.clear)


def chain_scores(texts: list[bytes], chain: Chain, key: str) -> np.ndarray:
    """Texts x categories: probabilities."""
    if key not in _memo:
        _memo.clear()
        _memo[key] = {}
    known, index, n = _memo[key], chain.index, len(chain.index)
    if len(known) > MEMO:
        known.clear()
    z = np.tile(chain.weights[:, -1], (len(texts), 1))
    for i, text in enumerate(texts):
        own = set(words_of(text))
        hit = set()
        for w in own:
            features = known.get(w)
            if features is None:
                features = tuple(index[h] for h in hashes(w) if h in index)
                if len(w) <= LONG:
                    known[w] = features
            hit.update(features)
        if hit:
            z[i] += chain.weights[:, sorted(hit)].sum(1)
    p = np.zeros_like(z)
    for k in range(len(CATEGORIES)):
        if chain.present[k]:
            p[:, k] = linear.sigmoid(z[:, k] + p[:, :k] @ chain.weights[k, n : n + k])
    return p


def toxicity(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, a probability for each category, and ``is_toxic``."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # of a fixed size: FEATURES words and their weights
    key = uuid.uuid4().hex  # an object's address could be that of a chain before it

    def work(texts: list[bytes]) -> dict:
        p = chain_scores(texts, held.value, key) if held.value else np.zeros((len(texts), len(CATEGORIES)))
        return {**{f"p_{c}": p[:, k] for k, c in enumerate(CATEGORIES)}, "is_toxic": p[:, CATEGORIES.index("toxic")] >= THRESHOLD}

    return map_texts(docs, work, "".join(f"p_{c} double, " for c in CATEGORIES) + "is_toxic boolean", "toxicity", id_col, text_col)
