"""Language-model scores by a weighted backoff automaton over smoothed word n-grams.

States are the histories seen in training (up to ORDER - 1 tokens; the shortest is the root). The arc of token w from state h weighs
log10 p(w | h) with p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), where h' is h without its first token and k is PRIORS'
value for the length of h, and leads to the longest seen history that ends in h w. Where h w was never seen the failure arc to h' weighs
log10(k / (c(h) + k)), and w is read there. The root has an arc for each token: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), whose
0.1 / (...) is what an unknown token gets. The weights of each state add up to one. A text is read once from left to
right, from the state of a finished text to its end token: the state is carried on, and the log-probabilities add up. In a block of
documents all texts advance together, a token a step, in numpy; long ones are cut into pieces of PIECE tokens, whose
first state is found by reading the ORDER - 1 tokens before.

The model is as large as the corpus, so no task holds it: documents are dealt into blocks, each block asks hash buckets
for the training counts of its own distinct n-grams (see ``exchange``), and gets the part of the automaton that its
texts can reach. From three tokens on it asks only for n-grams whose beginning and end are both in training texts of other blocks;
no other can be, and its own counts are whole.

Defined results: a null text is empty: its only token is the end; rows with equal ids are equal documents and each
counts; repeated rows repeat; a null id is hashed as '' and trains or not by that; without training documents every token is
unknown; long texts are read whole; further columns aren't read, so they can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import exchange as ex
from reachlens.llm import memo
from reachlens.llm.text import whole, words_of

ORDER, ADD, FOLDS = 3, 0.1, 10
#: What a history's continuations are mixed with its shorter history by (in tokens), for histories of one, two ... tokens.
PRIORS = (1000.0, 5.0)
#: Tokens of a text that are read in one go.
PIECE = 256


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


@dataclass
class Grams:
    """The distinct n-grams of one length in a block, by hash."""

    place: np.ndarray  # of the n-gram that ends at each position
    keys: np.ndarray  # hashes, sorted
    counts: np.ndarray  # in the block's training texts
    past: np.ndarray  # place of the n-gram without its last token
    tail: np.ndarray  # place of the n-gram without its first token
    token: np.ndarray  # place of the last token


#: The hash of an n-gram that would begin before its text: it stands last and is never counted.
NONE = np.uint64((1 << 64) - 1)


class Block:
    """The tokens of a block of documents, and their n-grams by length."""

    def __init__(self, ids: list, texts: pa.Array, order: int):
        words, self.sizes = words_of(texts)
        self.sizes += 1
        words = words.dictionary_encode()
        end = len(words.dictionary)  # the end token, and the state before the first word
        tokens = np.full(int(self.sizes.sum()), end, np.int32)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        tokens[inner] = words.indices.to_numpy()
        number = [*words.dictionary.to_pylist(), b""]
        del words
        self.first = np.cumsum(self.sizes) - self.sizes
        self.held = np.array([held_out(i) for i in ids], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.reach = np.arange(len(tokens)) - np.repeat(self.first, self.sizes)  # tokens read before each position
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        del number
        by_hash = np.argsort(hashes)
        rank = np.empty(len(by_hash), np.int32)
        rank[by_hash] = np.arange(len(by_hash))
        self.end, self.tokens = int(rank[end]), rank[tokens]
        self.hashed = hashes[tokens]  # of the longest n-gram so far that ends at each position
        self.single = self.hashed
        every = np.arange(len(hashes))
        self.grams = [Grams(self.tokens, hashes[by_hash], np.bincount(self.tokens[self.train], minlength=len(hashes)), every, every, every)]
        for k in range(1, order):
            self.longer(k)

    def longer(self, k: int) -> None:
        """Adds the n-grams of k + 1 tokens: the beginning of a text is the state of a finished one, and nothing stands before it."""
        less, size = self.grams[-1], len(self.tokens)
        before = np.empty(size, np.uint64)
        before[1:] = self.hashed[:-1]
        before[self.first] = less.keys[self.end] if k == 1 else NONE
        self.hashed = ex.mixed(before * np.uint64(0x9E3779B97F4A7C15) + self.single + np.uint64(k))
        self.hashed[self.reach + 1 < k] = NONE
        order = np.argsort(self.hashed)
        run = self.hashed[order]
        new = np.append(True, run[1:] != run[:-1]) if size else np.zeros(0, bool)
        place = np.empty(size, np.int32)
        place[order] = np.cumsum(new) - 1
        one, keys = order[new], run[new]
        past = np.where(self.reach[one] > 0, less.place[one - 1], self.end if k == 1 else 0)
        counts = np.bincount(place[self.train], minlength=len(keys))
        counts[keys == NONE] = 0
        self.grams.append(Grams(place, keys, counts, past, less.place[one], self.tokens[one]))

    def asked(self, k: int, elsewhere: list[np.ndarray]) -> np.ndarray:
        """The n-grams of k + 1 tokens that other blocks' training texts can have. elsewhere: counts there, by length."""
        g = self.grams[k]
        if k < 2:
            return np.arange(len(g.keys))
        return np.flatnonzero((elsewhere[k - 1][g.past] > 0) & (elsewhere[k - 1][g.tail] > 0) & (g.keys != NONE))


class Automaton:
    """The part of the automaton that a block's texts can reach. Its arcs carry the numbers of their n-grams (history and token), so
    the arc of the token at a position is found by the place of the n-gram that ends there."""

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, vocabulary: int, priors: tuple[float, ...]):
        """counts: of the block's n-grams in all training texts, by length."""
        self.place = [g.place for g in block.grams[: len(counts)]]
        p = (counts[0] + ADD) / (total + ADD * (vocabulary + 1))
        states, state_of = 1, [np.zeros(1, np.int64)]  # the root is 0
        for k, c in enumerate(counts[:-1]):  # histories that training texts have and go on from, numbered by length
            seen = (c > 0) & ((block.grams[k].token != block.end) | (k == 0))
            state_of.append(np.where(seen, states + np.cumsum(seen) - 1, 0))
            states += int(seen.sum())
        self.length = np.zeros(states, np.int8)
        self.fail, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        self.source = [np.zeros(len(p), np.int64)]  # by length of the history: the state each arc starts from, its weight, where it leads
        self.weight = [np.log10(p)]
        self.next = [state_of[1] if len(counts) > 1 else np.zeros(len(p), np.int64)]
        self.seen = [np.ones(len(p), bool)]  # the root has an arc for every token
        self.start = int(self.next[0][block.end])
        for k in range(1, len(counts)):
            g, prior, past = block.grams[k], priors[k - 1], counts[k - 1]
            h = np.flatnonzero(state_of[k])
            self.length[state_of[k][h]] = k
            self.fail[state_of[k][h]] = 0 if k == 1 else state_of[k - 1][block.grams[k - 1].tail[h]]
            self.fail_weight[state_of[k][h]] = np.log10(prior / (past[h] + prior))
            seen = counts[k] > 0
            p = np.where(seen, (counts[k] + prior * p[g.tail]) / (past[g.past] + prior), 1.0)
            self.source.append(state_of[k][g.past])
            self.weight.append(np.log10(p))
            self.next.append(state_of[k + 1] if k + 1 < len(counts) else state_of[k][g.tail])
            self.seen.append(seen)

    def read(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-probabilities of the tokens at some positions after a state each; ``state`` becomes the states then."""
        score, length = np.zeros(len(state)), self.length[state]
        for k in range(len(self.weight) - 1, -1, -1):  # a failure arc leads to a history of one token less
            some = np.flatnonzero(length == k)
            gram = self.place[k][at[some]]
            there = self.seen[k][gram]
            yes, no = some[there], some[~there]
            score[yes] += self.weight[k][gram[there]]
            state[yes] = self.next[k][gram[there]]
            length[yes] = -1
            score[no] += self.fail_weight[state[no]]
            state[no] = self.fail[state[no]]
            length[no] = k - 1
        return score


def traverse(block: Block, automaton: Automaton) -> np.ndarray:
    """The log-probability of each text: the pieces of all texts go on together, each with its state and its sum."""
    cuts, warm = -(-block.sizes // PIECE), len(automaton.weight) - 1
    doc = np.repeat(np.arange(len(cuts)), cuts)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
    ahead = np.where(begin > 0, warm, 0)
    steps = np.minimum(PIECE, block.sizes[doc] - begin) + ahead
    by_steps = np.argsort(-steps, kind="stable")
    doc, begin, ahead, steps = doc[by_steps], begin[by_steps], ahead[by_steps], steps[by_steps]
    at, state, sums = block.first[doc] + begin - ahead, np.where(begin > 0, 0, automaton.start), np.zeros(len(doc))
    for t in range(int(steps[0]) if len(steps) else 0):
        n = int(np.searchsorted(-steps, -t, "left"))  # pieces with more than t steps
        score = automaton.read(state[:n], at[:n] + t)
        sums[:n] += np.where(t >= ahead[:n], score, 0)
    return np.bincount(doc, sums, len(cuts))


def score_block(block: Block, counts: list[np.ndarray], total: int, vocabulary: int, priors: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: n_known, base_score, score."""
    automaton = Automaton(block, counts, total, vocabulary, priors)
    upto = lambda x: np.add.reduceat(x, block.first) if len(x) else np.zeros(0)
    return upto((counts[0] > 0).astype(np.int64)[block.tokens]), upto(automaton.weight[0][block.tokens]), traverse(block, automaton)


def score_texts(docs: DataFrame, order: int = ORDER, priors: tuple[float, ...] = PRIORS, block_bytes: int = ex.BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    if len(priors) < order - 1:
        raise ValueError("each length of history needs a prior")
    blocks = ex.count_blocks(docs, text_col, block_bytes)
    own = ex.in_blocks(docs, blocks, id_col, text_col).repartition(blocks, "_block")
    deal = lambda df, key: df.repartition(blocks, key)  # noqa: E731 as many partitions as blocks, whatever the session's setting

    def read(table: pa.Table, upto: int) -> Block:
        memo.only("lm")
        return Block(table.column("_id").to_pylist(), whole(table.column("_text")), upto)

    def messages(number: int, lengths: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.Table:
        """A message to each bucket that has some of the keys; keys and counts by length."""
        cuts = [dict(zip(at.tolist(), own, strict=True)) for at, own in (ex.parts(k, blocks) for k in keys)]
        filled = sorted(set().union(*cuts))
        part = lambda x, c, b: x[c.get(b, slice(0, 0))]
        cols = [[[pack(part(x, c, b)) for x, c in zip(own, cuts, strict=True)] for b in filled] for own, pack in ((keys, ex.pack_keys), (counts, ex.pack_numbers))]
        n = len(filled)
        return pa.table([pa.array(filled, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([lengths] * n, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.binary())) for x in cols)], ["_bucket", "_block", "lengths", "keys", "counts"])

    def ask(table: pa.Table) -> pa.Table:
        block, some = read(table, min(2, order)), list(range(min(2, order)))
        return messages(table.column("_block")[0].as_py(), some, [block.grams[k].keys for k in some], [block.grams[k].counts for k in some])

    def merge(batch: pa.Table) -> pa.Table:
        asked, told = batch.column("keys").to_pylist(), batch.column("counts").to_pylist()
        lengths = batch.column("lengths")[0].as_py()
        totals: list[list[bytes]] = [[] for _ in asked]
        size = words = 0
        for i, k in enumerate(lengths):
            keys = [ex.unpack_keys(x[i]) for x in asked]
            counts = np.concatenate([ex.unpack_numbers(x[i]) for x in told])
            _, place, _ = ex.distinct(np.concatenate(keys))
            total = np.bincount(place, counts).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            if k == 0:
                size, words = int(total.sum()), int((total > 0).sum())
            at = 0
            for out, own_keys in zip(totals, keys, strict=True):
                out.append(ex.pack_numbers(total[place[at : at + len(own_keys)]]))
                at += len(own_keys)
        n = len(asked)
        return pa.table([batch.column("_block"), batch.column("_bucket"), batch.column("lengths"), pa.array([size] * n, pa.int64()), pa.array([words] * n, pa.int64()), pa.array(totals, pa.list_(pa.binary()))], ["_block", "_bucket", "lengths", "n", "v", "totals"])

    def learned(block: Block, answers: pa.Table, upto: int) -> list[np.ndarray]:
        """The counts in all training texts of the block's n-grams of up to ``upto`` tokens."""
        answers = answers.sort_by("_bucket")
        got: dict[int, list[np.ndarray]] = {}
        for lengths, totals in zip(answers.column("lengths").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            for k, x in zip(lengths, totals, strict=True):
                got.setdefault(k, []).append(ex.unpack_numbers(x))
        counts, elsewhere = [], []
        for k in range(upto):
            own = block.grams[k].counts.copy()
            own[block.asked(k, elsewhere)] = np.concatenate(got.get(k, [np.zeros(0, np.int64)]))
            counts.append(own)
            elsewhere.append(own - block.grams[k].counts)
        return counts

    def ask_longer(k: int):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            block = read(texts, k + 1)
            counts = learned(block, answers, k)
            some = block.asked(k, [c - g.counts for c, g in zip(counts, block.grams, strict=False)])
            g = block.grams[k]
            return messages(texts.column("_block")[0].as_py(), [k], [g.keys[some]], [g.counts[some]])

        return run

    def tell(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = read(texts, order)
        total, vocabulary = (answers.column(c)[0].as_py() if len(answers) else 0 for c in ("_total", "_vocabulary"))
        known, base, score = score_block(block, learned(block, answers, order), total, vocabulary, priors)
        return pa.table([texts.column("_id"), pa.array(block.held), pa.array(block.sizes), pa.array(known), pa.array(np.full(len(texts), total)), pa.array(base), pa.array(score)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asking, telling = "_bucket int, _block int, lengths array<int>, keys array<binary>, counts array<binary>", "_block int, _bucket int, lengths array<int>, n long, v long, totals array<binary>"
    first = deal(own.groupBy("_block").applyInArrow(ask, asking), "_bucket").groupBy("_bucket").applyInArrow(merge, telling)
    # the corpus' two sums come from the buckets, once each: a scalar subquery over the same exchange
    sums = first.groupBy("_bucket").agg(F.first("n").alias("n"), F.first("v").alias("v")).agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).alias("s"))
    answers = deal(first, "_block")
    for k in range(2, order):
        more = own.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(ask_longer(k), asking)
        answers = answers.unionByName(deal(deal(more, "_bucket").groupBy("_bucket").applyInArrow(merge, telling), "_block"))
    answers = answers.withColumn("_sums", sums.scalar()).withColumns({"_total": F.col("_sums.n"), "_vocabulary": F.col("_sums.v")}).drop("_sums")
    return own.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(tell, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
