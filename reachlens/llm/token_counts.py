"""Token counts with a whole-token shortcut.

A text without runs of spaces falls apart, for a SentencePiece BPE model, into pre-tokens at its spaces: no piece
other than runs of the space mark holds that mark after its first character, so no merge crosses a pre-token's
start. ``prove`` checks this once per vocabulary, and finds the strings that encode alone as one token: they are
counted directly. Only the other pre-tokens go through the library's merges, each once while it is remembered.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts with runs of spaces, a leading or trailing
space, the space mark itself or a NUL are encoded whole by the library; repeated rows give repeated results; an empty
table gives an empty one. Texts of any length are counted whole, each in one piece; only the id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from reachlens.llm import memo
from reachlens.llm.text import map_texts

MARK = "▁"
#: Pre-tokens remembered by a worker at most, and characters of them; beyond, it starts anew. Longer pre-tokens than LONG are counted each time.
MEMO, MEMO_CHARS, LONG = 400_000, 4_000_000, 64


@functools.lru_cache(2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def prove(path: str) -> frozenset[str] | None:
    """The pre-tokens (without the space mark) that alone give one token; None if pre-tokens can't be told apart."""
    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(MARK in p[1:] and p.strip(MARK) for p in pieces):
        return None
    # the model must neither rewrite its input nor drop white space, or a pre-token in a text isn't one alone
    probe = "x  ﬁ ①\ty"
    if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str)[0] != MARK + "a":
        return None
    words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and p.strip(MARK)]
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1)


@functools.lru_cache(2)
def memory(path: str) -> dict[str, int]:
    return dict.fromkeys(prove(path) or (), 1)


@functools.lru_cache(2)
def held(path: str) -> list[int]:
    """How many characters of pre-tokens are remembered beyond the proven ones."""
    return [0]


memo.remembers("token_counts", memory.cache_clear)
memo.remembers("token_counts", held.cache_clear)


def trim(path: str, new: list[str]) -> None:
    """After ``new`` pre-tokens were learned: forgets the long ones, and all but the proven ones where they are too many."""
    known = memory(path)
    for w in new:
        if len(w) > LONG:
            del known[w]
        else:
            held(path)[0] += len(w)
    if len(known) > MEMO or held(path)[0] > MEMO_CHARS:
        known.clear()
        known.update(dict.fromkeys(prove(path) or (), 1))
        held(path)[0] = 0


@functools.lru_cache(2)
def openers(path: str) -> np.ndarray:
    """By id: does the piece open a pre-token?"""
    sp = processor(path)
    return np.array([sp.id_to_piece(i)[0] == MARK for i in range(sp.get_piece_size())])


def merge(words: list[str], path: str) -> list[int]:
    """Tokens of each pre-token, by the library's merges: one call for many, told apart by the pieces that open them."""
    out: list[int] = []
    for i in range(0, len(words), 500):
        ids = np.array(processor(path).encode(" ".join(words[i : i + 500])))
        out += np.diff(np.append(np.flatnonzero(openers(path)[ids]), len(ids))).tolist()
    return out


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library gives them."""
    sp, known = processor(path), memory(path)
    plain = prove(path) is not None
    out: list[int | None] = [None] * len(texts)
    whole, split = [], []
    for i, x in enumerate(texts):
        if not plain or "  " in x or MARK in x or "\0" in x or x[:1] == " " or x[-1:] == " ":
            whole.append(i)
        elif x:
            split.append((i, x.split(" ")))
        else:
            out[i] = 0
    rest = list({w for _, words in split for w in words if w not in known})
    known.update(zip(rest, merge(rest, path), strict=True))
    for i, words in split:
        out[i] = sum(map(known.__getitem__, words))
    trim(path, rest)
    for i, ids in zip(whole, sp.encode([texts[i] for i in whole], num_threads=1), strict=True):
        out[i] = len(ids)
    return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every whole text."""

    def work(texts: list[bytes]) -> dict:
        n = count_texts([x.decode("utf-8", "replace") for x in texts], model_path)
        return {"n_bytes": [len(x) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, work, "n_bytes long, n_tokens long, over_limit boolean", "token_counts", id_col, text_col)
