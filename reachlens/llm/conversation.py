"""Repair of damaged conversations: the cheapest edits that make the roles alternate, found by a dynamic program shared over a trie.

The roles of a whole conversation read ``(s?(ua)+)?``: nothing, or user and assistant in turn, perhaps after one system turn.
A conversation's *signature* has a letter a row: its role's initial and its fault, which is all that the edits' costs depend on.
The signatures of a batch of conversations are sorted, which is the order of a walk through their prefix trie; the layer of the dynamic
program at a node is worked out once and serves all conversations that share the prefix, and terminal nodes give the answers.

Defined results: null ids make one conversation; null roles and texts count as one space; rows without a turn come first; rows of one turn are
ordered by role, then text, so repeated rows are duplicates of the first; a role whose first letter isn't s, u or a (an empty one too)
is never kept. A conversation is one unit, as a document's text is: its rows are in one task, since its answer is one row. Only the four
columns named are read, so further columns can't clash. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What edits cost. A row that ends in the middle of a sentence costs TRUNCATED more unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: The states: nothing yet, after the system's turn, after a user's, after an assistant's; whole conversations end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What is inserted or what a row is given in each state: the one turn that may follow, of those that may be made up.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Characters of conversations that are worked off together.
BATCH_CHARS = 1 << 22

#: A state's best way: its cost, its rank among the ways of the same layer, the state before and the edits since (inserts, then the row's).
Way = tuple[int, int, int, str]
Layer = dict[int, Way]

FIRST: Layer = {START: (0, 0, START, "")}


def inserted(layer: Layer) -> list[tuple[int, int, int, str, int]]:
    """(state, cost, rank, inserts, state before) of all that up to two inserted turns make of a layer's ways."""
    out = []
    for before, (cost, rank, _, _) in layer.items():
        state = before
        for n in range(3):
            out.append((state, cost + n * INSERT, rank, "I" * n, before))
            state = STEPS[NEXT[state]][state]
    return out


def following(layer: Layer, letter: str) -> Layer:
    """The layer after one more row.

    Of equal costs the way with the ASCII-least edits stays. Ways of one layer have equally many edits of rows and end in one, so none is the
    beginning of another, and what comes first among them stays first whatever follows: ranks stand for the edits themselves.
    """
    made: dict[int, tuple[int, int, str, int]] = {}

    def offer(state: int, cost: int, rank: int, edits: str, before: int) -> None:
        if state not in made or (cost, rank, edits) < made[state][:3]:
            made[state] = cost, rank, edits, before

    kind, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for state, cost, rank, edits, before in inserted(layer):
        offer(state, cost + DELETE, rank, edits + "D", before)
        if kind != "d":
            if state in STEPS.get(kind, ()):
                offer(STEPS[kind][state], cost + extra, rank, edits + "K", before)
            offer(STEPS[NEXT[state]][state], cost + REROLE + extra, rank, edits + "R", before)
    order = {state: k for k, state in enumerate(sorted(made, key=lambda s: made[s][1:3]))}
    return {state: (cost, order[state], before, edits) for state, (cost, _, edits, before) in made.items()}


def answer(layers: list[Layer]) -> tuple[int, str]:
    """(cost, edits) at a terminal node, whose path from the root has these layers."""
    cost, _, edits, state = min((c, r, e, before) for s, c, r, e, before in inserted(layers[-1]) if s in (START, ASSISTANT))
    parts = [edits]
    for layer in reversed(layers):
        _, _, state, edits = layer[state]
        parts.append(edits)
    return cost, "".join(reversed(parts))


def solved(signatures: Iterable[str]) -> dict[str, tuple[int, str]]:
    """(cost, edits) of each signature: a walk through their trie, whose layers are those of the path to where it stands."""
    out: dict[str, tuple[int, str]] = {}
    path, layers = "", [FIRST]
    for signature in sorted(set(signatures)):
        shared = 0
        while shared < min(len(path), len(signature)) and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(following(layers[-1], letter))
        path, out[signature] = signature, answer(layers)
    return out


def letters(rows: list[tuple[str, str]]) -> tuple[str, dict[str, int]]:
    """The signature of a conversation's rows (role, text) and the counts of their first faults: d must go, capitals end in the middle."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for row in rows:
        role, text = row
        end = text.rstrip(SPACE)[-1:]
        kind = role[:1] if role[:1] in STEPS else "x"
        if not end or row in seen:
            counts["blank" if not end else "duplicate"] += 1
            kind = "d"
        elif end not in ".!?":
            counts["truncated"] += 1
            kind = kind.upper()
        seen.add(row)
        out.append(kind)
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905 pairs of neighbours
    return "".join(out), counts


def edited(rows: list[tuple[str, str]], edits: str) -> list[dict[str, str]]:
    """The repaired conversation."""
    out, left, state = [], iter(rows), START
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        kind = role[:1] if edit == "K" else NEXT[state]
        out.append({"role": role if edit == "K" else ROLES[kind], "text": text})
        state = STEPS[kind][state]
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repaired(batch: list[tuple[object, int, list[tuple[str, str]]]]) -> pa.RecordBatch:
    """The answers of some whole conversations: (id, gaps, rows)."""
    told = [letters(rows) for _, _, rows in batch]
    found = solved(signature for signature, _ in told)
    out: dict[str, list] = {k: [] for k in ("conv_id", *COUNTS, "audit", "repaired")}
    for (key, gaps, rows), (signature, counts) in zip(batch, told, strict=True):
        cost, edits = found[signature]
        for name, value in zip(out, (key, gaps, *counts.values(), cost, edits, edited(rows, edits)), strict=True):
            out[name].append(value)
    kinds = {"audit": pa.string(), "repaired": TURNS}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text; a null text is no row, only tells that the conversation exists) in order to answers."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held, size = [], 0
    for key, own in groupby(rows(), key=lambda r: r[0]):
        turns, kept = set(), []
        for _, turn, role, text in own:
            if text is not None:
                kept.append((role, text))
                size += len(text)
                if turn is not None:
                    turns.add(turn)
        held.append((key, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kept))
        size += 64
        if size > BATCH_CHARS:
            yield repaired(held)
            held, size = [], 0
    if held:
        yield repaired(held)


def repair(rows: DataFrame, exists: str | None = None) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): gaps among its turns, its rows' first faults (blank, duplicate,
    truncated), illegal neighbours, the cost of the cheapest repair, its edits (audit: K keep, R rerole, D delete, I insert) and the
    repaired turns. Rows where ``exists`` (a boolean column) is false only tell that their conversation exists.

    One shuffle, by conversation; within a task sorted rows stream through, some whole conversations at a time.
    """
    held = lambda c: F.coalesce(F.col(c), F.lit(" "))
    there = F.col(exists) if exists else F.lit(True)
    read = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), held("role").alias("role"), F.when(there, held("text")).alias("text"))
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired array<struct<role:string,text:string>>"
    return dealt.mapInArrow(walk, schema)


# The damage of the query


def damage_code() -> Column:
    """What happens to a row: the checksum of its id and turn, modulo 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults of every kind, and ``there``: false for rows that were dropped."""
    code, held = F.col("_code"), lambda c: F.coalesce(F.col(c), F.lit(" "))
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(held("text"), ".!?", "")).otherwise(held("text"))
    marked = rows.select("conv_id", "turn", "role", "text", damage_code().alias("_code"))
    times = F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))
    return marked.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(held("role")).alias("role"), text.alias("text"), (code != 0).alias("there"), F.explode(times).alias("_again")).drop("_again")


def digest(found: DataFrame) -> DataFrame:
    """The answers with the repaired turns as one checksum: ``role:text``, a line each."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
