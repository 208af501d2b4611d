"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from reachlens.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, audit string, _code int"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits, repaired) by uniform-cost search: rows (role, text) in order; nothing shared, edits compared as strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, initials, out = heapq.heappop(heap)
        state = at, initials[-1:], len(initials) > 0
        if (cost, edits, *state) in done:
            continue
        done.add((cost, edits, *state))
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, edits, list(out)
        moves = [(3, "I", at, k, (r, "")) for k, r in (("u", "user"), ("a", "assistant"))]
        if at < len(rows):
            role, text, gone, more = rows[at]
            moves.append((4, "D", at + 1, "", None))
            if not gone:
                moves += [(more, "K", at + 1, role[:1], (role, text))] + [(3 + more, "R", at + 1, k, (r, text)) for k, r in (("u", "user"), ("a", "assistant"))]
        for more, edit, to, kind, made in moves:
            if edit == "K" and kind not in ("s", "u", "a"):
                continue
            now = initials + kind
            if kind and not re.fullmatch(r"s?(ua)*u?", now):
                continue
            if edit == "I" and edits.endswith("III"):
                continue
            heapq.heappush(heap, (cost + more, edits + edit, to, now, out + ((made,) if made else ())))


def plain(rows):
    """The query's answer for each conversation, one at a time. rows: (conv_id, turn, role, text)."""
    out = {}
    for key, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        after = []
        for _, turn, role, text in own:
            role, text = role if role is not None else " ", text if text is not None else " "
            code = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in after if t is not None]
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in after:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        cost, edits, repaired = cheapest(marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[key] = (gaps, *faults.values(), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        start = rng.choice([0, 0, -3, 5])
        for k in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursa"])
            text = rng.choice(["Yes.", "No!", "Why?  \n", "and then", " \t", "", None, "é…", "Yes. ", "a "])
            rows.append((key, rng.choice([start + k, start + k, start + 2 * k, None]), role, text))
    return rows + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 0, "user", "Hi.")] + rows[:4]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_exhaustive_search(spark, seed):
    rows = made(seed, 150)
    rng = random.Random(seed)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    found = conversation.digest(conversation.repair(conversation.damaged(docs), "there")).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain(rows) and len(found) == len({r[0] for r in rows})


def test_long_conversations_and_none(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(3000)] + [(2, 0, "system", "x" * 300_000), (2, 1, "user", "y. " * 100_000)]
    found = {r.conv_id: r for r in conversation.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1].cost, found[1].audit) == (6, "I" + "K" * 3000 + "I")
    assert [r.role for r in found[1].repaired[:3]] == ["user", "assistant", "user"] and len(found[1].repaired) == 3002
    assert (found[2].truncated, found[2].cost, found[2].audit) == (1, 6, "KKI")
    assert conversation.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_layers_are_shared(monkeypatch):
    calls = []
    real = conversation.following
    monkeypatch.setattr(conversation, "following", lambda layer, letter: calls.append(letter) or real(layer, letter))
    conversation.solved(["suaua", "suaua", "suauad", "suau", "ua"])
    assert len(calls) == len("suauad") + len("ua")  # a node each
