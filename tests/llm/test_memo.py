"""What workers remember."""

from reachlens.llm import memo


def test_others_forget(monkeypatch):
    monkeypatch.setattr(memo, "_forget", {})
    monkeypatch.setattr(memo, "_last", [])
    held = {"a": [1], "b": [2]}
    for name in held:
        memo.remembers(name, held[name].clear)
    memo.only("a")
    assert held == {"a": [1], "b": []}
    held["b"].append(3)
    memo.only("a")  # the same operator goes on
    assert held["b"] == [3]
    memo.only("c")
    assert held == {"a": [], "b": []}
