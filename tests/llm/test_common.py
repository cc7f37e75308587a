"""Memos and held objects stay within their bounds."""

from plotmark.llm import common


def test_memo_is_bounded():
    made = []
    memo = common.Memo(lambda k: made.append(k) or k.upper(), limit=3, longest=4, always={"z": "fixed"})
    assert [memo[k] for k in ("a", "b", "a", "z", "toolong", "toolong")] == ["A", "B", "A", "fixed", "TOOLONG", "TOOLONG"]
    assert made == ["a", "b", "toolong", "toolong"]
    memo["c"], memo["d"]
    assert len(memo) <= 3 and memo["z"] == "fixed"


def test_only_the_latest_objects_are_held(monkeypatch):
    monkeypatch.setattr(common, "_HELD", {})
    made = []
    for key in ("a", "b", "a", "c", "a", "b"):
        assert common.held(key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "c", "b"] and len(common._HELD) == 2
