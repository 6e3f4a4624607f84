"""Pairs of many turns: masks and order hold over the whole pair, however it is cut into pieces."""

import random

import pytest

from tessera.llm import chat_format

SCHEMA = "pair_id long, turn long, role string, text string"
SAY = "<|{}|>\n{}<|end|>\n".format


def whole(rows):
    """Each part's string of the pair put together, and what its masks say."""
    rows = sorted(rows, key=lambda r: [int(x) for x in (r.piece + "/0").split("/")[:2]])
    out = {}
    for part in chat_format.PARTS:
        text = "".join(r[part] for r in rows)
        assert all(text[r[f"{part}_at"] :].startswith(r[part]) for r in rows)
        masks = [] if part == "prompt" else [[r[f"{part}_at"] + int(x) for x in m.split("-")] for r in rows for m in r[f"{part}_mask"].split(",") if m]
        out[part] = (text, [text[a:b] for a, b in masks])
    return out


@pytest.mark.parametrize("turns, rows", [(256, 4096), (10, 4096), (256, 50), (7, 3)])
def test_a_pair_of_a_thousand_turns(spark, monkeypatch, turns, rows):
    monkeypatch.setattr(chat_format, "PIECE_TURNS", turns)
    monkeypatch.setattr(chat_format, "PIECE_ROWS", rows)
    r = random.Random(turns)
    shared = [(1, k, r.choice(["user", "assistant"]), f"s{k}") for k in range(300)]
    sides = {x: [(1, k, ["user", "assistant"][k % 2], f"{x}{k}" * r.randint(0, 3)) for k in range(300, 1000)] for x in ("c", "r")}
    chosen, rejected = (spark.createDataFrame(shared + sides[x] + [(2, 0, "user", "other")], SCHEMA).repartition(3) for x in ("c", "r"))
    got = [x for x in chat_format.pair_preferences(chosen, rejected).collect() if x.pair_id == 1]
    found = whole(got)
    if rows == 4096:  # one row of each turn: the order is that of the turns
        assert found["prompt"][0] == "".join(SAY(role, text) for _, _, role, text in shared)
        for part, x in (("chosen", "c"), ("rejected", "r")):
            assert found[part][0] == "".join(SAY(role, text) for _, _, role, text in sides[x])
            assert found[part][1] == [text + "<|end|>\n" for _, _, role, text in sides[x] if role == "assistant"]
    else:
        for part, x in (("chosen", "c"), ("rejected", "r")):
            assert sorted(found[part][1]) == sorted(text + "<|end|>\n" for _, _, role, text in sides[x] if role == "assistant")
    assert len(got) > 1 and len({x.piece for x in got}) == len(got)


def test_a_pair_in_one_piece_begins_at_its_start(spark):
    chosen = spark.createDataFrame([(3, 0, "user", "a"), (3, 1, "assistant", "b")], SCHEMA)
    (row,) = chat_format.pair_preferences(chosen, chosen).collect()
    assert (row.prompt_at, row.chosen_at, row.rejected_at) == (0, 0, 0)
