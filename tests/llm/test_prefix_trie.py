"""The prefix trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import prefix_trie as T


def rebuilt(rows):
    """rows: (conv, turn, role, text). Sequences by conversation."""
    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append((turn[0] is not None, turn[0] or 0, turn[1] or "", turn[2] or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(seqs):
    """Sorted rows: conv, depth, parent, members, children, leaves, saved, ends."""
    nodes = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(seqs[c]) == len(path)))
        parent = min(nodes[path[:-1]]) if path else -1
        out.append((min(members), len(path), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn long, role string, text string, pos int, depth int, node string").repartition(3)


def told(got):
    assert len(got.columns) == 8
    rows = got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


def talk(seed, n):
    r = random.Random(seed)
    opening = [[("user", f"hello {k}"), ("assistant", "hé" * k), ("user", None), (None, "x")] for k in range(3)]
    rows = []
    for c in r.sample(range(450), n):
        turns = r.choice(opening)[: r.randint(0, 4)] + [(r.choice(["user", "assistant"]), r.choice("abc")) for _ in range(r.choice([0, 1, 2, 5, 9]))]
        rows += [(c, None if d == 0 and r.random() < 0.3 else d, *t) for d, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("subtree, top, part", [(2000, 10_000, 20_000), (25, 10_000, 3), (6, 2, 1), (0, 0, 1)])
def test_trie(spark, monkeypatch, subtree, top, part):
    monkeypatch.setattr(T, "PART_IDS", part)
    rows = talk(subtree, 140)
    turns = T.with_shared_heads(T.turn_keys(frame(spark, rows)))
    assert told(T.prefix_trie(turns, subtree_turns=subtree, top_rows=top)) == brute(rebuilt(rows))


def test_nulls_repeats_and_turnless(spark):
    rows = [(None, 0, "user", "lost"), (7, 0, None, None), (7, 0, None, None), (7, None, "user", "first"), (8, 1, "user", "x"), (9, 0, "user", "only"), (200, 0, "user", "base"), (201, 0, "user", "y"), (-3, 0, "user", "x")]
    want = rebuilt([r for r in rows if r[0] != -3])
    h = zlib.crc32(b"-3") % 6
    want[-3] = [("user", "x")][h:] if 0 not in want else want[0]
    assert told(T.prefix_trie(T.with_shared_heads(T.turn_keys(frame(spark, rows))))) == brute(want)
    assert any(not turns for turns in want.values())


def test_one_group_of_copies(spark):
    rows = [(c, d, "user", "same" * d) for c in range(0, 60000, 100) for d in range(3)] + [(c, d, "user", f"{c}") for c in range(1, 20) for d in range(2)]
    turns = T.with_shared_heads(T.turn_keys(frame(spark, rows)))
    assert told(T.prefix_trie(turns, subtree_turns=4)) == brute(rebuilt(rows))


def test_long_shared_preamble(spark):
    rows = [(c * 100, d, "user", f"p{d}" if d < 150 else f"{c}") for c in range(5) for d in range(152)]
    turns = T.with_shared_heads(T.turn_keys(frame(spark, rows)))
    assert told(T.prefix_trie(turns, subtree_turns=400)) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert T.prefix_trie(T.with_shared_heads(T.turn_keys(frame(spark, [])))).count() == 0


def test_very_long_text(spark):
    rows = [(c, d, "user", "é" * 2_000_000 if d == 0 else "t") for c in (0, 300) for d in range(2)]
    got = told(T.prefix_trie(T.turn_keys(frame(spark, rows)).where("pos IS NOT NULL")))
    assert got == brute({c: [("user", "é" * 2_000_000), ("user", "t")] for c in (0, 300)})


def test_turns_of_one_number_are_ordered_by_role_and_text(spark):
    words = ["b", "a", "", None, "é", "B", "a" * 40 + "2", "a" * 40 + "1"]
    rows = [(c, turn, role, text) for c in (100, 101, 250) for turn in (None, 0, 1) for role in ("user", "assistant", None) for text in words[c % 3 :]]
    random.Random(1).shuffle(rows)
    last = lambda x: (x is None, x or "")
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, last(r[2]), last(r[3]))):
        own.setdefault(c, []).append((role or "", text or ""))
    want = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + turns[zlib.crc32(str(c).encode()) % 6 :] for c, turns in own.items()}
    assert told(T.prefix_trie(T.with_shared_heads(T.turn_keys(frame(spark, rows))))) == brute(want)
