"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling starts at the largest depth: conversations that end there merge with
the nodes that survive from below, all nodes of the depth are complete, their last turn is stripped and they are grouped
anew by what is left; counts, leaves and savings go up with them, so that nodes are found and aggregated in one pass.

Texts are shuffled once, to put turns in order: a turn becomes a digest of role and text and a count of code points, and a
conversation the chained digests of its prefixes. Equal conversations become one before anything is grouped, with their ids digested in order:
ids are dealt by range, so that a group of a third of all rows is rendered in parts, and a part is one row of the last step.
A prefix over which more than SUBTREE_TURNS turns of two or more conversations stand is crowded. Subtrees below crowded
prefixes are small: each is peeled in one task. What they give to the crowded nodes are sums, counts and least ids, which
Spark aggregates before it shuffles. The crowded nodes, a few for each SUBTREE_TURNS turns, are peeled depth by depth in
Spark until at most TOP_ROWS of them remain, and those in one task.

Edge cases: null roles and texts are empty; turns of one number are ordered by role and text, nulls last; null numbers come first;
turns that repeat are turns of their own; turns without a conversation id belong to no conversation; a conversation
without turns ends at the root; an empty table has no root. Other columns are not read. A conversation's chain of digests,
32 characters a turn, is held by the task that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import drop, join_groups, materialise, released, rows_out

#: Turns of one task's subtree, and crowded nodes of one task, at most.
SUBTREE_TURNS, TOP_ROWS = 2000, 10_000
#: Ids in a part of a node's list of ends.
PART_IDS = 20_000
ROOT = "0" * 32
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "least long, depth long, parent long, up string, n long, children long, leaves long, saved long, ends string"
TOP = "node string, " + NODE


def turn_keys(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, points) of each turn, positions from 0."""
    named = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *(F.col(c).cast("string").alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return named.withColumn("pos", F.row_number().over(order) - 1).select("conv", "pos", key.alias("key"), F.length(text).alias("points"))


def with_shared_heads(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % heads turns of conversation c - c % block in place of its own."""
    convs = turns.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    first = turns.where((F.col("conv") % block == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv", "base")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", "pos", "key", "points")
    shared = convs.withColumn("base", F.col("conv") - F.col("conv") % block).join(first, "base").where("pos < h").select("conv", "pos", "key", "points")
    marks = convs.select("conv", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("points"))
    return own.unionByName(shared).unionByName(marks)


def paths(turns: DataFrame) -> DataFrame:
    """(conv, size, path, points): digests of all prefixes from the root, and code points of the turns. Rows without pos only name a conversation."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path, points = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for name, pos, key, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "key", "points"))):
                if name != conv:
                    if path:
                        out.append((conv, path, points))
                    conv, path, points = name, [ROOT], []
                if pos is not None:
                    path.append(hashlib.blake2b(f"{path[-1]}{key}".encode(), digest_size=16).hexdigest())
                    points.append(n)
            yield _paths(out)
        if path:
            yield _paths([(conv, path, points)])

    return turns.select("conv", "pos", "key", "points").repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("pos")).mapInArrow(run, "conv long, size int, path array<string>, points array<int>")


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    conv, path, points = zip(*rows) if rows else ([], [], [])
    return rows_out({"conv": (list(conv), pa.int64()), "size": ([len(p) for p in points], pa.int32()), "path": (list(path), pa.list_(pa.string())), "points": (list(points), pa.list_(pa.int32()))})


def ends(seqs: DataFrame) -> DataFrame:
    """(node, least, n, ends): of the conversations that end at a node, the smallest id, their number and the digest of their ids."""

    @released
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def part() -> pa.RecordBatch:
            return rows_out({"node": ([node], pa.string()), "first": ([ids[0]], pa.int64()), "n": ([len(ids)], pa.int64()), "text": ([",".join(map(str, ids))], pa.string())})

        for batch in batches:
            for name, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (name != node or len(ids) == PART_IDS):
                    yield part()
                    ids = []
                node = name
                ids.append(conv)
        if ids:
            yield part()

    @released
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least, total, state = None, None, 0, None

        def whole() -> pa.RecordBatch:
            return rows_out({"node": ([node], pa.string()), "least": ([least], pa.int64()), "n": ([total], pa.int64()), "ends": ([state.hexdigest()], pa.string())})

        for batch in batches:
            for name, first, n, text in zip(*(batch.column(c).to_pylist() for c in ("node", "first", "n", "text"))):
                if name != node:
                    if total:
                        yield whole()
                    node, least, total, state = name, first, 0, hashlib.sha256()
                state.update(f"{',' if total else ''}{text}".encode())
                total += n
        if total:
            yield whole()

    placed = seqs.select(F.element_at("path", -1).alias("node"), "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    return placed.mapInArrow(parts, "node string, first long, n long, text string").repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, least long, n long, ends string")


class Node:
    __slots__ = ("n", "least", "children", "leaves", "saved", "ends", "row")

    def __init__(self, row: tuple):
        self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.row = 0, None, 0, 0, 0, None, row

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(least, self.least)

    def told(self, depth: int, parent: int | None, up: str | None) -> tuple:
        return self.least, depth, parent, up, self.n, self.children, self.leaves, self.saved, self.ends


def peel(rows: list[tuple], top: int) -> list[tuple]:
    """Nodes from depth `top` of one subtree, as NODE. rows: (least, n, ends, path, points) of its distinct conversations; `up` is given at the top alone."""
    ended: dict[int, list[tuple]] = {}
    for row in rows:
        ended.setdefault(len(row[4]), []).append(row)
    out: list[tuple] = []
    alive: dict[str, Node] = {}
    below: list[tuple[Node, Node]] = []
    for depth in range(max(ended), top - 1, -1):
        for row in ended.get(depth, ()):  # conversations that end here merge with what survives
            node = alive.setdefault(row[3][depth], Node(row))
            node.add(row[1], row[0])
            node.ends = row[2]
        out += [child.told(depth + 1, node.least, None) for child, node in below]
        stripped: dict[str, Node] = {}
        below = []
        for node in alive.values():
            node.leaves = node.leaves or 1
            path, points = node.row[3:]
            node.saved += (node.n - 1) * (points[depth - 1] if depth else 0)
            if depth == top:
                out.append(node.told(depth, None, path[depth - 1] if depth else None))
                continue
            above = stripped.setdefault(path[depth - 1], Node(node.row))
            above.add(node.n, node.least)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            below.append((node, above))
        alive = stripped
    return out


def subtrees(rows: DataFrame) -> DataFrame:
    """NODE of all nodes from depth `cut` of each row on; rows: least, n, ends, path, points, cut."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, depth, held = None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for name, cut, *row in zip(*(batch.column(c).to_pylist() for c in ("top", "cut", "least", "n", "ends", "path", "points"))):
                if name != top and held:
                    out += peel(held, depth)
                    held = []
                top, depth = name, cut
                held.append(tuple(row))
            yield _nodes(out)
        if held:
            yield _nodes(peel(held, depth))

    return rows.withColumn("top", F.get("path", F.col("cut"))).repartition("top").sortWithinPartitions("top").mapInArrow(run, NODE)


def _nodes(rows: list[tuple], schema: str = NODE) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return rows_out({name: (list(values), pa.string() if kind == "string" else pa.int64()) for (name, kind), values in zip(fields, columns)})


def crowd(items: DataFrame, bound: int) -> DataFrame:
    """(node, seqs, depth, up, points) of the prefixes over which more than `bound` turns of two or more conversations stand."""
    at = F.transform(F.sequence(F.lit(0), F.col("size")), lambda d: F.struct(d.alias("depth"), F.get("path", d).alias("node"), F.get("path", d - 1).alias("up"), F.get("points", d - 1).alias("points")))
    each = items.select((F.col("size") + 1).alias("turns"), F.inline(at))
    found = each.groupBy("node").agg(F.count("*").alias("seqs"), F.sum("turns").alias("turns"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.coalesce(F.first("points"), F.lit(0)).alias("points"))
    return found.where((F.col("seqs") > 1) & (F.col("turns") > bound)).drop("turns")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", subtree_turns: int | None = None, top_rows: int | None = None) -> DataFrame:
    """turns: conv, pos, key, points, as turn_keys gives them. One row per node: smallest member, depth, parent's smallest member, members, children, leaves, saved code points, digest of those that end here."""
    seqs = materialise(paths(turns))
    ended = materialise(ends(seqs))
    items = materialise(ended.join(seqs.withColumnRenamed("conv", "least"), "least").select("least", "n", "ends", "path", "points", "size"))
    crowded = materialise(crowd(items, SUBTREE_TURNS if subtree_turns is None else subtree_turns))
    drop(seqs, ended)
    each = items.select("least", F.posexplode("path").alias("depth", "node"))
    cuts = join_groups(each, crowded.select("node", "seqs"), "node", "seqs", F.col("least").cast("string")).where("seqs IS NOT NULL")
    cuts = cuts.groupBy("least").agg((F.max("depth") + 1).alias("cut"))
    items = items.join(cuts, "least", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    nodes = materialise(subtrees(items.where("cut <= size")))
    # what subtrees and ended conversations give to the crowded node above them
    given = _given(nodes)
    zero = F.lit(0).cast("long")
    here = items.where("cut > size").select(F.get("path", F.col("size")).alias("node"), "n", "least", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    left = materialise(_added(crowded.select("node", F.col("depth").cast("long").alias("depth"), "up", "points"), given.unionByName(here)))
    top = _peel_top(left, TOP_ROWS if top_rows is None else top_rows)
    drop(crowded, left)
    # parents of the nodes right below a crowded one
    parents = top.select(F.col("node").alias("up"), F.col("least").alias("above"), F.col("children").alias("size"))
    whole = nodes.unionByName(top.drop("node"))
    whole = join_groups(whole, parents, "up", "size", F.col("least").cast("string"))
    long = {"depth": "depth", "n_convs": "n", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved"}
    return whole.select(F.col("least").alias(conv_col), F.coalesce("parent", "above").alias(f"parent_{conv_col}"), *(F.col(c).cast("long").alias(name) for name, c in long.items()), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def _given(nodes: DataFrame) -> DataFrame:
    """What complete nodes give to the node above each."""
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved")]
    return nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.min("least").alias("least"), F.count("*").alias("children"), *sums, F.lit(None).cast("string").alias("ends"))


def _added(nodes: DataFrame, given: DataFrame) -> DataFrame:
    """nodes (node, depth, up, points) with the sums of what is given to each."""
    kept = [c for c in nodes.columns if c in ("node", "depth", "up", "points")]
    both = nodes.withColumns({k: F.lit(None).cast(t) for k, t in (("n", "long"), ("least", "long"), ("children", "long"), ("leaves", "long"), ("saved", "long"), ("ends", "string")) if k not in nodes.columns})
    both = both.unionByName(given.withColumns({c: F.lit(None).cast(nodes.schema[c].dataType) for c in kept if c != "node"}))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "children", "leaves", "saved")]
    return both.groupBy("node").agg(*(F.max(c).alias(c) for c in kept if c != "node"), F.min("least").alias("least"), F.max("ends").alias("ends"), *sums)


def _peel_top(left: DataFrame, bound: int) -> DataFrame:
    """TOP of all crowded nodes; left: their sums without those of their crowded children."""
    done = []
    while left.limit(bound + 1).count() > bound:
        deepest = left.agg(F.max("depth")).first()[0]
        complete = left.where(F.col("depth") == deepest).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("points"))
        done.append(materialise(complete))
        left = materialise(_added(left.where(F.col("depth") < deepest), _given(done[-1])))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, dict[str, dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                levels.setdefault(row["depth"], {})[row["node"]] = row
        for depth in sorted(levels, reverse=True):
            for row in levels[depth].values():
                row["saved"] += (row["n"] - 1) * row["points"]
                if depth:
                    above = levels[depth - 1][row["up"]]
                    above["least"] = row["least"] if above["least"] is None else min(above["least"], row["least"])
                    above["children"] += 1
                    for c in ("n", "leaves", "saved"):
                        above[c] += row[c]
        yield _nodes([(r["node"], r["least"], r["depth"], None, r["up"], r["n"], r["children"], r["leaves"], r["saved"], r["ends"]) for level in levels.values() for r in level.values()], TOP)

    out = left.repartition(1).mapInArrow(run, TOP)
    for level in done:
        out = out.unionByName(level.withColumn("parent", F.lit(None).cast("long")).drop("points"))
    return materialise(out)
