"""SimHash near-dedup: fingerprints compared bit-sliced, documents grouped by what they reach.

A text's fingerprint has bit b set if b is set in over half of the hashes of its word shingles. Fingerprints of at most
`radius` unlike bits are linked. The 64 bits are cut into radius + 2 stretches; two linked fingerprints agree on two of
them at least, so each distinct fingerprint goes into one bucket for each pair of stretches, and every link lies in some
bucket. Within a bucket bit planes stand vertically: a word of a plane holds one bit of 64 fingerprints. One query meets
64 of them at once, two planes a step, in carry-save counters; a word is left as soon as all its lanes exceed the
radius, or once all its lanes are known to hang together with the query, which keeps buckets of near copies
linear. A bucket of over BLOCK fingerprints is dealt in blocks that meet in cells of their own. What comes out of a cell
is one edge per member to the first of its group, never the pairs; groups of all cells meet in distributed components.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows are copies of each other; null ids never name a group that has another id, and
groups of null ids only have a null component; an empty table gives no rows. Other columns are not read.
A long text is read in stretches of CHUNK bytes. 64-bit bucket keys may collide: then more is compared, links stay exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import drop, join_groups, materialise, released, rows_out, sliced
from tessera.llm.components import connected_components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one side of a cell.
BLOCK = 16384
#: Queries against words that are counted at a time.
STEP = 8192
BATCH_BYTES, CHUNK = 4 << 20, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
ALL = np.uint64(2**64 - 1)


def shingles(data: bytes, width: int, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """64-bit hashes of the shingles of a text's words, some at a time."""
    at, held, seen = 0, [], False
    while at < len(data):
        end = SPACE.search(data, at + chunk)
        end = end.start() if end else len(data)
        found = held + data[at:end].split()  # by exactly the bytes of SPACE
        at = end
        if at < len(data) and len(found) < width:
            held = found
            continue
        if len(found) >= width or found and not seen:
            seen = True
            joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
            n, last = max(1, len(found) - width + 1), min(width, len(found)) - 1
            starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:].tolist())], np.uint64)
        held = found[len(found) - width + 1 :] if width > 1 else []


def fingerprint(text: bytes | None, width: int = WORDS, chunk: int = CHUNK) -> int:
    count, n = np.zeros(64, np.int64), 0
    for hashes in shingles((text or b"").lower(), width, chunk):
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text. (id, fp)"""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH_BYTES):
            texts = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())], ["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def masks(radius: int) -> list[int]:
    """Pairs of the radius + 2 stretches as signed 64-bit masks."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    stretch = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [(a | b) - ((a | b) >> 63 << 64) for a, b in combinations(stretch, 2)]


def exceeding(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (its bits, lowest first) is over the radius."""
    over, level = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for bit in reversed(range(len(counter))):
        if radius >> bit & 1:
            level = level & counter[bit]
        else:
            over |= level & counter[bit]
            level = level & ~counter[bit]
    return over


class Lanes:
    """Fingerprints laid out 64 to a word, in vertical bit planes; cells up to 64 share no word's border."""

    def __init__(self, fps: np.ndarray, sizes: list[int], splits: list[int]):
        """sizes: members of each cell in turn; splits: its first members that only meet the others, or 0 if all meet all."""
        lane, first, last, at, done = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), 0, 0
        for size, split in zip(sizes, splits):
            for part in (split, size - split):
                at += -at % 64 if part > 64 - at % 64 else 0
                lane[done : done + part] = np.arange(at, at + part)
                at, done = at + part, done + part
            mine = slice(done - size, done)
            first[mine] = lane[mine] // 64
            last[mine] = (at - 1) // 64
            if split:
                first[done - size : done - size + split] = lane[done - size + split] // 64
                last[done - size + split : done] = -1
        self.fps, self.lane, self.first, self.last, self.words = fps, lane, first, last, -(-at // 64)
        spread = np.zeros(self.words * 64, np.uint64)
        spread[lane] = fps
        bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        used = np.zeros(self.words * 64, np.uint8)
        used[lane] = 1
        self.free = ~np.packbits(used, bitorder="little").view(np.uint64)
        self.member = np.full(self.words * 64, -1, np.int64)
        self.member[lane] = np.arange(len(fps))

    def near(self, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members: each query with the members of its word within the radius that stand behind it."""
        over = self.free[word]
        own = self.lane[query] // 64 == word
        over[own] |= ALL >> (np.uint64(63) - (self.lane[query[own]] % 64).astype(np.uint64))
        counter = [np.zeros(len(query), np.uint64) for _ in range(3)]
        asked = self.fps[query]
        for b in range(0, 64, 2):
            x, y = (self.planes[k][word] ^ (np.uint64(0) - (asked >> np.uint64(k) & np.uint64(1))) for k in (b, b + 1))
            ones, twos, fours = counter
            half = ones ^ x
            carry = ones & x | half & y
            more = twos & carry
            over |= fours & more
            counter = [half ^ y, twos ^ carry, fours ^ more]
            if b % 8 == 6:
                over |= exceeding(counter, radius)
                left = np.flatnonzero(over != ALL)
                if len(left) < len(query):
                    query, word, asked, over, counter = query[left], word[left], asked[left], over[left], [c[left] for c in counter]
                if not len(left):
                    break
        at, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[at], self.member[word[at] * 64 + bit]

    def groups(self, radius: int) -> np.ndarray:
        """For each member the first member of its group."""
        label = np.arange(len(self.fps))
        low, high = np.full(self.words * 64, len(self.fps)), np.full(self.words * 64, -1)
        for step in range(int((self.last - self.first).max(initial=-1)) + 1):
            asks = np.flatnonzero(self.first + step <= self.last)
            for k in range(0, len(asks), STEP):
                query = asks[k : k + STEP]
                word = self.first[query] + step
                if step:  # what is one group with the query needs no look
                    low[self.lane] = high[self.lane] = label
                    least, most = low.reshape(-1, 64).min(1)[word], high.reshape(-1, 64).max(1)[word]
                    open_ = (least != label[query]) | (most != label[query])
                    query, word = query[open_], word[open_]
                if len(query):
                    label = merged(label, *self.near(query, word, radius))
        return label


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the groups of each pair made one; a group's label is its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def links(placed: DataFrame, radius: int) -> DataFrame:
    """placed: cell, side (0 meets 1; 2 meets all), fp. (a, b): each member of a group but its first, with the first."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps, sizes, splits = None, [], [], []

        def flush() -> pa.RecordBatch:
            lanes = Lanes(np.concatenate(fps).view(np.uint64), sizes, splits)
            a = lanes.fps.view(np.int64)
            b = a[lanes.groups(radius)]
            return rows_out({"a": (a[a != b], pa.int64()), "b": (b[a != b], pa.int64())})

        for batch in batches:
            name, side, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side", "fp"))
            cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])).tolist() if len(name) else []
            for i, j in zip(cuts, [*cuts[1:], len(name)]):
                if name[i] != cell:
                    if sum(sizes) >= BLOCK:
                        yield flush()
                        fps, sizes, splits = [], [], []
                    cell = name[i]
                    sizes.append(0)
                    splits.append(0)
                fps.append(own[i:j])
                sizes[-1] += j - i
                splits[-1] += int((side[i:j] == 0).sum())
        if sizes:
            yield flush()

    return placed.select("cell", "side", "fp").repartition("cell").sortWithinPartitions("cell", "side", "fp").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id that its links reach, its own included)."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold radii from 0 to 7")
    marked = materialise(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), width))
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    keyed = nodes.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(radius))))).alias("bucket"))
    sizes = materialise(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    held = join_groups(keyed, sizes, "bucket", "n", F.col("fp").cast("string")).where("n IS NOT NULL")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    held = held.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    whole = held.where("blocks = 1").select(F.col("bucket").alias("cell"), F.lit(2).alias("side"), "fp")
    dealt = held.where("blocks > 1").select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "met"), F.greatest("own", "met")).alias("cell"), side.alias("side"), "fp")
    edges = materialise(links(whole.unionByName(dealt), radius).distinct())
    groups = connected_components(edges, "a", "b")
    found = materialise(nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component")))
    drop(nodes, sizes, edges)
    named = found.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = materialise(join_groups(found, materialise(named), "component", "n", F.col("fp").cast("string")).select("fp", "copies", "component_id"))
    out = join_groups(marked, named, "fp", "copies", F.col("id").cast("string"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
