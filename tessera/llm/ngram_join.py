"""N-gram Jaccard join: MinHash banding, pairs verified on full n-gram sets.

Rows and bands follow from a target recall: the most rows per band, up to MAX_ROWS, whose number of bands for
that recall at the threshold stays within MAX_BANDS. Documents with the same n-gram set become one node. Nodes
meet on band hashes; each band names its smallest node, and the components of these star edges bound where
links can be, so no pair of a bucket is listed. What comes out is the number of links of each node and a forest that
connects it, never the pairs.

* A component of at most BLOCK_GRAMS n-grams is one cell of one task, which judges all its pairs: distance to the
  majority set (the n-grams most members have) settles most of them, as Jaccard distance is a metric; the others
  are counted through the postings of their n-grams.
* A larger component first gets a pivot, the majority set of a bounded sample of its members. Its members, dealt
  into blocks, are put into bins by their distance to the pivot. Two members whose bins add up to less than the
  threshold are surely linked: a histogram of bins counts those links, and one edge to the innermost member
  connects them, so a large group of near copies costs one look at each member. Only blocks of rings whose
  distances leave it open meet in cells, and there only the open pairs are judged.
* Where members spread over more than WIDE_BLOCKS blocks and share few bands (their buckets hold FEWER times fewer pairs), as
  chains of rows do that are each like the next one, the cells are the buckets of the bands instead, and an open pair is judged in the first that it shares: a member is copied once for
  each band at most, and work follows the candidates. There the recall is that of the bands; elsewhere all pairs of a component count.

Edge cases: a text of fewer than n words, but not none, is one n-gram of all its words; texts without words
(null, empty) are linked to nothing, each a class of its own; rows that repeat are copies of each other; a class
whose ids are all null has a null class id, and null or repeated ids change nothing else, as rows are told apart by id
and text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import drop, join_groups, materialise, released, rows_out, sliced, words
from tessera.llm.components import connected_components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
MAX_ROWS, MAX_BANDS = 5, 40
BLOCK_GRAMS = 100_000
#: n-grams of members, about, that one copy of a pivot serves.
LOOK_GRAMS = 10_000
#: Bins of distance up to the threshold, and bins in a ring.
BINS, RING = 200, 20
#: Blocks of a part from which its open pairs may meet in the buckets of their bands.
WIDE_BLOCKS = 16
#: So many times fewer pairs the buckets must hold than the part.
FEWER = 4
CACHE_WORDS = 300_000
#: n-grams per MinHash step.
STEP = 1 << 17
#: Text that one step of a task turns into n-gram sets.
BATCH_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


JUDGED = ("node", "copies", "side", "bin", "set", "bands", "band")
#: Columns of cells that are not the bucket of a band.
NO_BAND = ("CAST(NULL AS ARRAY<BIGINT>) AS bands", "CAST(NULL AS INT) AS band")


def bands_and_rows(similarity: float, recall: float) -> tuple[int, int]:
    """The most rows, and bands enough for the recall at this similarity."""
    for rows in range(MAX_ROWS, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands <= MAX_BANDS:
            return bands, rows
    raise ValueError(f"recall {recall} at similarity {similarity} takes over {MAX_BANDS} bands")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def gram_set(text: str | None, n: int, table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out * MIX + h[k : len(h) - width + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def signatures(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Least hash of each (non-empty) set under each seed: a row per set."""
    out = np.full((len(sets), len(seeds)), np.iinfo(np.uint64).max, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])
    grams = np.concatenate(sets)
    for at in range(0, len(grams), STEP):  # a step may cut a set
        part = grams[at : at + STEP]
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(part), "left"))
        cuts = np.maximum(starts[first:last] - at, 0)
        for k, seed in enumerate(seeds):
            out[first:last, k] = np.minimum(out[first:last, k], np.minimum.reduceat((part ^ seed) * MIX, cuts))
    return out


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs: id, tie, text. id, tie, node (digest of the n-gram set; null without words), grams (their number), bands (hashes)."""
    seeds = np.random.default_rng(7).integers(0, 2**64, bands * rows, dtype=np.uint64)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in sliced(batches, "text", BATCH_BYTES):
            nodes, sizes, distinct = [], [], {}
            for text in batch.column("text"):
                grams = gram_set(text.as_py(), n, table)
                nodes.append(xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else None)
                sizes.append(len(grams))
                if len(grams):
                    distinct[nodes[-1]] = grams
            band = {None: []}
            if distinct:
                least = signatures(list(distinct.values()), seeds).reshape(len(distinct), bands, rows)
                band |= {node: [xxhash.xxh64_intdigest(b.tobytes(), seed=k) - 2**63 for k, b in enumerate(own)] for node, own in zip(distinct, least)}
            columns = {"node": pa.array(nodes, pa.string()), "grams": pa.array(sizes, pa.int64()), "bands": pa.array([band[x] for x in nodes], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), *columns.values()], ["id", "tie", *columns])

    return docs.mapInArrow(run, "id long, tie long, node string, grams long, bands array<long>")


def block_links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, similarity: float, bins: np.ndarray | None = None, bands: np.ndarray | None = None, band: int = 0) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each set, and a forest of links. side 0/1: only pairs of unlike sides; side 2: all pairs.

    bins: by distance to a pivot; pairs that they settle are left out. bands: band hashes, with which only pairs count
    whose first common band is this one.
    """
    n = len(sets)
    links, parent = np.zeros(n, np.int64), list(range(n))
    forest: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def connect(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            forest.append((i, j))

    size = np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return links, forest
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    core = np.bincount(column, minlength=len(grams)) * 2 > n
    common = np.bincount(row, core[column], n)
    far = 1 - common / (size + core.sum() - common)
    reach = 1 - similarity
    order = np.argsort(far, kind="stable")
    ranked = far[order]
    sure = np.searchsorted(ranked, reach - far - 1e-9, "right") if bins is None else np.zeros(n, np.int64)  # so many of the nearest to the core are surely linked
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for s in (0, 1, 2):
        own = side == s
        others = side[order] == (s if s == 2 else 1 - s)
        total = np.concatenate([[0], np.cumsum(np.where(others, weights[order], 0))])
        links[own] += total[sure[own]]
        if s == 2:
            links[own] -= np.where(place[own] < sure[own], weights[own], 0)
    for s in (0, 1, 2):  # each joins the nearest of the other side
        others = order[side[order] == (s if s == 2 else 1 - s)]
        if len(others):
            for i in np.flatnonzero((side == s) & (place < n)):
                j = others[0]
                if i != j and place[j] < sure[i]:
                    connect(int(i), int(j))
    by_gram = np.argsort(column, kind="stable")
    posting, first = row[by_gram], np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(grams)))])
    start = np.cumsum(size) - size
    top = np.searchsorted(ranked, far + reach + 1e-9, "right")
    low = np.searchsorted(ranked, far - reach - 1e-9, "left")
    for i in range(n):
        a, b = max(sure[i], low[i]), top[i]
        maybe = order[a:b]
        maybe = maybe[maybe > i]
        maybe = maybe[(side[maybe] == 2) | (side[maybe] != side[i])]
        if bins is not None:
            maybe = maybe[bins[maybe] + bins[i] + 2 > BINS]
        if bands is not None and len(maybe):
            maybe = maybe[(bands[maybe] == bands[i]).argmax(1) == band]
        maybe = maybe[np.minimum(size[maybe], size[i]) >= similarity * np.maximum(size[maybe], size[i]) - 1e-9]
        if not len(maybe):
            continue
        if len(maybe) <= 4:
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in maybe])
        else:
            c = column[start[i] : start[i] + size[i]]
            shared = np.bincount(np.concatenate([posting[first[k] : first[k + 1]] for k in c]), minlength=n)[maybe]
        hit = maybe[shared >= similarity * (size[maybe] + size[i] - shared) - 1e-9]
        links[i] += weights[hit].sum()
        links[hit] += weights[i]
        for j in hit:
            connect(i, int(j))
    return links, forest


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its linked group), n_links (other rows with a similarity of at least the threshold)."""
    bands, rows = bands_and_rows(similarity, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    sketched = materialise(sketch(texts, n, bands, rows))
    # rows of one id and text are repeats; a node's n-grams come from the text of its first (id, tie)
    row = sketched.where("node IS NOT NULL").groupBy("node", "id", "tie").agg(F.count("*").alias("repeats"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    chosen = F.min(F.struct("id", "tie", "repeats"))
    nodes = materialise(row.groupBy("node").agg(chosen.alias("chosen"), F.min("id").alias("least"), F.sum("repeats").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))

    keyed = nodes.select("node", F.explode("bands").alias("band"))
    heads = materialise(keyed.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1"))
    met = join_groups(keyed, heads, "band", "members", F.col("node")).where("head IS NOT NULL").groupBy("node").agg(F.collect_set("head").alias("heads"))  # one for each band at most, none larger than the node
    edges = met.select(F.explode(F.array_union(F.array("node"), "heads")).alias("node"), F.array_min("heads").alias("head")).where("node <> head")
    groups = connected_components(edges, "node", "head").withColumnRenamed("component", "part")
    members = materialise(nodes.join(groups, "node").select("node", "part", "grams", "copies", "chosen"))
    sizes = materialise(members.groupBy("part").agg(F.sum("grams").alias("total"), F.count("*").alias("members")))
    held = materialise(_with_texts(texts, join_groups(members, sizes, "part", "members", F.col("node"))))
    drop(heads, members, sizes)

    small = held.where(F.col("total") <= BLOCK_GRAMS).select("node", "copies", "text", F.col("part").alias("cell"), F.lit(2).alias("side"), F.lit(None).cast("int").alias("bin"), *map(F.expr, NO_BAND))
    judged = _judge(_with_grams(small, n), similarity)
    large = held.where(F.col("total") > BLOCK_GRAMS)
    if not large.isEmpty():
        judged = judged.unionByName(_judge_large(large, nodes.select("node", "bands"), n, similarity))
    judged = materialise(judged)
    drop(held)
    linked = judged.where("other IS NOT NULL").select("node", "other")
    counts = judged.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(linked, "node", "other")
    out = nodes.select("node", "least", "copies").join(counts, "node", "left").join(classes, "node", "left").select("node", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    out = materialise(out)
    named = out.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("nodes"))
    out = materialise(join_groups(out, materialise(named), "component", "nodes", F.col("node")).select("node", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    whole = join_groups(sketched.select("id", "tie", "node"), out, "node", "copies", F.concat_ws("/", "id", "tie"))
    return whole.select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """members with the text of their chosen row, each once."""
    at = members.select("node", "part", "copies", "grams", "total", "members", F.col("chosen.id").alias("i"), F.col("chosen.tie").alias("t"), F.col("chosen.repeats").alias("repeats"))
    found = texts.join(at, (F.col("tie") == F.col("t")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "part", "copies", "grams", "total", "members", "repeats", "text")
    again = found.where("repeats > 1").groupBy("node", "part", "copies", "grams", "total", "members", "repeats").agg(F.first("text").alias("text"))
    return found.where("repeats = 1").unionByName(again).drop("repeats")


def _with_grams(rows: DataFrame, n: int) -> DataFrame:
    """The n-gram set in place of the text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in sliced(batches, "text", BATCH_BYTES):
            sets = [gram_set(t.as_py(), n, table).tobytes() for t in batch.column("text")]
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], [*kept.schema.names, "set"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, schema + ", set binary")


def _pivots(large: DataFrame, n: int) -> DataFrame:
    """(part, set): the majority set of a sample of about BLOCK_GRAMS n-grams of each part, and always of its first node."""
    sample = large.where((F.col("node") == F.col("part")) | (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30) < BLOCK_GRAMS / F.col("total")))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def majority() -> pa.RecordBatch:
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            return rows_out({"part": ([part], pa.string()), "set": ([grams[2 * count > len(held)].tobytes()], pa.binary())})

        for batch in batches:
            for name, own in zip(batch.column("part").to_pylist(), batch.column("set").to_pylist()):
                if name != part:
                    if held:
                        yield majority()
                    part, held = name, []
                held.append(np.frombuffer(own, np.uint64))
        if held:
            yield majority()

    dealt = _with_grams(sample.select("node", "part", "text"), n).repartition("part").sortWithinPartitions("part")
    return dealt.select("part", "set").mapInArrow(run, "part string, set binary")


def _binned(large: DataFrame, pivots: DataFrame, n: int, similarity: float) -> DataFrame:
    """(node, part, copies, grams, bin) of each member: its distance to the part's pivot. A pivot comes once to each block of its part."""
    blocks = F.least(F.ceil(F.col("total") / LOOK_GRAMS), "members").cast("int")  # no more looks than members
    own = _with_grams(large.select("node", "part", "copies", "grams", "total", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "text"), n)
    parts = large.select("part", blocks.alias("blocks")).distinct()
    copies = pivots.join(parts, "part").select(F.lit(None).cast("string").alias("node"), "part", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("grams"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "set")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            kept, bins = [], []
            for k, (node, own) in enumerate(zip(batch.column("node").to_pylist(), batch.column("set").to_pylist())):
                grams = np.frombuffer(own, np.uint64)
                if node is None:
                    pivot = grams
                    continue
                shared = len(np.intersect1d(grams, pivot, assume_unique=True))
                kept.append(k)
                bins.append(int((1 - shared / (len(grams) + len(pivot) - shared)) / (1 - similarity) * BINS))
            got = batch.select(["node", "part", "copies", "grams"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(bins, pa.int32())], [*got.schema.names, "bin"])

    dealt = own.drop("total").unionByName(copies).repartition("part", "block").sortWithinPartitions("part", "block", F.asc_nulls_first("node"))
    return dealt.mapInArrow(run, "node string, part string, copies long, grams long, bin int")


def _judge_large(large: DataFrame, banded: DataFrame, n: int, similarity: float) -> DataFrame:
    """(node, links, other) as _judge gives them, of parts that are no cell of one task. banded: node, bands."""
    if similarity == 1:  # unlike sets are not linked
        return large.select("node", F.lit(None).cast("long").alias("links"), F.lit(None).cast("string").alias("other")).limit(0)
    pivots = materialise(_pivots(large, n))
    binned = materialise(_binned(large, pivots, n, similarity))
    histogram = binned.groupBy("part", "bin").agg(F.sum("copies").alias("weight"), F.count("*").alias("n"), F.sum("grams").alias("grams"), F.min("node").alias("first"))
    ring = F.floor(F.col("bin") / RING).cast("int")
    rings = histogram.groupBy("part", ring.alias("ring")).agg(F.sum("grams").alias("grams"), F.sum("n").alias("n"))
    rings = rings.groupBy("part").agg(F.collect_list(F.struct("ring", F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int").alias("blocks"))).alias("rings"), F.sum("n").alias("n"))  # a ring for each bin at most
    bins = histogram.groupBy("part").agg(F.collect_list(F.struct("bin", "weight")).alias("bins"), F.min(F.struct("bin", F.col("first").alias("node"))).alias("inner"))
    known = join_groups(binned, materialise(rings.join(bins, "part")), "part", "n", F.col("node"))
    known = materialise(known)
    sure = F.aggregate(F.filter("bins", lambda b: b["bin"] + F.col("bin") + 2 <= BINS), F.lit(0).cast("long"), lambda done, b: done + b["weight"])
    sure = known.select("node", (sure - F.when(F.col("bin") * 2 + 2 <= BINS, F.col("copies")).otherwise(0)).alias("links"), F.when((F.col("bin") + F.col("inner.bin") + 2 <= BINS) & (F.col("node") != F.col("inner.node")), F.col("inner.node")).alias("other"))
    # open pairs: neither surely linked nor surely apart; a block meets itself (side 2) and others (the lower is side 0)
    own_ring = F.floor(F.col("bin") / RING).cast("int")
    met = F.filter("rings", lambda r: (RING * (r["ring"] + own_ring + 2) > BINS) & (RING * (F.abs(r["ring"] - own_ring) - 1) < BINS))
    met = F.flatten(F.transform(met, lambda r: F.transform(F.sequence(F.lit(0), r["blocks"] - 1), lambda k: F.struct(r["ring"].alias("ring"), k.alias("block")))))
    own_blocks = F.get(F.filter("rings", lambda r: r["ring"] == own_ring), F.lit(0))["blocks"]
    own = F.struct(own_ring.alias("ring"), F.pmod(F.xxhash64("node"), own_blocks).cast("int").alias("block"))
    wide = F.aggregate("rings", F.lit(0), lambda done, r: done + r["blocks"]) > WIDE_BLOCKS
    spread = known.where(wide & (F.size(met) > 0)).select("node", "part", "n", "copies", "grams", "bin")
    sparse = None if spread.isEmpty() else _buckets(spread, banded)
    if sparse is not None:
        known = join_groups(known, sparse.parts, "part", "members", F.col("node")).where("members IS NULL").drop("members")
    placed = known.select("node", "part", "copies", "bin", own.alias("own"), F.explode(met).alias("met"))
    name = F.concat_ws("/", "part", *(f(F.col("own"), F.col("met"))[k].cast("string") for f in (F.least, F.greatest) for k in ("ring", "block")))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    placed = placed.select("node", "copies", "bin", name.alias("cell"), side.alias("side"))
    cells = placed.join(large.select(F.col("node").alias("at"), "text"), F.col("node") == F.col("at")).select("node", "copies", "text", "cell", "side", "bin", *map(F.expr, NO_BAND))
    if sparse is not None:
        texts = large.select(F.col("node").alias("at"), "text").join(banded.select(F.col("node").alias("of"), "bands"), F.col("at") == F.col("of")).select("at", "text", "bands")
        cells = cells.unionByName(_by_band(spread, banded, sparse).join(texts, F.col("node") == F.col("at")).select("node", "copies", "text", "cell", "side", "bin", "bands", "band"))
    return _judge(_with_grams(cells, n), similarity).unionByName(sure.select("node", F.when(F.col("links") > 0, F.col("links")).alias("links"), F.lit(None).cast("string").alias("other"))).unionByName(sure.where("other IS NOT NULL").select("node", F.lit(None).cast("long").alias("links"), "other"))


class Buckets(NamedTuple):
    """sizes: (bucket, members, weight) of the bands of wide parts; parts: (part, members) of those that they serve."""

    sizes: DataFrame
    parts: DataFrame


def _each_band(spread: DataFrame, banded: DataFrame) -> DataFrame:
    each = spread.join(banded.select(F.col("node").alias("at"), "bands"), F.col("node") == F.col("at")).select("node", "part", "n", "copies", "grams", "bin", F.posexplode("bands").alias("band", "hash"))
    return each.withColumn("bucket", F.concat_ws("/", "band", "hash"))


def _buckets(spread: DataFrame, banded: DataFrame) -> Buckets | None:
    """A wide part is served by its bands if their buckets hold far fewer pairs than the part: not in a group of near copies, which all share their bands."""
    sizes = _each_band(spread, banded).groupBy("bucket").agg(F.first("part").alias("of"), F.first("n").alias("all"), F.count("*").alias("members"), F.sum("grams").alias("weight"))
    sizes = materialise(sizes.where("members > 1"))
    pairs = sizes.groupBy(F.col("of").alias("part")).agg(F.first("all").alias("members"), F.sum(F.col("members").cast("double") * F.col("members")).alias("pairs"))
    parts = materialise(pairs.where(FEWER * F.col("pairs") < F.col("members").cast("double") * F.col("members")).select("part", "members"))
    return None if parts.isEmpty() else Buckets(sizes.select("bucket", "members", "weight"), parts)


def _by_band(spread: DataFrame, banded: DataFrame, sparse: Buckets) -> DataFrame:
    """(node, copies, bin, cell, side, band) of members in the buckets of their bands; spread: node, part, n, copies, grams, bin."""
    served = join_groups(spread, sparse.parts, "part", "members", F.col("node")).where("members IS NOT NULL").drop("members")
    held = join_groups(_each_band(served, banded), sparse.sizes, "bucket", "members", F.col("node")).where("members IS NOT NULL")
    blocks = F.ceil(F.col("weight") / BLOCK_GRAMS).cast("int")
    held = held.select("node", "copies", "bin", "band", "bucket", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("met"))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    return held.select("node", "copies", "bin", F.concat_ws("/", "bucket", F.least("own", "met"), F.greatest("own", "met")).alias("cell"), side.alias("side"), "band")


def _judge(placed: DataFrame, similarity: float) -> DataFrame:
    """(node, links) for each member of a cell, (node, other) for each tree edge of its forest."""

    def one(nodes: list[str], copies: list[int], sides: list[int], bins: list[int | None], grams: list[bytes], bands: list[list[int] | None], band: list[int | None]):
        settled = None if not bins or bins[0] is None else np.array(bins, np.int64)
        by_band = (np.array(bands, np.int64), band[0]) if bands and bands[0] is not None else ()
        links, forest = block_links([np.frombuffer(g, np.uint64) for g in grams], np.array(copies, np.int64), np.array(sides), similarity, settled, *by_band)
        return [(x, int(k), None) for x, k in zip(nodes, links) if k] + [(nodes[a], None, nodes[b]) for a, b in forest]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out = None, tuple([] for _ in JUDGED), []
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", *JUDGED))):
                if name != cell:
                    out += one(*held)
                    cell, held = name, tuple([] for _ in JUDGED)
                for x, v in zip(held, row):
                    x.append(v)
            if out:
                yield _batch(out)
                out = []
        if held[0]:
            out = one(*held)
            if out:
                yield _batch(out)

    return placed.select("cell", *JUDGED).repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "node string, links long, other string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    node, links, other = zip(*rows)
    return rows_out({"node": (list(node), pa.string()), "links": (list(links), pa.int64()), "other": (list(other), pa.string())})
