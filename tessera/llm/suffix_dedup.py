"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier in the corpus.

The method is a blockwise suffix sort with a difference cover, in a form that needs no global order of suffixes:

* The cover. A position is in the sample if it holds the least hash of KMER bytes in some window of LENGTH bytes
  (leftmost of equal ones). Every window of LENGTH bytes holds such a position, and equal windows hold it in the
  same place, so two equal windows always meet on a sample position, as two suffixes do on a difference cover.
  The cover follows from the content and is at most LENGTH - KMER + 1 apart.
* Ranks of the sample. Windows that share a sample position form a run of starts; the digest of the bytes of a run is
  its rank. Runs of equal rank are long ties: all but the first place are hits. Each task settles the ties of
  FLUSH_BYTES of text itself and passes on one run of a rank, so a passage that a third of all texts hold is
  few rows in the shuffle. What is passed on is dealt by sample bytes and read as a sorted stream.
* The buckets. Runs of unlike rank at equal sample bytes may share some windows. The suffixes that start in the
  first run of each such rank are sorted one bucket at a time, on LENGTH bytes; of each group of equal ones
  all but the first are hits. Sample bytes with over HOT_RANKS ranks in one flush are dealt by rank, and a bucket of
  more than BUCKET_RUNS runs is split by window digest, of which a flush again passes on one place.

Memory is bounded by a flush, a bucket, and a few times the longest text: a text is hashed in stretches of STRETCH
windows (a run that a cut divides is made whole again), its runs are numbers of some bytes each, and flushes end
within it where its windows are passed on.

Whole copies of a text need no step of their own: all their runs tie.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing but count; null ids come
before all others; of rows that share an id, the smaller hash of the text comes first; rows that repeat both
id and text share one result. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialise, released, rows_out, sliced

LENGTH = 100
KMER = 32
BUCKET_RUNS = 2000
#: Ranks of the same sample bytes in a flush from which they are dealt by rank.
HOT_RANKS = 64
#: Text whose ties one step of a task settles before the shuffle.
FLUSH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
#: Windows of a text that are hashed at a time, and rows of a text that are held as Python values.
STRETCH, STEP = 1 << 20, 1 << 16
#: Kinds of rows that a flush passes on.
RUN, HIT, HOT_RUN, HOT_NOTE = 0, 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15)


def cover_runs(data: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each run, its sample position, the hash there); a run ends where the next starts, the last at len(data) - length + 1."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    width, power = 1, BASE
    while width < kmer:  # kmer is a power of two
        h = h[:-width] * power + h[width:]
        power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * BASE
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # texts are under 4 GB
    window, width = length - kmer + 1, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return starts, at[starts], h[at[starts]]


def text_runs(data: bytes, length: int = LENGTH, kmer: int = KMER, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cover_runs of a text of any length, of `stretch` windows at a time; a run that a cut divides is made whole."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, max(1, len(data) - length + 1), stretch):
        starts, at, hashes = cover_runs(data[a : a + stretch + length - 1], length, kmer)
        starts, at = starts + a, at + a
        if parts and len(at) and parts[-1][1][-1] == at[0]:
            starts, at, hashes = starts[1:], at[1:], hashes[1:]
        if len(at) or not parts:
            parts.append((starts, at, hashes))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _signed(x: int) -> int:
    return x - 2**63


def _place(i: int | None, tie: int, start: int) -> tuple:
    """Sorts as the corpus does."""
    return i is not None, i or 0, tie, start


def _parts(*columns: np.ndarray) -> Iterator[Iterator[tuple]]:
    """Rows of columns of one length as Python values, some at a time."""
    for k in range(0, len(columns[0]), STEP):
        yield zip(*(c[k : k + STEP].tolist() for c in columns))


RUN_SCHEMA = "kind byte, route long, rank long, id long, tie long, start int, n int"
def corpus_order() -> tuple:
    return F.col("id").asc_nulls_first(), F.col("tie"), F.col("start")


def _flush(held: dict[tuple, tuple], length: int, kmer: int, hot_ranks: int) -> pa.RecordBatch:
    """Rows (RUN_SCHEMA) of the texts held, place -> (id, tie, text): ties among them as hits, one run of each rank."""
    docs = [held[k] for k in sorted(held)]
    doc, start, n, anchor, rank = [], [], [], [], []
    for k, (_, _, data) in enumerate(docs):
        starts, at, hashes = text_runs(data, length, kmer)
        if not len(starts):
            continue
        own = np.diff(np.append(starts, len(data) - length + 1))
        doc.append(np.full(len(starts), k))
        start.append(starts)
        n.append(own)
        anchor.append(hashes)
        rank.append(np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + m + length - 1], seed=a - s + 1) for part in _parts(starts, at, own) for s, a, m in part), np.uint64, len(starts)))
    doc, start, n = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (doc, start, n))
    anchor, rank = (np.concatenate(x or [np.zeros(0, np.uint64)]) for x in (anchor, rank))
    mixed = (anchor ^ (rank * BASE)) * BASE
    order = np.lexsort((anchor, mixed))  # stable: the first of equal ones has the first place
    again = np.concatenate([[False], (mixed[order][1:] == mixed[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])])[: len(order)]
    first, hit = np.sort(order[~again]), np.sort(order[again])
    # hits that touch become one
    touch = (np.diff(hit) == 1) & (doc[hit][1:] == doc[hit][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~touch])[: len(hit)])
    hit_n = np.add.reduceat(n[hit], head) if len(head) else n[:0]
    hit = hit[head]
    _, which, count = np.unique(anchor[first], return_inverse=True, return_counts=True)
    hot = count[which] > hot_ranks
    noted = np.unique(anchor[first[hot]])
    rows = np.concatenate([first, hit])
    kind = np.concatenate([np.where(hot, HOT_RUN, RUN), np.full(len(hit), HIT), np.full(len(noted), HOT_NOTE)]).astype(np.int8)
    route = np.concatenate([np.where(hot, mixed[first], anchor[first]), mixed[hit] ^ start[hit].astype(np.uint64), noted])
    ids, ties = (np.array([d[k] for d in docs] + [None], object)[np.concatenate([doc[rows], np.full(len(noted), -1)])] for k in (0, 1))
    zero = np.zeros(len(noted), np.int64)
    columns = {"kind": pa.array(kind), "route": pa.array(route.view(np.int64)), "rank": pa.array(np.concatenate([rank[first], np.zeros(len(hit) + len(noted), np.uint64)]).view(np.int64)), "id": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int64())}
    columns |= {"start": pa.array(np.concatenate([start[rows], zero]), pa.int32()), "n": pa.array(np.concatenate([n[first], hit_n, zero]), pa.int32())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _runs(rows: DataFrame, length: int, kmer: int, hot_ranks: int, flush_bytes: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        size = 0
        for batch in sliced(batches, "text", CHUNK_BYTES):
            for i, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary())):
                if len(data := text.as_py()) >= length:
                    held[_place(i, tie, 0)] = i, tie, data
                    size += len(data)
            if size >= flush_bytes:
                yield _flush(held, length, kmer, hot_ranks)
                held, size = {}, 0
        if held:
            yield _flush(held, length, kmer, hot_ranks)

    return rows.mapInArrow(run, RUN_SCHEMA)


def _settle(runs: DataFrame) -> DataFrame:
    """(id, tie, start, n, anchor, hot): hits (null anchor), and the first runs of unlike ranks at equal sample bytes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, last_note = None, False, None  # the first run of the rank read last, whether it was passed on

        def rows_of(table: pa.RecordBatch, at: np.ndarray, wanted: bool, hot: np.ndarray | None = None) -> pa.RecordBatch:
            got = table.select(["id", "tie", "start", "n"]).take(pa.array(at))
            anchor = table.column("route").take(pa.array(at)) if wanted else pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([*got.columns, anchor, pa.array(hot) if wanted else pa.array(np.zeros(len(at), bool))], ["id", "tie", "start", "n", "anchor", "hot"])

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            direct = np.flatnonzero(kinds == HIT)
            if len(direct):
                yield rows_of(batch, direct, False)
            route = batch.column("route").to_numpy()
            notes = route[kinds == HOT_NOTE]
            noted = np.append(notes, last_note) if last_note is not None else notes
            last_note = notes[-1] if len(notes) else last_note
            own = batch.take(pa.array(np.flatnonzero((kinds == RUN) | (kinds == HOT_RUN))))
            if held is not None:
                own = pa.Table.from_batches([held, own]).combine_chunks().to_batches()[0]
            if not own.num_rows:
                continue
            kind, route, rank, tie, start = (own.column(c).to_numpy() for c in ("kind", "route", "rank", "tie", "start"))
            null = pa.compute.is_null(own.column("id")).to_numpy(zero_copy_only=False)
            ids = pa.compute.fill_null(own.column("id"), 0).to_numpy()
            first = np.concatenate([[True], (route[1:] != route[:-1]) | (rank[1:] != rank[:-1]) | (kind[1:] != kind[:-1])])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            same = (ids == ids[lead]) & (null == null[lead]) & (tie == tie[lead]) & (start == start[lead])
            hits = np.flatnonzero(~same)
            if len(hits):
                yield rows_of(own, hits, False)
            heads = np.flatnonzero(first)
            hot = (kind[heads] == HOT_RUN) | np.isin(route[heads], noted)
            pair = (route[heads][1:] == route[heads][:-1]) & (kind[heads][1:] == kind[heads][:-1])
            wanted = hot | np.append(pair, False) | np.append(False, pair)
            if held is not None and told:
                wanted[0] = False
            if wanted.any():
                yield rows_of(own, heads[wanted], True, hot[wanted])
            told = bool(wanted[-1]) or (len(heads) == 1 and told and held is not None)
            held = own.slice(int(heads[-1]), 1)

    # notes come before the runs of their route
    dealt = runs.repartition("route").sortWithinPartitions("route", F.col("kind").desc(), "rank", *corpus_order())
    return dealt.mapInArrow(run, "id long, tie long, start int, n int, anchor long, hot boolean")


WINDOW_KINDS = {"kind": pa.int8(), "bucket": pa.int64(), "id": pa.int64(), "tie": pa.int64(), "start": pa.int32(), "bytes": pa.binary()}


def _windows(rows: DataFrame, length: int, flush_bytes: int) -> DataFrame:
    """Runs of a text with their bytes, dealt by anchor; of hot ones each window, dealt by digest, one place a flush."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        hot: dict[bytes, tuple] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            rows_ = out + [(HOT_RUN, _signed(xxhash.xxh3_64_intdigest(w)), *at, w) for w, at in hot.items()]
            return rows_out({k: (list(v), t) for (k, t), v in zip(WINDOW_KINDS.items(), zip(*rows_) if rows_ else [()] * len(WINDOW_KINDS))})

        for batch in sliced(batches, "text", CHUNK_BYTES):
            for i, tie, text, runs in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("runs")):
                data = text.as_py()
                fields = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "anchor", "hot"))
                for s, n, anchor, is_hot in (r for part in _parts(*fields) for r in part):
                    if size >= flush_bytes:  # within a text too
                        yield flushed()
                        out, hot, size = [], {}, 0
                    if not is_hot:
                        out.append((RUN, anchor, i, tie, s, data[s : s + n + length - 1]))
                        size += n + length
                        continue
                    for p in range(s, s + n):
                        known = hot.setdefault(w := data[p : p + length], (i, tie, p))
                        if known != (i, tie, p):
                            early, late = sorted((known, (i, tie, p)), key=lambda x: _place(*x))
                            hot[w] = early
                            out.append((HIT, late[1], *late, None))
                    size += n * length
        yield flushed()

    return rows.mapInArrow(run, "kind byte, bucket long, id long, tie long, start int, bytes binary")


def _bucket_hits(rows: DataFrame, length: int) -> DataFrame:
    """(id, tie, start, n): starts of windows that a bucket has earlier; neighbours as one run."""

    def sort_bucket(held: list[tuple]) -> list[tuple]:
        """held: (id, tie, start, bytes) in corpus order; the suffixes are sorted on length bytes, ties by place."""
        if len(held) < 2:
            return []
        suffixes = sorted((b[k : k + length], place, k) for place, (*_, b) in enumerate(held) for k in range(len(b) - length + 1))
        hits: dict[int, list[int]] = {}
        for (a, *_), (b, place, k) in zip(suffixes, suffixes[1:]):
            if a == b:
                hits.setdefault(place, []).append(k)
        out = []
        for place, starts in hits.items():
            i, tie, s, _ = held[place]
            starts.sort()
            first = last = starts[0]
            for k in [*starts[1:], -1]:
                if k != last + 1:
                    out.append((i, tie, s + first, last - first + 1))
                    first = k
                last = k
        return out

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], []
        seen: dict[bytes, tuple] = {}  # first place of each window of a digest

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            i, tie, s, n = zip(*rows_)
            return rows_out({"id": (list(i), pa.int64()), "tie": (list(tie), pa.int64()), "start": (list(s), pa.int32()), "n": (list(n), pa.int32())})

        for batch in batches:
            for kind, name, i, tie, s, b in zip(*(batch.column(c).to_pylist() for c in WINDOW_KINDS)):
                if kind == HIT:
                    out.append((i, tie, s, 1))
                    continue
                if (kind, name) != bucket:
                    out += sort_bucket(held)
                    bucket, held, seen = (kind, name), [], {}
                if kind == HOT_RUN:
                    if seen.setdefault(b, (i, tie, s)) != (i, tie, s):
                        out.append((i, tie, s, 1))
                elif not held or held[-1][:3] != (i, tie, s):  # else the same run from a repeated row
                    held.append((i, tie, s, b))
            if out:
                yield batch_of(out)
                out = []
        out = sort_bucket(held)
        if out:
            yield batch_of(out)

    dealt = rows.repartition("bucket").sortWithinPartitions("kind", "bucket", *corpus_order())
    return dealt.mapInArrow(run, "id long, tie long, start int, n int")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, keep_text: bool = False, bucket_runs: int = BUCKET_RUNS, hot_ranks: int = HOT_RANKS, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept (binary)."""
    if kmer & (kmer - 1) or not 1 <= kmer <= length:
        raise ValueError("kmer must be a power of two, at most length")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("tie"), "text")
    settled = materialise(_settle(_runs(base, length, kmer, hot_ranks, flush_bytes)))
    unlike = settled.where("anchor IS NOT NULL")
    large = unlike.groupBy("anchor").agg(F.count("*").alias("n_runs")).where(F.col("n_runs") > bucket_runs).select(F.col("anchor").alias("large"))
    unlike = unlike.join(large, F.col("anchor") == F.col("large"), "left").withColumn("hot", F.col("hot") | F.col("large").isNotNull())
    wanted = unlike.groupBy(F.col("id").alias("i"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("runs"))  # of one text, at most one for each of its bytes
    cut = base.join(wanted, (F.col("tie") == F.col("t")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "tie", "text", "runs")
    sorted_hits = materialise(_bucket_hits(_windows(cut, length, flush_bytes), length))
    hits = settled.where("anchor IS NULL").select("id", "tie", "start", "n").unionByName(sorted_hits)
    hits = hits.groupBy(F.col("id").alias("i"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    return _remove(base.join(hits, (F.col("tie") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")), "left"), id_col, length, keep_text)


def _spans(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (excluded) byte of each maximal run that the windows from n starts on cover."""
    order = np.argsort(start, kind="stable")
    start = start[order].astype(np.int64)
    reach = np.maximum.accumulate(start + n[order] + length - 1)
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])[: len(start)])
    return start[fresh], reach[np.append(fresh[1:], len(start)) - 1] if len(start) else reach


def _remove(rows: DataFrame, id_col: str, length: int, keep_text: bool) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {k: ([], t) for k, t in (("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))} | ({"kept": ([], pa.binary())} if keep_text else {})
            for i, text, found in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("hits")):
                data = text.as_py()
                a, b = _spans(found.values.field("start").to_numpy(), found.values.field("n").to_numpy(), length) if found.is_valid else (np.zeros(0, np.int64),) * 2
                kept = (data[x:y] for part in _parts(np.append(0, b), np.append(a, len(data))) for x, y in part)
                rest = b"".join(kept) if len(a) else data
                for k, v in zip(out, (i, len(data), len(data) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest)):
                    out[k][0].append(v)
            yield rows_out(out)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.select("id", "text", "hits").mapInArrow(run, schema).withColumnRenamed("id", id_col)
