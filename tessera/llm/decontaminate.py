"""Benchmark decontamination with one FM-index per training shard.

Test items become windows of WINDOW consecutive words (an item of fewer, but not none, is one window). Words of
the test items are numbered; a shard, some MB of whole texts, becomes the sequence of these numbers, with 0 for
any run of other words or a text's end. No window holds a 0, and none fits in a run between zeros that is shorter
than the shortest window, so such runs are left out without loss. Each shard is indexed (suffix array,
Burrows-Wheeler transform, wavelet tree); all windows are searched backwards at once, occurrences are located by
sampled suffix positions, and their spans are merged per text.

The test set is dealt into blocks of at most BLOCK_BYTES of text, which travel with the tasks; for a larger test
set there is one pass over the texts per block, written in between, and spans and items add up.

Edge cases: null and empty texts have no words and no hits; an item without words matches nothing; items that share
a window all count; repeated ids are judged row by row; an item id repeated in the test set counts once. Windows of items
with a null id hit as any other; such items count as one item, which has no place in the list of ids.
Without test items nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WORD, materialise, released, sliced, text_blocks, words
from tessera.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Stands for all items without an id between passes.
NAMELESS = "\x00"


class Windows:
    """Distinct windows of a block of test items, as right-aligned rows of word numbers from 1."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int32)
        for k, w in enumerate(found):
            self.rows[k, window - len(w) :] = w
        self.items = list(found.values())
        self.shortest = int(self.lengths.min(initial=window))


def shard_hits(texts: list[list[bytes]], windows: Windows) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each text (its words): merged spans of hit words, ends excluded, and the items that occur."""
    out: list = [([], set()) for _ in texts]
    if not windows.items:
        return out
    n = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(n + 1) - n - 1  # each text is followed by a 0
    symbols = np.zeros(int((n + 1).sum()), np.int32)
    for s, t in zip(starts, texts):
        symbols[s : s + len(t)] = np.fromiter(map(windows.vocabulary.get, t, repeat(0)), np.int32, len(t))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols != 0, [0]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    long = last - first >= windows.shortest
    first, last = first[long], last[long] + 1  # with the 0 behind
    if not len(first):
        return out
    size = last - first
    at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)  # places in symbols of the indexed sequence
    index = FMIndex(symbols[at])
    low, high = index.search(windows.rows, windows.lengths)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    begin = at[index.locate(rows)]
    if not len(begin):
        return out
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + windows.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):  # no span crosses a 0, so none crosses a text
        k = int(np.searchsorted(starts, a, "right")) - 1
        out[k][0].append((int(a - starts[k]), int(b - starts[k])))
    text_of = np.searchsorted(starts, begin, "right") - 1
    for pair in np.unique(text_of * len(count) + which):
        out[int(pair // len(count))][1].update(windows.items[int(pair % len(count))])
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans of words."""
    if not spans:
        return text
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def _unpack(spans: bytes | None) -> list[tuple[int, int]]:
    return [tuple(p) for p in np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist()]


def _one_pass(rows: DataFrame, block: list[tuple[int, str]], text_col: str, last: bool) -> DataFrame:
    """Add the block's spans and items to each row's; in the last pass n_hit and the digest columns, and the cut text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block)
        for batch in sliced(batches, text_col, SHARD_BYTES):
            texts = batch.column(text_col).to_pylist()
            found = [words(t) for t in texts]
            hits = shard_hits(found, windows)
            columns = {name: batch.column(name) for name in batch.schema.names}
            spans = [merge(_unpack(old) + new) for old, (new, _) in zip(columns["spans"].to_pylist(), hits)]
            items = [set(filter(None, (old or "").split(","))) | {NAMELESS if i is None else str(i) for i in new} for old, (_, new) in zip(columns["items"].to_pylist(), hits)]
            columns["n_words"] = pa.array([len(w) for w in found], pa.int64())
            columns["spans"] = pa.array([np.array(s, np.int32).tobytes() for s in spans], pa.binary())
            columns["items"] = pa.array([",".join(sorted(i)) for i in items], pa.string())
            if last:
                columns["n_hit"] = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
                columns["n_items"] = pa.array([len(i) for i in items], pa.int64())
                columns["items"] = pa.array([",".join(sorted(i - {NAMELESS})) for i in items], pa.string())
                columns["items_sha256"] = pa.array([hashlib.sha256(i.encode()).hexdigest() for i in columns["items"].to_pylist()], pa.string())
                if keep_text:
                    columns["clean_text"] = pa.array([None if t is None else cut(t, s) for t, s in zip(texts, spans)], pa.string())
                else:
                    del columns[text_col]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    keep_text = "clean_text" in rows.columns
    rows = rows.drop("clean_text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or not last or f.name != text_col]
    return rows.mapInArrow(run, ", ".join(fields + ["n_hit long", "n_items long", "items_sha256 string"] * last + ["clean_text string"] * (last and keep_text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's id, n_words, spans (pairs of int32 word places, ends excluded), items, n_hit, n_items, items_sha256.

    With clean=True all other columns of docs come too, and clean_text, the text without its spans; input columns with
    the name of one of these give way to it.
    """
    rows = docs.select(*(docs.columns if clean else [F.col(id_col), F.col(text_col)]))
    clash = {"n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "clean_text"} & set(rows.columns)
    rows = rows.drop(*clash).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("binary"), "items": F.lit(None).cast("string")})
    held = None
    for block in text_blocks(benchmark.where(F.col(item_text_col).isNotNull()), item_col, item_text_col, block_bytes):
        if held is not None:
            rows = materialise(_one_pass(rows, held, text_col, False))
        held = block
    if clean:
        rows = rows.withColumn("clean_text", F.lit(None).cast("string"))
    return _one_pass(rows, held, text_col, True)
