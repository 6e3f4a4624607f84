"""Ranked lexical search: term-at-a-time with limited accumulators, over blocks of documents.

One pass over the texts turns each document into its length and the counts of those terms that some query has; these
postings are written to the shared folder. From them come the number of documents, their terms and each term's
document frequency. A second pass, over the postings alone, ranks: a task gathers a block of documents, inverts it
(each term's documents, with the part of the score that no query changes) and takes the terms of each query rarest
first. While what the remaining terms can add at most is not below the k-th best partial score, every document that has
the term gets an accumulator. From then on a document without one cannot come among the best (an equal score may, so
the bound must be truly below), no accumulator is made, and the others are carried on exactly; those that fall behind the
k-th best even with all that remains are left out of later terms. The k-th best score of a task's earlier blocks bounds the
later ones. Tasks give their best k rows for each query; one window ranks these.

Queries are dealt into blocks of at most BLOCK_BYTES of text, which travel with the tasks; more take one pass for each.

Edge cases: null, empty and blank texts have no terms, neither count nor are found; queries without terms, or without
documents that have them, give no rows; each row of queries is ranked by itself, with null or repeated ids too; equal scores
go by ascending document id, null ids last; rows that repeat an id are documents of their own. Other columns are not read.
Empty tables give no rows. Long texts are read in stretches of CHUNK bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import WORD, materialise, released, rows_out, sliced, text_blocks

TOP = 10
BLOCK_BYTES = 4 << 20
BATCH_BYTES, CHUNK = 4 << 20, 1 << 20
#: Documents and postings of a block, about.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 20
#: Fixed values of the score.
SCALE, LENGTH_PARTS, FLAT_PARTS, SATURATION = 1_000_000_000, 75, 25, 8
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_counts(data: bytes, vocabulary: dict[bytes, int], chunk: int = CHUNK) -> tuple[int, dict[int, int]]:
    """All terms of a text, and the count of each that the vocabulary has."""
    n, at, counts = 0, 0, Counter()
    while at < len(data):
        end = BREAK.search(data, at + chunk)
        end = end.start() if end else len(data)
        found = WORD.findall(data[at:end].lower())
        n += len(found)
        counts.update(map(vocabulary.get, found))
        at = end
    counts.pop(None, None)
    return n, counts


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs: id, text. (id, n, terms, counts) of each document that has terms."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH_BYTES):
            lengths, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                n, found = term_counts(text.as_py() or b"", vocabulary)
                lengths.append(n)
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            out = {"id": batch.column("id"), "n": pa.array(lengths, pa.int64()), "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>").where("n > 0")


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


class Best:
    """The k best (score, id) seen, ids ascending on equal scores and null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        first = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[first], ids[first], null[first]


class Inverted:
    """A block of documents by term; `part` is what one posting adds to a score before its term's weight."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")  # documents stay ascending within a term
        load = FLAT_PARTS + LENGTH_PARTS * lengths * n_docs // n_terms
        count = counts[order].astype(np.int64)
        self.doc = doc[order]
        self.part = SCALE * count // (1000 * count + SATURATION * load[self.doc])
        known, start = np.unique(terms[order], return_index=True)
        most = np.maximum.reduceat(self.part, start) if len(start) else []
        self.at = {int(t): (int(a), int(b), int(m)) for t, a, b, m in zip(known, start, [*start[1:], len(order)], most)}
        self.score, self.seen = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)  # a score may stay 0

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all that can be among the k best, if they reach `floor`. query: (term, weight), rarest first."""
        found = [(*self.at[t], w) for t, w in query if t in self.at and w]
        left = np.cumsum([0, *(m * w for _, _, m, w in reversed(found))])[::-1]  # at j: what terms from j on add at most
        held = None
        score, seen = self.score, self.seen
        score[:], seen[:] = 0, False
        for j, (a, b, _, w) in enumerate(found):
            doc, rest = self.doc[a:b], int(left[j + 1])
            if held is None:
                score[doc] += w * self.part[a:b]
                seen[doc] = True
                if rest >= max(int(score.max()), floor):
                    continue
                known = np.flatnonzero(seen)
                partial = score[known]
            else:
                place = np.minimum(np.searchsorted(doc, held), len(doc) - 1)
                hit = doc[place] == held
                partial = partial + np.where(hit, w * self.part[a:b][place], 0)
                known = held
            least = max(floor, int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0)
            if held is not None or rest < least:
                able = partial + rest >= least
                held, partial = known[able], partial[able]
        if held is None:
            held = np.flatnonzero(seen)
            partial = score[held]
        least = max(floor, 1, int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0)
        return held[partial >= least], partial[partial >= least]


def best_of_tasks(found: DataFrame, items: list, queries: list[list[tuple[int, int]]], item_type: str, arrow_type: pa.DataType, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(no, item, id, score): the k best of each task for each query."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            block = pa.Table.from_batches(held).combine_chunks()
            terms, counts = (block.column(c).combine_chunks() for c in ("terms", "counts"))
            ids = block.column("id").combine_chunks()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            index = Inverted(terms.flatten().to_numpy(), counts.flatten().to_numpy(), terms.value_lengths().to_numpy(), block.column("n").to_numpy(), n_docs, n_terms)
            for own, query in zip(best, queries):
                docs, scores = index.search(query, k, own.floor)
                own.add(scores, ids[docs], null[docs])

        docs = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                docs, size = docs + part.num_rows, size + len(part.column("terms").flatten())
                if docs >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    flush()
                    held.clear()
                    docs = size = 0
        if held:
            flush()
        for no, own in enumerate(best):
            if len(own.ids):
                yield rows_out({"no": ([no] * len(own.ids), pa.int32()), "item": ([items[no]] * len(own.ids), arrow_type), "id": ([None if x else i for i, x in zip(own.ids.tolist(), own.null)], pa.int64()), "score": (own.scores, pa.int64())})

    return found.select("id", "n", "terms", "counts").mapInArrow(run, f"no int, item {item_type}, id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each row of items."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType
    out, total = None, None
    for block in text_blocks(items, item_col, item_text_col, block_bytes):
        vocabulary: dict[bytes, int] = {}
        asked = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall((text or "").encode("utf-8", "replace").lower())) for _, text in block]
        found = materialise(postings(texts, vocabulary))
        total = total or found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        seen = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pydict()  # at most the terms of a block
        frequency = dict(zip(seen["term"], seen["count"]))
        queries = [[(t, count * weight(total[0], frequency[t])) for t, count in sorted(own.items(), key=lambda x: (frequency.get(x[0], 0), x[0])) if t in frequency] for own in asked]
        ranked = best_of_tasks(found, [item for item, _ in block], queries, kind.simpleString(), to_arrow_type(kind), k, *total)
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
