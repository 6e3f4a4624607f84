"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a model runs over a whitespace marker (checked when the model is loaded), so a text splits
before each run of markers into marked words that are segmented independently.

* The table. Every task counts the marked words of its texts; the counts are added up by word, and each of the most frequent
  words (as many as TABLE_ROWS allows, none longer than LONG_CHUNK bytes) is segmented once, by Spark. The table has a
  bounded size and travels with the tasks. Words that no stretch of FLUSH_BYTES has twice are not counted: they
  could not be frequent.
* The join. A batch of texts becomes a dictionary of its distinct marked words and the sequence of their positions. The
  dictionary is looked up in the table at once, what the table lacks is segmented once for the batch, and the ids
  are laid out by position in one gather.

Words outside the table stay where their texts are. To send them to one place each and their ids back, every text would
have to be shuffled as well; README has figures of that plan, measured in part. A model with pieces across markers, with a normaliser
that changes texts, or without the dummy prefix takes the plain path: whole texts through the library.

Edge cases: null counts as empty and gives begin and end ids alone; runs of spaces, literal markers,
control characters and bytes outside the vocabulary come out as the library has them; a text without any space is one
chunk; rows that repeat, in id or text, are encoded one by one; a null id stays null. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import drop, materialise, released, rows_out, sliced

MARK = "▁"
#: Rows of the table, and bytes of its longest word.
TABLE_ROWS, LONG_CHUNK = 200_000, 48
#: Text counted at a time, and text coded at a time; a longer one alone.
FLUSH_BYTES, BATCH_BYTES = 8 << 20, 2 << 20
#: Steps of a level of counts: each level doubles LEVELS times as slowly as the count.
LEVELS = 8
PROBES = ("", " ", "a", " a", "a  b ", "a\tb\n c", "　x", "ﬁ é é", "a▁b", "\x00", " a")


def separable(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """True if chunks between whitespace markers can be encoded one by one."""
    n = sp.get_piece_size()
    special = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(MARK in p.lstrip(MARK) for p in special) or sp.is_unknown(sp.piece_to_id(MARK)):
        return False
    ids, cuts, decoded = ChunkCoder(sp).encode(pa.array(PROBES))
    own = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return own == [sp.encode(t) for t in PROBES] and decoded == [sp.decode(i) for i in own]


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Marked words of all texts (binary, with their leading spaces), and where each text's begin."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(pa.scalar(""), plain, pa.scalar(" ")))
    at = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    start = data == 32
    start[1:] &= ~start[:-1].copy() if len(start) else start[1:]
    start[at[:-1][at[:-1] < at[1:]]] = True
    first = np.flatnonzero(start).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, np.int32(len(data)))), pa.py_buffer(data)])
    return words, np.searchsorted(first, at)


class ChunkCoder:
    """Codes batches of texts through a table of words; what the table lacks is segmented once for each batch."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, table: pa.Table | None = None):
        self.sp, self.mark = sp, [sp.piece_to_id(MARK)]
        self.words = table["word"].combine_chunks() if table and table.num_rows else pa.array([], pa.binary())
        ids = table["ids"].combine_chunks() if table else pa.array([], pa.binary())
        self.n, self.ids = pc.binary_length(ids).to_numpy().astype(np.int64) // 4, np.frombuffer(b"".join(ids.to_pylist()), "<i4")
        odd = np.flatnonzero(table["decoded"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)) if table else []
        self.odd = {int(k): table["decoded"][int(k)].as_py() for k in odd}

    def segment(self, words: list[bytes]) -> dict:
        """ids (little-endian, packed) of each word, and its decoded form where that is not the word itself."""
        texts = [w.decode()[1:] for w in words]  # the library adds the first marker
        found = [ids or self.mark for ids in self.sp.encode(texts, num_threads=1)] if texts else []
        back = [" " + t for t in self.sp.decode(found, num_threads=1)] if found else []
        return {"ids": [np.array(i, "<i4").tobytes() for i in found], "decoded": [None if b == " " + t else b for b, t in zip(back, texts)]}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts without begin and end, where each text's begin, and the decoded texts."""
        words, cuts = chunked(texts)
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words) if len(self.words) else pa.nulls(len(coded.dictionary), pa.int32())
        lacking = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        own = self.segment(coded.dictionary.take(pa.array(lacking)).to_pylist())
        n, ids = np.array([len(x) // 4 for x in own["ids"]], np.int64), np.frombuffer(b"".join(own["ids"]), "<i4")
        row = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        row[lacking] = len(self.words) + np.arange(len(lacking))
        n, ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
        start = np.cumsum(n) - n
        at = row[coded.indices.to_numpy()]  # the join back by position
        size = n[at]
        end = np.cumsum(size)
        out = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(start[at] - end + size, size)]
        odd = self.odd | {len(self.words) + k: p for k, p in enumerate(own["decoded"]) if p is not None}
        decoded = [t.replace(MARK, " ") if t else "" for t in texts.to_pylist()]
        if odd:
            is_odd = np.concatenate([[0], np.cumsum(np.isin(at, list(odd)))])
            for k in np.flatnonzero(is_odd[cuts[1:]] > is_odd[cuts[:-1]]):
                span = range(cuts[k], cuts[k + 1])
                decoded[k] = "".join(odd.get(int(at[j])) or words[j].as_py().decode() for j in span)[1:]
        return out, np.concatenate([[0], end])[cuts], decoded


def chunk_table(texts: DataFrame, model: bytes, rows: int = TABLE_ROWS) -> pa.Table:
    """(word, ids, decoded): the most frequent marked words of a column `text`, each segmented once; at most `rows`."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", FLUSH_BYTES):
            coded = chunked(batch.column("text"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            size = pc.binary_length(coded.dictionary).to_numpy()
            kept = np.flatnonzero((n > 1) & (size <= LONG_CHUNK))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(kept)), pa.array(n[kept], pa.int64())], ["word", "n"])

    @released
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(sentencepiece.SentencePieceProcessor(model_proto=model))
        for batch in batches:
            made = coder.segment(batch.column("word").to_pylist())
            made = rows_out({"ids": (made["ids"], pa.binary()), "decoded": (made["decoded"], pa.string())})
            yield pa.RecordBatch.from_arrays([batch.column("word"), *made.columns], ["word", "ids", "decoded"])

    counted = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("level", F.floor(F.log2("n") * LEVELS).cast("int")))
    least, left = math.inf, rows
    for level, n in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 64 * LEVELS rows
        if n > left:
            break
        least, left = level, left - n
    chosen = counted.where(F.col("level") >= least) if left < rows else counted.limit(0)
    out = chosen.select("word").mapInArrow(segment, "word binary, ids binary, decoded string").toArrow()
    drop(counted)
    return out


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, ids array<int> with begin and end, decoded string, n_tokens, ids_sha256, decoded_sha256).

    with_ids=False leaves ids and decoded out where only the digests are wanted.
    """
    with open(model_file, "rb") as f:
        model = f.read()  # under 1 MB; travels with the tasks
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by_chunk = separable(sentencepiece.SentencePieceProcessor(model_proto=model))
    shared = docs.sparkSession.sparkContext.broadcast(chunk_table(texts.select("text"), model, table_rows) if by_chunk else None)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        coder = ChunkCoder(sp, shared.value) if by_chunk else None

        def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
            own = [sp.encode(t or "") for t in texts.to_pylist()]
            return np.array([i for ids in own for i in ids], np.int32), np.cumsum([0, *map(len, own)]), [sp.decode(ids) for ids in own]

        for batch in sliced(batches, "text", BATCH_BYTES):
            ids, cuts, decoded = coder.encode(batch.column("text")) if coder else whole(batch.column("text"))
            n_tokens = np.diff(cuts) + 2
            ends = np.cumsum(n_tokens)
            packed = np.empty(ends[-1] if len(ends) else 0, "<i4")
            inner = np.ones(len(packed), bool)
            for at, special in ((ends - n_tokens, sp.bos_id()), (ends - 1, sp.eos_id())):
                packed[at], inner[at] = special, False
            packed[inner] = ids
            columns = {"id": batch.column("id")}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(packed, pa.int32()))
                columns["decoded"] = pa.array(decoded, pa.string())
            columns["n_tokens"] = pa.array(n_tokens, pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(packed[b - n : b]).hexdigest() for b, n in zip(ends, n_tokens)], pa.string())
            columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "id long, " + "ids array<int>, decoded string, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
