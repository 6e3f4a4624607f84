"""Very long texts through operators whose other tests hold short ones."""

import hashlib

from tessera.llm import chat_format, exact_dedup
from tests.llm.test_ops import frame

LONG = "Ein sehr langer Text, é. " * 200_000


def test_exact_dedup(spark):
    texts = [LONG, LONG.upper().replace("É", "é"), LONG + "x", LONG[:-1] + "y", "short"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), digest_all=True).collect()}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True), 4: (4, 1, True)}
    assert got[0].text_sha256 == hashlib.sha256(LONG.lower().encode()).hexdigest()


def test_chat_format(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "a")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "b")], schema)
    (row,) = chat_format.pair_preferences(chosen, rejected).collect()
    head, end = "<|assistant|>\n", "<|end|>\n"
    assert row.prompt == f"<|user|>\n{LONG}{end}"
    for text, mask, said in ((row.chosen, row.chosen_mask, LONG + "a"), (row.rejected, row.rejected_mask, LONG + "b")):
        a, b = map(int, mask.split("-"))
        assert text == head + said + end and text[a:b] == said + end
