"""Corpus pipeline: toxicity, exact dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; run() writes each stage's rows to the shared
folder and reads them back. Rows are judged one by one and one of equal or linked rows stays, whether ids repeat or are
null: exact dedup keeps the largest id and the n-gram join the smallest, and a null id only where all are null. Null
texts count as empty. Empty tables give no rows; without usable labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialise, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import bitmap_of, exact_dedup, with_hit
from tessera.llm.ngram_join import ngram_join
from tessera.llm.queries import tokenizer_file
from tessera.llm.sentencepiece_codec import encode_documents
from tessera.llm.toxicity import score_documents, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a batch of rows between Spark and Python; Spark's own value is 64 MB, which each of several workers and its JVM hold more than once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches, unless the session has a size of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def numbered(docs: DataFrame, nulls_first: bool) -> DataFrame:
    """docs with `row`, a key in the order of doc_id: the id itself, or a number of the row where ids repeat or are null.

    Only ids and digests are sorted, with a mark of the row behind them, so that rows of one id are dealt evenly.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    marked = materialise(docs.withColumn("mark", F.monotonically_increasing_id()))
    first = F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id")
    order = marked.select("doc_id", F.xxhash64(*COLUMNS[1:]).alias("digest"), "mark").orderBy(first, "digest", "mark")
    order = materialise(order.select(F.col("mark").alias("of"), F.monotonically_increasing_id().alias("row")))
    return materialise(marked.join(order, F.col("mark") == F.col("of")).select(*COLUMNS, "row"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without these (distinct) rows.

    A bitmap of their hashes lets most rows that stay pass at once; only what it hits meets the rows themselves, so the
    texts that stay are not shuffled.
    """
    gone = materialise(rows.select(F.col("row").alias("gone")), found=F.count("*"))
    marked = with_hit(docs.select(*COLUMNS, "row"), bitmap_of(gone, "gone", gone.seen_on_the_way["found"]), "row", "hit")
    met = marked.where("hit").join(gone, F.col("row") == F.col("gone"), "left_anti")
    return marked.where("NOT hit").select(*COLUMNS).unionByName(met.select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts toxic go."""
    small_batches(spark)
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, weights, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    docs = numbered(docs, nulls_first=True)
    return without(docs, exact_dedup(docs, id_col="row").where("NOT kept").select("row").distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the smallest doc_id stays."""
    small_batches(spark)
    docs = numbered(docs, nulls_first=False)
    return without(docs, ngram_join(docs, id_col="row").where("row <> class_id").select("row").distinct())


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of test items are cut out of the texts; a document of nothing else goes."""
    small_batches(spark)
    out = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), clean=True)
    left = F.length(F.trim("clean_text")) > 0
    out = out.where((F.col("n_hit") == 0) | left)
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests that show the round trip."""
    small_batches(spark)
    out = encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", cut_benchmark),
    ("sentencepiece", encode),
]
#: No SQL states a classifier or the segmentation of a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
