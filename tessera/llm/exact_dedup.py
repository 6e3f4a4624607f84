"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level keeps only groups of two or more. What survives a level is passed on as a bitmap of key hashes (broadcast), so
a later scan hashes content only of surviving rows and no text is ever shuffled. The bitmap has 8 bits for each key
that repeats, from 2 ** MIN_BITS to 2 ** MAX_BITS bits (32 MB) in all. A false hit costs a needless hash and changes no
result, also where keys are so many that most bits of the largest bitmap are set; a row that can have an equal always
passes.

Edge cases: null text counts as empty; empty texts equal each other; a null id is a defined row of its group
(the largest non-null id stays; with null ids only, they stay); rows that repeat an id and a text are counted
one by one, and all of them carry the decision of their id. An empty table gives no rows. Other columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower, drop, join_groups, materialise

MIN_BITS, MAX_BITS = 20, 28
PREFIX_CHARS = 256
#: Bits of one row of bitmap_construct_agg.
ROW_BITS = 32768


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.floor(at / ROW_BITS).cast("int"), F.pmod(at, F.lit(ROW_BITS)).cast("int")


def _survivors(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Bitmap of the keys that two or more rows have, at most 2 ** MAX_BITS / ROW_BITS rows of 4 KB, and its bits as a power of 2."""
    repeated = materialise(keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), found=F.count("*"))
    out = bitmap_of(repeated, key, repeated.seen_on_the_way["found"])
    drop(repeated)
    return out


def bitmap_of(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Bitmap of the hashes of n keys, and its bits as a power of 2."""
    bits = min(max(MIN_BITS, (8 * n).bit_length()), MAX_BITS)
    bucket, bit = _place(F.col(key), bits)
    return materialise(keys.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))), bits


def with_hit(rows: DataFrame, marks: tuple[DataFrame, int], key: str, name: str) -> DataFrame:
    """rows with a column that is true where the bitmap has the key's hash."""
    bitmap, bits = marks
    bucket, bit = _place(F.col(key), bits)
    out = rows.withColumns({"at_bucket": bucket, "at_bit": bit}).join(F.broadcast(bitmap), F.col("at_bucket") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bits", F.expr("at_bit div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("bits IS NOT NULL") & (F.expr("1").cast("int") == F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("at_bit"), F.lit(8)))).cast("int"), F.lit(2))), F.lit(False))
    return out.withColumn(name, hit).drop("at_bucket", "at_bit", "bucket", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z. text_sha256 is null for rows that no level had to
    hash in full; with digest_all every row gets it.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by_length = base.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("length"))
    lengths = _survivors(by_length, "length")

    sized = base.withColumn("length", F.coalesce(F.octet_length("text"), F.lit(0)))
    prefixed = with_hit(sized, lengths, "length", "same_length").withColumn("prefix", F.when(F.col("same_length"), F.xxhash64("length", F.substring(text, 1, PREFIX_CHARS))))
    prefixes = _survivors(prefixed.where("same_length").select("prefix"), "prefix")

    rows = with_hit(prefixed, prefixes, "prefix", "same_prefix").withColumn("compared", F.col("same_length") & F.col("same_prefix"))
    rows = materialise(rows.select("id", "compared", F.when(F.col("compared") | F.lit(digest_all), F.sha2(text, 256)).alias("digest")))
    groups = materialise(rows.where("compared").groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("largest")).where("n > 1"))
    out = join_groups(rows, groups, "digest", "n", F.col("id").cast("string"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("largest"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
