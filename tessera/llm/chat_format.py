"""Preference formatting: the shared turns of chosen and rejected once as prompt, then paired masked completions.

Turns are rows (pair, turn, role, text) of two tables. Rows of both sides meet by pair, turn, role and text, so a turn
that both have is one row from the first shuffle on. The longest common turn prefix of a pair ends before the first
turn number that has a row of one side only. Each turn is rendered as a segment; a pair's prompt, chosen and
rejected strings are the segments of a part in the order of turn, role and text. The mask lists the half-open ranges
of characters of a completion that are trained on: what an assistant says in it, with its end mark. Prompts and
other roles are masked out.

A pair comes as one row; one of more than PIECE_TURNS turn numbers comes as several, numbered by `piece`, so no conversation
is gathered whole. Where one stretch of turn numbers has over PIECE_ROWS rows (many texts under one number), its rows are dealt
to parts of it by a hash. The whole of a pair is its pieces in the order of their stretches and parts; each piece has the
places of its strings in it, and a range of a mask, moved by the place of its completion, holds over the whole pair.

Edge cases: null role and text render as empty, but differ from empty ones; a null turn comes last, in a piece of its
own; a row that repeats in every column counts once; null pairs have no counterpart, are prompt throughout (their
rows come from the chosen side) and belong to no pair; if both sides are equal, all is prompt; a pair that only one side
has differs from its first turn on. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import join_groups, materialise

END = "<|end|>\n"
LAST_TURN = (1 << 63) - 1
#: Turn numbers of a piece, and rows of one from which they are dealt by hash.
PIECE_TURNS, PIECE_ROWS = 256, 4096
PARTS = ("prompt", "chosen", "rejected")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _parted(chosen: DataFrame, rejected: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(pair, turn, role, text, part, block, crowd, several): each distinct turn once; crowd is the number of rows of its block of turns, if over PIECE_ROWS; several: its pair comes in pieces."""

    def turns(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(F.col(pair_col).cast("long").alias("pair"), F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST_TURN)).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(side).alias("side"))

    both = turns(chosen, "chosen").unionByName(turns(rejected, "rejected"))
    rows = both.groupBy("pair", "turn", "role", "text").agg(F.min("side").alias("side"), F.max("side").alias("other"))
    rows = materialise(rows.withColumn("block", F.when(F.col("turn") == LAST_TURN, LAST_TURN).otherwise(F.floor(F.col("turn") / PIECE_TURNS))))
    sizes = rows.where("pair IS NOT NULL").groupBy("pair", "block").agg(F.min(F.when(F.col("side") == F.col("other"), F.col("turn"))).alias("unlike"), F.count("*").alias("n"))
    sizes = materialise(sizes)
    pairs = sizes.groupBy("pair").agg(F.min("unlike").alias("first_unlike"), F.sum("n").alias("rows"), ((F.count("*") > 1) | (F.max("n") > PIECE_ROWS)).alias("several"))
    out = join_groups(rows, materialise(pairs), "pair", "rows", F.concat_ws("/", F.col("turn").cast("string"), "side"))
    # few blocks are crowded: at most one for each PIECE_ROWS rows
    crowded = sizes.where(F.col("n") > PIECE_ROWS).select(F.concat_ws("/", "pair", "block").alias("at"), F.col("n").alias("crowd"))
    out = join_groups(out.withColumn("at", F.concat_ws("/", "pair", "block")), crowded, "at", "crowd", F.concat_ws("/", "at", F.xxhash64("role", "text")))
    shared = F.col("first_unlike").isNull() | (F.col("turn") < F.col("first_unlike"))
    out = out.where(~shared | (F.col("side") == "chosen")).withColumn("part", F.when(shared, F.array(F.lit("prompt"))).when(F.col("side") == F.col("other"), F.array("side")).otherwise(F.array("side", "other")))
    return out.select("pair", "turn", "role", "text", F.explode("part").alias("part"), "block", "crowd", "several")


def _rendered(rows: DataFrame) -> DataFrame:
    """Adds segment, train_from and train_to."""
    head = _head(F.col("role"))
    rows = rows.withColumn("segment", F.concat(head, F.coalesce("text", F.lit("")), F.lit(END)))
    trained = (F.col("part") != "prompt") & (F.coalesce("role", F.lit("")) == "assistant")
    return rows.withColumns({"train_from": F.when(trained, F.length(head)).otherwise(0).cast("long"), "train_to": F.when(trained, F.length("segment")).otherwise(0).cast("long")})


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair, part, turn, role, segment, train_from, train_to) for each turn; part is prompt, chosen or rejected."""
    out = _rendered(_parted(chosen, rejected, pair_col, turn_col, role_col, text_col))
    return out.select(F.col("pair").alias(pair_col), "part", F.when(F.col("turn") != LAST_TURN, F.col("turn")).alias("turn"), "role", "segment", "train_from", "train_to")


def pair_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair, piece, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_at, chosen_at, rejected_at): one row for each pair, or for each piece of a long one.

    piece: the block of turns ("0" for turns from 0 to PIECE_TURNS - 1), with "/k" for the further parts of a crowded one.
    A mask is a string of the half-open ranges of characters that are trained on, such as "14-52,90-120". A side without
    turns is empty. prompt_at, chosen_at, rejected_at: characters of the pair's string in the pieces before this one.
    """
    out = _rendered(_parted(chosen, rejected, pair_col, turn_col, role_col, text_col)).where("pair IS NOT NULL")
    dealt = F.when(F.col("crowd").isNotNull(), F.pmod(F.xxhash64("role", "text"), F.ceil(F.col("crowd") / PIECE_ROWS))).otherwise(0)
    out = out.withColumn("dealt", dealt.cast("long"))
    row = F.struct("turn", "role", "text", "segment", "train_from", "train_to")
    at = ["pair", "block", "dealt"]
    sizes = [F.sum(F.when(F.col("part") == part, F.length("segment")).otherwise(0)).alias(part) for part in PARTS]
    before = Window.partitionBy("pair").orderBy("block", "dealt").rowsBetween(Window.unboundedPreceding, -1)
    places = out.where("several").groupBy(*at).agg(*sizes).select(*at, *(F.sum(part).over(before).alias(f"{part}_at") for part in PARTS))
    out = out.groupBy(*at).agg(*(F.sort_array(F.collect_list(F.when(F.col("part") == part, row))).alias(part) for part in PARTS))
    out = out.join(places.hint("shuffle_hash"), at, "left")

    def mask(part: str) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("ranges"))

        def step(done: Column, turn: Column) -> Column:
            one = F.concat_ws("-", done["at"] + turn["train_from"], done["at"] + turn["train_to"])
            ranges = F.when(turn["train_to"] > turn["train_from"], F.array_append(done["ranges"], one)).otherwise(done["ranges"])
            return F.struct((done["at"] + F.length(turn["segment"])).alias("at"), ranges.alias("ranges"))

        return F.aggregate(part, none, step, lambda done: F.array_join(done["ranges"], ","))

    strings = (F.array_join(F.col(f"{part}.segment"), "").alias(part) for part in PARTS)
    starts = (F.coalesce(f"{part}_at", F.lit(0)).cast("long").alias(f"{part}_at") for part in PARTS)
    masks = (mask(part).alias(f"{part}_mask") for part in ("chosen", "rejected"))
    piece = F.concat_ws("/", "block", F.when(F.col("dealt") > 0, F.col("dealt")))
    return out.select(F.col("pair").alias(pair_col), piece.alias("piece"), *strings, *masks, *starts)


def last_answers_swapped(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rejected sides for conversations without preferences: the last assistant text becomes that of conversation id - 1 (empty if there is none)."""
    said = conversations.where("role = 'assistant' AND turn IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("conv")).agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"), F.count("*").alias("n"))
    said = materialise(said.where("conv IS NOT NULL"))
    other = said.select((F.col("conv") + 1).alias("conv"), F.col("last.text").alias("other"))
    answers = materialise(said.select("conv", F.col("last.turn").alias("last_turn"), "n").join(other, "conv", "left"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), "turn", "role", "text")
    rows = join_groups(rows, answers, "conv", "n", F.col("turn").cast("string"))
    swapped = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn")), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return rows.select(F.col("conv").alias(id_col), "turn", "role", swapped.alias("text"))
