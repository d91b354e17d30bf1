"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import cut, partitions


def _turns(side: str) -> Column:
    """A side's turns in order of turn, ties by role and text."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, turn)))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("\n<|end|>\n"))


def render(turns: Column) -> Column:
    """Turns as text: a header line with the role, the text and an end line for each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, role: str = "assistant") -> Column:
    """The training mask over the characters of render(turns), as runs `flag:length`: 1 for what `role` says.

    A turn is two runs, its header (always 0) and its text with the end line.
    """
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("0:"), F.char_length(_head(t)), F.when(t["role"] == role, ",1:").otherwise(",0:"), F.char_length(_body(t)))), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    chosen and rejected hold the turns of each pair: pair_id, turn, role, text. The prompt is the longest run of first
    turns that both sides share in role and text, rendered once; the completions are what follows on each side, with a
    mask that trains on the turns of `role` only. Turns are compared by their place in order of (turn, role, text), so
    numbers may start anywhere, have gaps or ties. Null roles and texts count as empty. Equal sides, or one that is the
    beginning of the other, leave an empty completion with an empty mask; a pair without turns on one side has an empty
    prompt; rows without pair_id are left out. Other columns are not read. No turns give no rows.

    A pair is one group of two conversations; that is the unit that is rendered, and nothing larger is gathered.
    """
    both = (chosen.select("pair_id", "turn", "role", "text").withColumn("side", F.lit("c"))
            .unionByName(rejected.select("pair_id", "turn", "role", "text").withColumn("side", F.lit("r"))))
    pairs = both.where("pair_id is not null").groupBy("pair_id").agg(_turns("c").alias("c"), _turns("r").alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(first > 0, F.least(first - 1, short)).otherwise(short).cast("int"))
    rest = {s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in "cr"}
    return pairs.select(
        "pair_id", F.col("n").alias("prefix_turns"), render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        render(rest["c"]).alias("chosen"), render(rest["r"]).alias("rejected"),
        mask(rest["c"], role).alias("chosen_mask"), mask(rest["r"], role).alias("rejected_mask"))


def swapped_replies(conversations: DataFrame, role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Pairs (pair_id = 2 conv_id) whose rejected side ends with the last reply of another conversation.

    The other one is conv_id with its lowest bit changed; without it, or without a reply on either side, a conversation
    has no pair. The rejected side is the conversation before its last reply, and that reply exchanged.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    last = (rows.where(F.col("role") == role).groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("reply")).select("conv_id", F.col("reply.turn").alias("at"), F.col("reply.text").alias("reply")))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("swap"))
    usable = last.join(other, "conv_id").select("conv_id", "at", "swap")
    chosen = rows.join(usable, "conv_id").withColumn("pair_id", F.col("conv_id") * 2)
    kept = chosen.where(F.col("turn") < F.col("at")).select("pair_id", "turn", "role", "text")
    end = usable.select((F.col("conv_id") * 2).alias("pair_id"), F.col("at").alias("turn"), F.lit(role).alias("role"), F.col("swap").alias("text"))
    return chosen.select("pair_id", "turn", "role", "text"), kept.unionByName(end)


def _openings(rows: DataFrame) -> DataFrame:
    """(conv_id, role, text): the first turn of every conversation, ties by role and text; nulls count as empty."""
    return rows.groupBy("conv_id").agg(F.min(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                      F.coalesce("text", F.lit("")).alias("text"))).alias("o")).select("conv_id", "o.role", "o.text")


def _pair_sides(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    chosen = rows.join(pairs, "conv_id").select((F.col("conv_id") * 2 + 1).alias("pair_id"), "turn", "role", "text")
    rejected = rows.join(pairs.select(F.col("next").alias("conv_id"), (F.col("conv_id") * 2 + 1).alias("pair_id")), "conv_id")
    return chosen, rejected.select("pair_id", "turn", "role", "text")


def next_openings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (pair_id = 2 conv_id + 1) of a conversation and the next one of the whole table that opens with the same turn.

    Openings are dealt by ranges of (role, text, conv_id), so one that very many share is many ranges; the first
    opening of each range is carried back to the last one of the range before. The smaller conv_id is chosen.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    order = ["role", "text", "conv_id"]
    dealt = cut(_openings(rows).repartitionByRange(partitions(conversations.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))  # a row per range, however many rows it has
    ahead = first.select("part", F.lead("first").over(Window.orderBy("first")).alias("ahead"))
    here = F.lead(F.struct(*order)).over(Window.partitionBy("part").orderBy(*order))
    follow = dealt.withColumn("here", here).join(ahead, "part").withColumn("then", F.coalesce("here", "ahead"))
    pairs = follow.where((F.col("then.role") == F.col("role")) & (F.col("then.text") == F.col("text"))).select(
        "conv_id", F.col("then.conv_id").alias("next"))
    return _pair_sides(rows, pairs)
