"""Preference formatting in DataFrame operations only.

Chosen and rejected conversations are tables of turns. The longest common turn prefix of a pair is
rendered once, as its prompt; what follows on either side is a completion, of which the assistant's turns
bear the loss. Everything stays one row per turn, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import saved

# fixed values: the turn markers of the template
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def _turns(side: DataFrame, name: str) -> DataFrame:
    return side.where("pair_id is not null and turn is not null").select(
        "pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct().withColumn("side", F.lit(name))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, text, trained) per turn: part is prompt, chosen or rejected.

    Both inputs have pair_id, turn, role, text (more columns are ignored). Turns are matched by number;
    the prompt ends before the first number at which the two sides differ, also where only one has a
    turn. Pairs that are on one side only are left out. Null roles and texts are empty; rows with a null
    pair_id or turn are left out; repeated rows count once, and different rows of one turn number belong
    to the turn together. Equal conversations are prompt only.
    """
    both = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))
    sign = F.when(F.col("side") == "chosen", 1).otherwise(-1)
    balance = [
        F.sum((sign * F.xxhash64(F.lit(k), "role", "text")).cast("decimal(38,0)")).alias(f"b{k}") for k in (1, 2)
    ]
    per_turn = both.groupBy("pair_id", "turn").agg(
        *balance, F.max(F.col("side") == "chosen").alias("c"), F.max(F.col("side") == "rejected").alias("r")
    )
    ends = (
        per_turn.groupBy("pair_id")
        .agg(F.min(F.when((F.col("b1") != 0) | (F.col("b2") != 0), F.col("turn"))).alias("end"),
             F.max("c").alias("c"), F.max("r").alias("r"))
        .where("c and r").select("pair_id", "end")
    )
    prompt = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    return (
        both.join(ends, "pair_id").withColumn("part", F.when(prompt, "prompt").otherwise(F.col("side")))
        .where("part != 'prompt' or side = 'chosen'")
        .select("pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("text"),
                ((F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)).alias("trained"))
    )


def following(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The same rows with ``name``: ``value`` of the row with the next larger ``key``; the last takes the first's.

    Keys are distinct and may have gaps; rows with a null key are left out. Rows are sorted over the whole
    table, so a task holds one part of them, and only one row a part is looked at in a single task.
    """
    parts = saved(
        rows.where(F.col(key).isNotNull()).repartitionByRange(key).withColumn("part", F.spark_partition_id()), "parts"
    )
    heads = parts.groupBy("part").agg(F.min_by(F.struct(value), key).alias("head"))
    order = Window.orderBy("part")
    after = heads.select("part", F.lead("head").over(order).alias("after"), F.first("head").over(order).alias("top"))
    inside = F.lead(F.struct(value)).over(Window.partitionBy("part").orderBy(key))
    found = F.coalesce("inside", "after", "top")[value].alias(name)
    return parts.withColumn("inside", inside).join(after, "part").select(*rows.columns, found)


def preference_digests(turns: DataFrame) -> DataFrame:
    """One row per pair: turns and characters of the parts, trained characters, and a digest of all turns."""
    size = F.length("text")

    def chars(condition: str, name: str) -> Column:
        return F.sum(F.when(F.expr(condition), size).otherwise(0)).cast("long").alias(name)

    mark = F.md5(F.concat_ws("|", "part", F.col("turn").cast("string"), "text"))
    return turns.groupBy("pair_id").agg(
        F.sum(F.when(F.col("part") == "prompt", 1).otherwise(0)).cast("long").alias("prompt_turns"),
        chars("part = 'prompt'", "prompt_chars"), chars("part = 'chosen'", "chosen_chars"),
        chars("part = 'rejected'", "rejected_chars"),
        chars("part = 'chosen' and trained", "chosen_trained_chars"),
        chars("part = 'rejected' and trained", "rejected_trained_chars"),
        F.sum(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")).cast("long").alias("digest"),
    )


def preference_examples(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans): whole strings per pair.

    Spans are the (start, end) characters of a completion that bear the loss. A row holds one pair of
    conversations: use this where conversations fit a row, and ``format_preferences`` everywhere.
    """
    parts = turns.groupBy("pair_id").pivot("part", ["prompt", "chosen", "rejected"]).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "trained")))
    )

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda t: t["text"]), "").alias(name)

    def spans(name: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

        def step(state: Column, turn: Column) -> Column:
            end = state["at"] + F.length(turn["text"])
            span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
            found = F.when(turn["trained"], F.concat(state["found"], span)).otherwise(state["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        return F.aggregate(name, start, step, lambda s: s["found"]).alias(f"{name}_spans")

    return parts.select("pair_id", *map(joined, ("prompt", "chosen", "rejected")), spans("chosen"), spans("rejected"))
