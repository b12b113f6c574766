"""Chat formatting in SQL functions: cumulative snapshots collapse to maximal conversations.

A conversation is logged again whenever it grows. The rolling hash of its turns up to each one tells
whether another conversation begins with all of it: an anti-join drops those, equal ones
collapse to the smallest id, and what is left is rendered. The rolling hash is an exclusive or of
hashes of (turn, role, text), so it is computed in blocks of turns and no task needs a whole
long conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

#: Turns (by number) of a block; also the turns of one rendered part.
BLOCK = 256


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without null ids or turns; null roles and texts are empty."""
    return conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )


def prefix_hashes(said: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, last): 128-bit hash of all turns up to and with this one."""
    block = F.floor(F.col("turn") / BLOCK)
    each = (
        said.select(
            "conv_id",
            "turn",
            F.xxhash64("turn", "role", "text").alias("h1"),
            F.xxhash64(F.lit(1), "text", "role", "turn").alias("h2"),
        )
        .distinct()  # a repeated row must not cancel itself
        .groupBy("conv_id", "turn")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .withColumn("block", block)
    )
    each = durable(each, "turns")
    blocks = each.groupBy("conv_id", "block").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.max("turn").alias("block_last")
    )
    conversation = Window.partitionBy("conv_id")
    before = conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("c2"),
        F.max("block_last").over(conversation).alias("last"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = each.select(
        "conv_id", "block", "turn", F.bit_xor("h1").over(inside).alias("h1"), F.bit_xor("h2").over(inside).alias("h2")
    )
    return running.join(blocks, ["conv_id", "block"]).select(
        "conv_id",
        "turn",
        F.col("h1").bitwiseXOR(F.col("c1")).alias("k1"),
        F.col("h2").bitwiseXOR(F.col("c2")).alias("k2"),
        "last",
    )


def maximal(said: DataFrame) -> DataFrame:
    """(conv_id, n_copies): one id for each conversation that no other one begins with."""
    prefixes = durable(prefix_hashes(said), "prefixes")
    whole = (
        prefixes.filter(F.col("turn") == F.col("last"))
        .groupBy("k1", "k2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    begun = prefixes.filter(F.col("turn") < F.col("last")).select("k1", "k2").distinct()
    return whole.join(begun, ["k1", "k2"], "left_anti").select("conv_id", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered) of the maximal conversations.

    Edge cases: rows without conv_id or turn belong to no conversation; a null role or text is
    rendered as an empty one; repeated rows count once; different rows with one turn number
    are one step of the conversation, rendered by role and text. Conversations correspond by turn
    number. Turns k * BLOCK and on make part k, so no row holds an unbounded conversation. An empty
    table gives no row. Columns other than the four are not read.
    """
    said = turns(conversations)
    kept = durable(maximal(said), "maximal")
    line = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))
    part = F.floor(F.col("turn") / BLOCK).alias("part")
    return (
        said.join(kept, "conv_id")
        .groupBy("conv_id", part, "n_copies")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            "part",
            F.size("turns").cast("bigint").alias("n_turns"),
            "n_copies",
            F.array_join(F.transform("turns", line), "").alias("rendered"),
        )
    )


@query(
    """
    WITH said AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ), steps AS (
        SELECT conv_id, turn,
               string_agg(turn || chr(1) || role || chr(2) || text || chr(3), '' ORDER BY role, text) AS step
        FROM said GROUP BY conv_id, turn
    ), prefixes AS (
        SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last,
               sha256(string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS prefix
        FROM steps
    ), kept AS (
        SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes
        WHERE turn = last AND prefix NOT IN (SELECT prefix FROM prefixes WHERE turn < last)
        GROUP BY prefix
    )
    SELECT conv_id, turn // 256 AS part, count(*) AS n_turns, n_copies,
           sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                             ORDER BY turn, role, text)) AS rendered_sha256
    FROM said JOIN kept USING (conv_id) GROUP BY conv_id, turn // 256, n_copies
    """
)
def op1_chat_format(spark: SparkSession, root: str) -> DataFrame:
    shown = render(table(spark, root, "conversations"))
    return shown.select("conv_id", "part", "n_turns", "n_copies", F.sha2("rendered", 256).alias("rendered_sha256"))
