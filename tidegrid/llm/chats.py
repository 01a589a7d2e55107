"""Chat formatting of maximal conversations; DataFrame functions only.

Logs often hold a conversation again after each turn.  Every conversation's turns get rolling prefix hashes: hash of
the first turn, of the first two, and so on.  A conversation whose hash is a shorter prefix of another is dropped by an
anti-join, equal ones are kept once (the least conv_id); the rest are rendered turn by turn.

The prefix hash at a turn is the exclusive or of two 64-bit hashes of (place, role, text) over the turns so far, so it
comes from one ordered window over narrow rows.  Equal prefixes are aggregated before the join, and texts move only
for conversations that are kept.

Defined results: turns without conv_id belong to no conversation and are left out; a turn logged twice in one
conversation counts once; null roles and texts are empty strings; different turns with one number, or with none, which
come first, are ordered by the MD5 of role and text; texts of any length are taken whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.unhex(F.md5(F.concat("role", F.lit("\n"), "text")))
    return turns.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64("text", F.lit(1), "role"), "tie": tie})


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, n_turns, p, q): the prefix hashes of each conversation."""
    own = Window.partitionBy("conv_id")
    order = own.orderBy(F.asc_nulls_first("turn"), "tie", "h", "g")
    placed = turns.select("conv_id", "turn", "tie", "h", "g").distinct().withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = placed.withColumns({"x": F.xxhash64("place", "h"), "y": F.xxhash64("g", "place")})
    return mixed.select("conv_id", "place", F.count("*").over(own).alias("n_turns"), F.bit_xor("x").over(so_far).alias("p"), F.bit_xor("y").over(so_far).alias("q"))


def maximal(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one."""
    rows = prefixes(turns)
    whole = rows.where("place = n_turns").groupBy("n_turns", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = rows.where("place < n_turns").groupBy("place", "p", "q").agg(F.count("*").alias("times")).select(F.col("place").alias("n_turns"), "p", "q")
    return whole.join(shorter, ["n_turns", "p", "q"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    turns = _turns(conversations)
    kept = turns.join(maximal(turns), "conv_id")
    gathered = kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_set(F.struct("turn", "tie", "h", "g", "role", "text"))).alias("turns"))
    each = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE)))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(each, "").alias("rendered"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select("conv_id", F.col("n_turns").cast("long"), "n_copies", "rendered")


OP6_SQL = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), rolled AS (
    SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))
), whole AS (
    SELECT prefix AS rendered, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE place = n_turns GROUP BY prefix, n_turns
)
SELECT conv_id, n_turns, n_copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place < r.n_turns AND r.place = w.n_turns AND r.prefix = w.rendered)
"""
