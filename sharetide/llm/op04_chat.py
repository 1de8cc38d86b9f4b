"""Chat formatting in budgeted windows (operator 4), in DataFrame functions only.

The template writes a turn as ``[role]text</s>`` and begins a window with ``<s>``.  In roles and texts a
backslash becomes ``\\b``, ``<`` becomes ``\\l``, ``[`` ``\\i`` and ``]`` ``\\j``, so no text can form a control string,
and ``unescape`` gives the text back.

Prefix sums of the turns' estimated tokens choose turn-aligned windows: a turn longer than half the
room has a window of its own, all others go to the window in which their prefix sum falls, so a window's
new turns fit the room.  Each window repeats the system turn and the tail of the window before it;
what is repeated lies outside the loss mask, so each assistant text is learnt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\i"), ("]", "\\j"))  # the backslash first


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """``conv_id``, ``window`` (from 0), ``formatted``, ``n_repeated`` and ``loss`` (array of start, end in code points).

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  ``budget`` tokens is the aim for a window's
    new turns and ``history`` for repeated ones, beside the system turn; a longer turn is never cut.  Null roles and texts
    count as empty, null conversations are one conversation, rows of equal turn are ordered by
    role and text, repeated rows are repeated turns.  The system turn is the first turn of role system.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = (budget - 1) // 2 + 1
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("piece", F.concat(F.lit("["), escape(F.col("role")), F.lit("]"), escape(F.col("text")), F.lit("</s>")))
        .withColumn("tokens", F.ceil(F.octet_length("piece") / 4).cast("bigint"))
        .withColumn("no", F.row_number().over(order))
        .withColumn("long", (F.col("tokens") > half).cast("int"))
        .withColumn("before", F.sum(F.when(F.col("long") == 0, F.col("tokens")).otherwise(0)).over(upto) - F.when(F.col("long") == 0, F.col("tokens")).otherwise(0))
        .withColumn("longs", F.sum("long").over(upto))
        .withColumn("is_system", (F.col("role") == "system") & (F.count(F.when(F.col("role") == "system", 1)).over(upto) == 1))
    )
    cell = F.struct(F.col("longs"), F.col("long"), F.when(F.col("long") == 0, F.floor(F.col("before") / half)).alias("grid"))
    placed = (
        sized.withColumn("cell", cell)
        .withColumn("new", F.coalesce((F.col("cell") != F.lag("cell").over(order)).cast("int"), F.lit(0)))
        .withColumn("window", F.sum("new").over(upto))
        .withColumn("tail", F.sum("tokens").over(Window.partitionBy("conv_id", "window").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    whole = Window.partitionBy("conv_id")
    placed = placed.withColumn("last", F.max("window").over(whole))
    shown = F.when(F.col("is_system"), F.sequence(F.col("window"), F.col("last"))).when(
        (F.col("tail") <= history) & (F.col("window") < F.col("last")), F.array(F.col("window"), F.col("window") + 1)
    ).otherwise(F.array("window"))
    rows = placed.select("conv_id", "no", "role", "text", "piece", F.col("window").alias("own"), F.explode(shown).alias("window"))
    turn = F.struct(
        "no", "piece", (F.col("own") < F.col("window")).alias("repeated"),
        F.char_length(F.col("piece")).alias("size"),
        F.when((F.col("role") == "assistant") & (F.col("own") == F.col("window")), F.char_length(escape(F.col("text")))).alias("learnt"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # A running position gives the spans of the mask: text ends four characters before its piece does.
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(t["learnt"].isNotNull(), F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["size"] - 4 - t["learnt"]).alias("start"), (acc["at"] + t["size"] - 4).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return grouped.select(
        "conv_id", "window",
        F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        spans.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``learnt`` (the text under the mask), recovered from the windows alone."""
    pieces = F.split(F.substring("formatted", 4, 2**31 - 1), "</s>", -1)
    turns = F.transform(
        F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0))),
        lambda p: F.struct(unescape(F.substring_index(F.substring(p, 2, 2**31 - 1), "]", 1)).alias("role"), unescape(F.substring_index(p, "]", -1)).alias("text")),
    )
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    read = formatted.select("conv_id", "window", F.char_length("formatted").cast("bigint").alias("size"), turns.alias("turns"), learnt.alias("learnt"))
    ordered = F.array_sort(F.collect_list(F.struct("window", "turns", "learnt")))
    return read.groupBy("conv_id").agg(ordered.alias("w"), F.sum("size").alias("formatted_chars")).select(
        "conv_id", "formatted_chars", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["learnt"]), "").alias("learnt")
    )


SAID = "</s>[INST] ok [/INST]"

SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, '[' || replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '[', '\\i'), ']', '\\j') || ']'
        || replace(replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '[', '\\i'), ']', '\\j') || '</s>' AS piece FROM turns),
t AS (SELECT *, cast(ceil(strlen(piece) / 4.0) AS BIGINT) AS tokens,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no FROM p),
c AS (SELECT *, tokens > 512 AS long,
        sum(CASE WHEN tokens > 512 THEN 0 ELSE tokens END) OVER w - CASE WHEN tokens > 512 THEN 0 ELSE tokens END AS before,
        sum(CASE WHEN tokens > 512 THEN 1 ELSE 0 END) OVER w AS longs,
        role = 'system' AND sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w = 1 AS sys
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, longs || '/' || long || '/' || CASE WHEN long THEN '' ELSE cast(floor(before / 512) AS BIGINT)::VARCHAR END AS cell FROM c),
f AS (SELECT *, CASE WHEN cell <> lag(cell) OVER (PARTITION BY conv_id ORDER BY no) THEN 1 ELSE 0 END AS fresh FROM g),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS win FROM f),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, win ORDER BY no DESC ROWS UNBOUNDED PRECEDING) AS tail,
        max(win) OVER (PARTITION BY conv_id) AS last FROM v),
s AS (SELECT conv_id, sum(length(piece) * CASE WHEN sys THEN last - win + 1 WHEN tail <= 256 AND win < last THEN 2 ELSE 1 END)
        + 3 * (max(last) + 1) AS formatted_chars FROM r GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(any_value(s.formatted_chars) AS BIGINT) AS formatted_chars
FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY t.conv_id
"""


@op_query("op4_chat", SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"),
    )
    read = read_back(windows(turns.unionByName(own)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
