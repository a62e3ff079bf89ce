"""Chat formatting: the dialogue seen by every participant in turn, with loss masks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_parts, saved

START, END, NAMED = "<|im_start|>", "<|im_end|>", "user name="
MESSAGE_CHARS = 32  # that a message counts for besides its text, so that very many short ones fill a piece as well


def rotate_perspectives(conversations: DataFrame, narrators: tuple[str, ...] = ("system",), piece_chars: int = 4_000_000, part_chars: int = 64_000_000) -> DataFrame:
    """conv_id, participant, piece, n_messages, rendered, mask_spans: each dialogue once for every participant.

    In a participant's rendering their own messages are the assistant's, everyone else is a named user, and roles in
    ``narrators`` keep their name and are nobody's perspective. ``mask_spans`` holds [from, to) in characters of
    the rendering: the participant's words with their end mark, on which loss is taken.

    A rendering is the concatenation of its rows in order of ``piece``: a new piece begins where the messages before make up
    another ``piece_chars`` characters, so a row holds that many and one message at most, however long a dialogue is, and a
    conversation that holds any share of all rows is spread over tasks. Spans count from the start of the dialogue. Messages
    are put in order without gathering a conversation: a range sort parts them, one part for about ``part_chars`` characters
    (a row number parts equal ones), its parts are summed up, and a message's place is that in its part plus the sums before. Piece numbers rise, not always by one.

    Defined results: null conv_id is one conversation; messages without turn come first; null text is empty and null role
    is a user without a name and no participant; repeated messages all stay; ties in turn go by role, then text; very long
    texts are rendered whole; conversations without participants give no row, nor does an empty table; chat marks inside a
    text lose their form (``<|`` becomes ``< |``); other columns, whatever their names, are ignored.
    """
    spark = conversations.sparkSession
    narrator = F.col("role").isin(*narrators)
    sent = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    sized = sent.withColumn("size", F.length("text").cast("long") + MESSAGE_CHARS)
    total = conversations.agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long") + MESSAGE_CHARS)).first()[0]
    rows = saved(sized.repartitionByRange(range_parts(spark, total, part_chars), *order).withColumn("part", F.spark_partition_id()), "messages")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "chars")])
    here = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    ahead = F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"place": F.row_number().over(here), "ahead": ahead}).join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    piece = F.floor((F.col("chars_before") + F.col("ahead")) / piece_chars)
    messages = placed.select("conv_id", piece.alias("piece"), F.struct((F.col("n_before") + F.col("place")).alias("number"), "role", "text").alias("m"))
    pieces = messages.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("m")).alias("messages"))

    by_role = placed.groupBy("conv_id", piece.alias("piece"), "role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long") + len(START + END) + 2).alias("chars"))
    by_role = saved(by_role, "chat-sizes")
    others = F.when(F.col("role").isNull(), len("user")).when(narrator, F.length("role")).otherwise(F.length("role") + len(NAMED))
    whole = by_role.groupBy("conv_id", "piece").agg(F.sum(F.col("chars") + F.col("n") * others).alias("chars"))
    who = by_role.where(F.col("role").isNotNull() & ~narrator).select(F.col("conv_id").alias("who_conv_id"), F.col("role").alias("participant")).distinct()
    own = by_role.select(F.col("conv_id").alias("own_conv_id"), F.col("piece").alias("own_piece"), F.col("role").alias("own_role"), F.col("n").alias("own_n"))
    theirs = whole.join(who, F.col("conv_id").eqNullSafe(F.col("who_conv_id")))
    theirs = theirs.join(own, F.col("conv_id").eqNullSafe(F.col("own_conv_id")) & (F.col("piece") == F.col("own_piece")) & (F.col("participant") == F.col("own_role")), "left")
    size = F.col("chars") + F.coalesce("own_n", F.lit(0)) * (len("assistant") - len(NAMED) - F.length("participant"))
    earlier = Window.partitionBy("conv_id", "participant").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = theirs.select(F.col("conv_id").alias("who_conv_id"), F.col("piece").alias("who_piece"), "participant", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("start"))
    seen = pieces.join(starts, pieces.conv_id.eqNullSafe(starts.who_conv_id) & (pieces.piece == starts.who_piece))

    def head(m: Column) -> Column:
        own = F.coalesce(m["role"] == F.col("participant"), F.lit(False))
        name = F.when(own, "assistant").when(m["role"].isNull(), "user").when(m["role"].isin(*narrators), m["role"]).otherwise(F.concat(F.lit(NAMED), m["role"]))
        return F.struct(F.concat(F.lit(START), name, F.lit("\n")).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), own.alias("own"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(m["head"])
        to = at + F.length(m["body"])
        return F.struct((to + 1).alias("at"), F.when(m["own"], F.concat(acc["spans"], F.array(F.struct(at.alias("from"), to.alias("to"))))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<from:long,to:long>>").alias("spans"))
    parts = seen.withColumn("parts", F.transform("messages", head))
    return parts.select(
        "conv_id",
        "participant",
        "piece",
        F.size("parts").alias("n_messages"),
        F.concat(F.array_join(F.transform("parts", lambda m: F.concat(m["head"], m["body"])), "\n"), F.lit("\n")).alias("rendered"),
        F.aggregate("parts", zero, step, lambda acc: acc["spans"]).alias("mask_spans"),
    )


ORACLE_SQL = r"""
WITH msgs AS (
  SELECT *, coalesce(sum(length(text) + 32) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4000000 AS piece FROM (
    SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, replace(coalesce(text, ''), '<|', '< |')) AS number
    FROM conversations)),
who AS (SELECT DISTINCT conv_id, role AS participant FROM msgs WHERE role IS NOT NULL AND role <> 'system'),
parts AS (
  SELECT m.conv_id, w.participant, m.piece, m.number,
         '<|im_start|>' || CASE WHEN m.role = w.participant THEN 'assistant' WHEN m.role IS NULL THEN 'user'
           WHEN m.role = 'system' THEN m.role ELSE 'user name=' || m.role END || chr(10) AS head,
         m.text || '<|im_end|>' AS body, coalesce(m.role = w.participant, false) AS own
  FROM msgs m JOIN who w ON m.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
             PARTITION BY conv_id, participant ORDER BY number
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM parts)
SELECT conv_id, participant, piece, count(*)::INT AS n_messages,
       string_agg(head || body, chr(10) ORDER BY number) || chr(10) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN pos::VARCHAR || '-' || (pos + length(body))::VARCHAR END, ',' ORDER BY pos), '') AS mask_spans
FROM placed GROUP BY conv_id, participant, piece
"""
