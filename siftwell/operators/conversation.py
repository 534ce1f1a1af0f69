"""Conversations: recent turns and the rewriting of follow-up questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import queries as Q
from ..functions import text as T


def rewrite_follow_ups(turns: DataFrame, recent: int = 6) -> DataFrame:
    """Each user turn (conv_id, turn, role, text) with its query as it stands alone.

    A follow-up is led by the last user turn among the turns just before it and, where it refers to an answer, by the
    last assistant turn; turns count as recent among the ``recent`` user and assistant turns before.
    """
    kept = turns.filter(F.lower(F.trim("role")).isin("user", "assistant") & (T.squeeze(F.col("text")) != "")).withColumn("role", F.lower(F.trim("role")))
    short = T.truncate(F.col("text"), 420)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-recent, -1)
    said = lambda who: F.last(F.when(F.col("role") == who, short), ignorenulls=True).over(w)
    out = kept.withColumn("user_before", said("user")).withColumn("assistant_before", said("assistant")).filter("role = 'user'")
    query = T.squeeze(F.col("text"))
    follows = Q.is_follow_up(query) & (F.col("user_before").isNotNull() | F.col("assistant_before").isNotNull())
    refers = T.contains_any(F.lower(query), L.REFERENCED_ANSWER)
    parts = F.concat_ws(
        " | ", F.concat(F.lit("Previous question: "), F.col("user_before")), F.when(refers, F.concat(F.lit("Referenced answer: "), T.truncate(F.col("assistant_before"), 240))), F.concat(F.lit("Follow-up question: "), query)
    )
    return out.select("conv_id", "turn", follows.alias("is_follow_up"), F.when(follows, parts).otherwise(query).alias("rewritten"))
