"""Turn pairs of conversations and summaries of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words, trimmed

#: Bytes of a turn, words of the gist of the turn before, tokens a message costs besides its text.
MAX_TURN_BYTES, GIST_WORDS, MESSAGE_COST = 200_000, 12, 8


def with_defaults(messages: DataFrame) -> DataFrame:
    """Messages with the optional columns that turn pairs look at."""
    return messages if "tool_name" in messages.columns else messages.withColumn("tool_name", F.lit(None).cast("string"))


def turns(messages: DataFrame) -> DataFrame:
    """One row per user message: the first non-empty reply before the next one, the last hidden reasoning before that, and why it is skipped."""
    m = with_defaults(messages)
    number = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = m.withColumn("turn_no", number).filter("turn_no > 0")
    is_reply = (F.col("role") == "assistant") & (F.col("content") != "")
    reply_at = F.min(F.when(is_reply, F.col("seq"))).over(Window.partitionBy("session_id", "turn_no"))
    m = m.withColumn("reply_at", reply_at)
    cot = F.max(F.when((F.col("role") == "cot") & (F.col("reply_at").isNull() | (F.col("seq") < F.col("reply_at"))), F.struct("seq", "content")))
    grouped = m.groupBy("session_id", "turn_no").agg(
        F.max(F.when(F.col("role") == "user", F.col("seq"))).alias("start_seq"),
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("user_text"),
        F.max(F.when(F.col("role") == "user", F.col("tool_name"))).alias("driver"),
        F.max(F.when(F.col("seq") == F.col("reply_at"), F.col("content"))).alias("reply"),
        F.max("reply_at").alias("reply_at"), cot.alias("cot"),
    )
    empty = (F.coalesce(trimmed(F.col("user_text")), F.lit("")) == "") | (F.coalesce(trimmed(F.col("reply")), F.lit("")) == "")
    size = F.octet_length("user_text") + F.coalesce(F.octet_length("reply"), F.lit(0))
    skip = F.when(F.col("driver") == "manage_plan", "plan-driven").when(empty, "no reply").when(size > MAX_TURN_BYTES, "too long")
    return grouped.select("session_id", "turn_no", "start_seq", "user_text", "reply", F.coalesce("reply_at", "start_seq").alias("end_seq"), F.col("cot.content").alias("cot"), skip.alias("skip_reason"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Accepted turns with their reference, text and the gist of the accepted turn before."""
    ok = turns(messages).filter("skip_reason is null")
    gist = F.lag(first_words(F.col("user_text"), GIST_WORDS)).over(Window.partitionBy("session_id").orderBy("start_seq"))
    ref = F.format_string("%s#%s-%s", F.col("session_id").cast("string"), F.col("start_seq").cast("string"), F.col("end_seq").cast("string"))
    text = F.concat(F.lit("User: "), trimmed(F.col("user_text")), F.lit("\n\nAssistant: "), trimmed(F.col("reply")))
    return ok.select("session_id", "start_seq", "end_seq", ref.alias("ref"), text.alias("turn_text"), F.coalesce(gist, F.lit("")).alias("prev_gist"), "cot")


def thread_context(title: Column, prev_gist: Column) -> Column:
    """Title and the gist of what went before, as far as there are any."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    return F.concat_ws(" — ", part("Conversation: ", title), part("Previously: ", prev_gist))


def session_list(messages: DataFrame) -> DataFrame:
    """Per session: messages of user and assistant, last sequence number; most recent first by number."""
    shown = F.col("role").isin("user", "assistant")
    return messages.groupBy("session_id").agg(F.sum(F.when(shown, 1).otherwise(0)).alias("message_count"), F.max("seq").alias("last_seq"))


def next_seq(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The number that each session's next message gets."""
    top = messages.groupBy("session_id").agg(F.max("seq").alias("top"))
    return sessions.select("session_id").distinct().join(top, "session_id", "left").select("session_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_seq"))


def context_tokens(messages: DataFrame) -> DataFrame:
    """Estimated prompt tokens of each session's shown messages."""
    cost = F.ceil(F.length("content") / 4) + MESSAGE_COST
    return messages.filter(F.col("role").isin("user", "assistant")).groupBy("session_id").agg(F.sum(cost).alias("tokens"))
