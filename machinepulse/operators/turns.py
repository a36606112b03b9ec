"""Conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.operators.latest import newest_rows

# Number of turns kept, and how a turn is written.
TURN_LIMIT = 6
USER_ROLE = "user"
USER_LABEL = "User"
OTHER_LABEL = "Assistant"
TURN_SEPARATOR = "\n\n"


def _line(role: Column, text: Column) -> Column:
    speaker = F.when(role == USER_ROLE, F.lit(USER_LABEL)).otherwise(F.lit(OTHER_LABEL))
    return F.concat(speaker, F.lit(": "), F.coalesce(text, F.lit("")))


def _last_turns(messages: DataFrame, count: int) -> DataFrame:
    """Per conversation an ordered array of its last turns; the count bounds it."""
    turn = F.struct("turn", "role", "text")
    return (
        newest_rows(
            messages, ["conv_id"], count, ["turn", "role", "text"], large_groups=False
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )


def _written(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: _line(t["role"], t["text"])), TURN_SEPARATOR
    )


def recent_turns(messages: DataFrame, limit: int = TURN_LIMIT) -> DataFrame:
    """The last turns of each conversation as one text."""
    return _last_turns(messages, limit).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("turn_count"),
        _written(F.col("turns")).alias("history"),
    )


def open_questions(messages: DataFrame, limit: int = TURN_LIMIT) -> DataFrame:
    """Conversations whose newest turn is the user's: that turn as the question,
    the turns before it as history."""
    last = F.element_at("turns", -1)
    earlier = F.slice("turns", F.lit(1), F.size("turns") - 1)
    return (
        _last_turns(messages, limit + 1)
        .filter(last.getField("role") == USER_ROLE)
        .select(
            "conv_id",
            F.coalesce(last.getField("text"), F.lit("")).alias("question"),
            _written(earlier).alias("history"),
        )
    )
