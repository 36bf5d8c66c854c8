"""Conversation history, messages and memory.  Messages are rows (conv_id, turn or ts, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.common import append, is_json
from docweave.operators.numbering import top_per_key

# The note added to the summary, and how many questions a memory keeps.
ASKED_ABOUT = " User hỏi về: "
KEPT_QUESTIONS = 5

MEMORY_SCHEMA = (
    "summary string, topics array<string>, "
    "entities struct<people: array<string>, organizations: array<string>, locations: array<string>>, "
    "key_points array<string>, last_questions array<string>, "
    "context struct<current_focus: string, references: array<string>>, "
    "metadata struct<message_count: bigint, last_updated: string>"
)


def recent_messages(messages: DataFrame, n: int = 10, order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation."""
    return top_per_key(messages, ["conv_id"], [F.desc(order)], n, "_back").drop("_back")


def history(messages: DataFrame, now: str, hours: int = 24, n: int = 10) -> DataFrame:
    """Messages strictly newer than ``hours`` before ``now``, then the last ``n``, ties by message id."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    young = messages.filter(F.col("ts") > cutoff)
    return top_per_key(young, ["conv_id"], [F.desc("ts"), F.desc("message_id")], n, "_back").drop("_back")


def conversation_stats(recent: DataFrame, system: DataFrame) -> DataFrame:
    """Per conversation: messages in the history, whether a system message exists, oldest and newest time."""
    counted = recent.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("history_count"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )
    flagged = system.select("conv_id").distinct().withColumn("has_system", F.lit(True))
    return counted.join(flagged, "conv_id", "full").select(
        "conv_id",
        F.coalesce("history_count", F.lit(0)).alias("history_count"),
        F.coalesce("has_system", F.lit(False)).alias("has_system"),
        "oldest",
        "newest",
    )


def active_conversations(messages: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Messages of conversations whose newest message is not older than the cutoff."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    newest = messages.groupBy("conv_id").agg(F.max("ts").alias("newest")).filter(F.col("newest") >= cutoff)
    return messages.join(newest.select("conv_id"), "conv_id", "left_semi")


def build_messages(system: DataFrame, recent: DataFrame, current: DataFrame, order: str = "turn") -> DataFrame:
    """(conv_id, messages): system message, history and the current question as one ordered array.

    The history is cut to its last messages before, so an array holds a dozen entries at most.
    """

    def part(df, section, place):
        return df.select("conv_id", F.lit(section).alias("section"), place.cast("long").alias("at"), "role", "content")

    rows = (
        part(system.withColumn("role", F.lit("system")), 0, F.lit(0))
        .unionByName(part(recent, 1, F.col(order)))
        .unionByName(part(current.withColumn("role", F.lit("user")), 2, F.lit(0)))
    )
    item = F.struct("section", "at", "role", "content")
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.select(
        "conv_id",
        F.transform("items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
    )


def has_history(conversations: DataFrame, recent: DataFrame, system: DataFrame) -> DataFrame:
    known = recent.select("conv_id").union(system.select("conv_id")).distinct().withColumn("_known", F.lit(True))
    return conversations.join(known, "conv_id", "left").select(
        "conv_id", F.coalesce("_known", F.lit(False)).alias("has_history")
    )


def initial_memory(now: Column | None = None) -> Column:
    return validate_memory(F.lit(None).cast(f"struct<{_struct_ddl()}>"), now)


def _struct_ddl() -> str:
    parts = [
        "summary: string", "topics: array<string>",
        "entities: struct<people: array<string>, organizations: array<string>, locations: array<string>>",
        "key_points: array<string>", "last_questions: array<string>",
        "context: struct<current_focus: string, references: array<string>>",
        "metadata: struct<message_count: bigint, last_updated: string>",
    ]
    return ", ".join(parts)


def parse_memory(text: Column) -> Column:
    """Memory struct from JSON text; missing keys are NULL."""
    return F.from_json(text, MEMORY_SCHEMA)


def validate_memory(memory: Column, now: Column | None = None) -> Column:
    """Fill missing parts with empty values."""
    none = F.expr("cast(array() as array<string>)")

    def text(col):
        return F.coalesce(col, F.lit(""))

    def items(col):
        return F.coalesce(col, none)

    stamp = now if now is not None else F.current_timestamp().cast("string")
    return F.struct(
        text(memory["summary"]).alias("summary"),
        items(memory["topics"]).alias("topics"),
        F.struct(*[items(memory["entities"][n]).alias(n) for n in ("people", "organizations", "locations")]).alias("entities"),
        items(memory["key_points"]).alias("key_points"),
        items(memory["last_questions"]).alias("last_questions"),
        F.struct(
            text(memory["context"]["current_focus"]).alias("current_focus"),
            items(memory["context"]["references"]).alias("references"),
        ).alias("context"),
        F.struct(
            F.coalesce(memory["metadata"]["message_count"], F.lit(0)).cast("long").alias("message_count"),
            F.coalesce(memory["metadata"]["last_updated"], stamp).alias("last_updated"),
        ).alias("metadata"),
    )


def update_memory(memories: DataFrame, exchanges: DataFrame, now: Column | None = None) -> DataFrame:
    """New memory after one exchange per conversation: summary note, last questions, two more messages.

    memories (conv_id, memory), exchanges (conv_id, question); a conversation without a memory starts one.
    """
    stamp = now if now is not None else F.current_timestamp().cast("string")
    joined = exchanges.join(memories, "conv_id", "left").withColumn("m", validate_memory(F.col("memory"), stamp))
    m = F.col("m")
    questions = append(m["last_questions"], F.col("question"))
    kept = F.slice(questions, F.greatest(F.size(questions) - (KEPT_QUESTIONS - 1), F.lit(1)), KEPT_QUESTIONS)
    note = F.concat(F.lit(ASKED_ABOUT), F.substring("question", 1, 50), F.lit("..."))
    new = (
        m.withField("summary", F.concat(m["summary"], note))
        .withField("last_questions", kept)
        .withField("metadata.message_count", m["metadata"]["message_count"] + 2)
        .withField("metadata.last_updated", stamp)
    )
    return joined.select("conv_id", new.alias("memory"))


def extract_json(reply: Column) -> Column:
    """The JSON inside a fenced block, or the whole reply; NULL when it does not parse."""
    fenced = F.regexp_extract(reply, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    body = F.when(reply.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), fenced).otherwise(reply)
    return F.when(is_json(body), body)
