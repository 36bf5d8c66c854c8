"""Contexts, prompt sections, messages and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts that frame the sections.
SOURCE_LABEL = "Nguồn"
MEMORY_HEAD = "### LỊCH SỬ CUỘC HỘI THOẠI:\n"
MEMORY_SUMMARY = "Tóm tắt: "
MEMORY_TOPICS = "Chủ đề: "
MEMORY_POINTS = "Các điểm chính đã đề cập:\n"
MEMORY_QUESTIONS = "Các câu hỏi gần đây:\n"
MEMORY_FOCUS = "Trọng tâm hiện tại: "
BASE_HEAD = "### THÔNG TIN CƠ SỞ KIẾN THỨC:\n"
BASE_TITLE = "Tiêu đề: "
BASE_DESCRIPTION = "Mô tả: "
PRIOR_QUESTIONS = "Các câu hỏi trước đó:\n"
PRIOR_SUMMARY = "\nTóm tắt hội thoại:\n"
RESERVED = ["custom_system_instruction", "custom_instruction_template", "conversation_memory"]
ROLE_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}


def _filled(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def build_context(hits: DataFrame, label: str = SOURCE_LABEL) -> DataFrame:
    """(query_id, context): ranked chunk texts with their document's name; a query has at most its top-k hits."""
    named = F.concat(F.lit(f"[{label}: "), F.col("document_name"), F.lit("] "))
    line = F.concat(F.when(_filled(F.col("document_name")), named).otherwise(""), F.col("chunk_text"))
    ranked = hits.select("query_id", F.struct("rank", line.alias("line")).alias("item"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists.select("query_id", F.array_join("items.line", "\n\n").alias("context"))


def build_user(context_template: Column, query_template: Column, instruction: Column, context: Column, query: Column) -> Column:
    return F.concat_ws(
        "\n\n",
        F.replace(context_template, F.lit("{{context}}"), context),
        F.replace(query_template, F.lit("{{query}}"), query),
        instruction,
    )


def memory_section(memory: Column) -> Column:
    """Section text of a memory struct (summary, topics, key_points, last_questions, context.current_focus)."""

    def listed(head, items):
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
        return F.when(F.size(items) > 0, F.concat(F.lit(head), lines, F.lit("\n"))).otherwise("")

    def line(head, col):
        return F.when(_filled(col), F.concat(F.lit(head), col, F.lit("\n\n"))).otherwise("")

    questions = memory["last_questions"]
    recent = F.slice(questions, F.greatest(F.size(questions) - 2, F.lit(1)), 3)
    return F.concat(
        F.lit(MEMORY_HEAD),
        line(MEMORY_SUMMARY, memory["summary"]),
        line(MEMORY_TOPICS, F.array_join(memory["topics"], ", ")),
        listed(MEMORY_POINTS, memory["key_points"]),
        listed(MEMORY_QUESTIONS, recent),
        line(MEMORY_FOCUS, memory["context"]["current_focus"]),
    )


def kb_section(title: Column, description: Column, wanted: Column | None = None) -> Column:
    def line(head, col):
        return F.when(_filled(col), F.concat(F.lit(head), col, F.lit("\n\n"))).otherwise("")

    text = F.concat(F.lit(BASE_HEAD), line(BASE_TITLE, title), line(BASE_DESCRIPTION, description))
    return text if wanted is None else F.when(F.coalesce(wanted, F.lit(True)), text).otherwise("")


def messages_to_prompt(messages: Column) -> Column:
    """One text from an ordered array<struct<role, content>>; unknown roles are dropped."""
    known = F.filter(messages, lambda m: m["role"].isin(list(ROLE_LABELS)))

    def labelled(m):
        name = F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])
        return F.concat(F.element_at(name, m["role"]), F.lit(": "), m["content"])

    return F.array_join(F.transform(known, labelled), "\n\n")


def merge_params(base: Column, request: Column) -> Column:
    """Base parameters overlaid by the request's, reserved keys left out; max_tokens becomes a whole number."""
    usable = F.map_filter(F.coalesce(request, F.expr("map()")), lambda k, v: ~k.isin(RESERVED))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(usable), k))
    merged = F.map_concat(kept, usable)

    def whole(k, v):
        return F.when(k == "max_tokens", v.try_cast("double").cast("long").cast("string")).otherwise(v)

    return F.transform_values(merged, whole)


def query_context(memory: Column) -> Column:
    """The last two questions as a list, then the summary."""
    questions = memory["last_questions"]
    recent = F.slice(questions, F.greatest(F.size(questions) - 1, F.lit(1)), 2)
    lines = F.array_join(F.transform(recent, lambda q: F.concat(F.lit("- "), q)), "\n")
    return F.concat(
        F.when(F.size(recent) > 0, F.concat(F.lit(PRIOR_QUESTIONS), lines)).otherwise(""),
        F.when(_filled(memory["summary"]), F.concat(F.lit(PRIOR_SUMMARY), memory["summary"])).otherwise(""),
    )


def override(default: Column, custom: Column) -> Column:
    """A custom text that is not blank wins."""
    return F.when(F.trim(F.coalesce(custom, F.lit(""))) != "", custom).otherwise(default)
