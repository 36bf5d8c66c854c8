"""Row state of the stored tables: each function takes a table and its changes and returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators.numbering import top_per_key

SALTS = 64
DEFAULT_SEPARATOR = "\n\n---\n\n"


def _stamp(now: str | None) -> Column:
    return F.current_timestamp().cast("timestamp_ntz") if now is None else F.lit(now).cast("timestamp_ntz")


def _marked(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table with ``_hit`` = true for rows whose key is among ``ids``."""
    marks = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(marks, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _set(table: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET where ``cond`` holds; all conditions read the old row."""
    flagged = table.withColumn("_set", F.coalesce(cond, F.lit(False)))
    return flagged.withColumns(
        {name: F.when(F.col("_set"), value).otherwise(F.col(name)) for name, value in values.items()}
    ).drop("_set")


# --- chunks --------------------------------------------------------------------------------------------


def insert_chunks(chunks: DataFrame, documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with the new ones, and documents with those that got chunks marked as chunked."""
    marked = _marked(documents, new, "document_id")
    docs = marked.withColumn("is_chunked", F.col("is_chunked") | F.col("_hit")).drop("_hit")
    return chunks.unionByName(new, allowMissingColumns=True), docs


def last_change(changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row a key, as an update changes a stored row once; (key, *values) of one and the same change.

    With a column ``seq`` the last change of a key counts, without one the greatest; of equal ones the greatest values.
    """
    whole = F.struct(*values)
    order = F.struct("seq", whole.alias("_v")) if "seq" in changes.columns else whole
    return changes.groupBy(key).agg(F.max_by(whole, order).alias("_last")).select(key, "_last.*")


def update_text(chunks: DataFrame, changes: DataFrame, now: str | None = None) -> DataFrame:
    """New text (chunk_id, new_text, maybe seq) for chunks that are not deleted; the last change that gives a text counts."""
    given = last_change(changes.filter("new_text is not null"), "chunk_id", ["new_text"])
    joined = chunks.join(given, "chunk_id", "left")
    cond = F.col("new_text").isNotNull() & ~F.col("is_deleted")
    return _set(joined, cond, {"chunk_text": F.col("new_text"), "updated_at": _stamp(now)}).drop("new_text")


def apply_changes(chunks: DataFrame, changes: DataFrame, now: str | None = None) -> DataFrame:
    """Chunks after all ``changes`` (chunk_id, seq, op, new_text) one after the other by seq, in whatever order they come.

    op is update, delete or restore.  An update counts where the chunk is live at that moment, so one behind a delete and
    before a restore is lost; the last that counts gives the text.  Of changes of one seq, deletes go first, then restores.
    """
    rank = F.when(F.col("op") == "delete", 0).when(F.col("op") == "restore", 1).when(F.col("op") == "update", 2)
    known = changes.select("chunk_id", "seq", rank.alias("_rank"), "new_text").filter("_rank is not null")
    own = known.join(chunks.select("chunk_id", F.col("is_deleted").alias("_was")), "chunk_id")
    earlier = W.partitionBy("chunk_id").orderBy("seq", "_rank", "new_text").rowsBetween(W.unboundedPreceding, W.currentRow)
    toggle = F.last(F.when(F.col("_rank") < 2, F.col("_rank") == 0), ignorenulls=True).over(earlier)
    stated = own.withColumn("_dead", F.coalesce(toggle, F.col("_was")))
    at = F.struct("seq", "_rank", "new_text")
    counts = (F.col("_rank") == 2) & ~F.col("_dead") & F.col("new_text").isNotNull()
    ends = stated.groupBy("chunk_id").agg(
        F.max_by("_dead", at).alias("_dead"),
        F.max_by("new_text", F.when(counts, at)).alias("_text"),
        F.bool_or(counts).alias("_changed"),
        F.bool_or((F.col("_rank") == 0) & F.col("_dead")).alias("_gone"),
    )
    joined = chunks.join(ends, "chunk_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_changed", "_gone")})
    return joined.withColumns(
        {
            "chunk_text": F.when(F.col("_changed"), F.col("_text")).otherwise(F.col("chunk_text")),
            "updated_at": F.when(F.col("_changed"), _stamp(now)).otherwise(F.col("updated_at")),
            "delete_time": F.when(F.col("_gone"), _stamp(now)).otherwise(F.col("delete_time")),
            "is_deleted": F.coalesce("_dead", "is_deleted"),
        }
    ).drop("_dead", "_text", "_changed", "_gone")


def soft_delete(chunks: DataFrame, ids: DataFrame, now: str | None = None) -> DataFrame:
    cond = F.col("_hit") & ~F.col("is_deleted")
    return _set(_marked(chunks, ids, "chunk_id"), cond, {"is_deleted": F.lit(True), "delete_time": _stamp(now)}).drop("_hit")


def restore(chunks: DataFrame, ids: DataFrame, now: str | None = None) -> DataFrame:
    """Deleted rows come back; the time of deletion is kept."""
    cond = F.col("_hit") & F.col("is_deleted")
    return _set(_marked(chunks, ids, "chunk_id"), cond, {"is_deleted": F.lit(False), "updated_at": _stamp(now)}).drop("_hit")


def hard_delete(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def list_chunks(chunks: DataFrame, live_only: bool = False) -> DataFrame:
    return chunks.filter("not is_deleted") if live_only else chunks


def document_chunks(chunks: DataFrame, document_id=None) -> DataFrame:
    """Chunks with their place in the document by creation time; of one document if given."""
    kept = chunks if document_id is None else chunks.filter(F.col("document_id") == document_id)
    return kept.orderBy("document_id", "create_time", "chunk_id")


def get_chunk(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Live chunks by id."""
    return chunks.filter("not is_deleted").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


# --- embeddings ----------------------------------------------------------------------------------------


def pending_chunks(chunks: DataFrame, document_id=None, ids: DataFrame | None = None) -> DataFrame:
    """Chunks without an embedding, optionally of one document or among given ids."""
    out = chunks.filter("embedding is null")
    if document_id is not None:
        out = out.filter(F.col("document_id") == document_id)
    return out if ids is None else out.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def fill_embeddings(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings (chunk_id, embedding, maybe seq) go in only where there is none; sets is_done.

    The first one given for a chunk fills it, as later ones find it filled; without seq the greatest.
    """
    offered = new.filter("embedding is not null").withColumn("_new", F.col("embedding"))
    if "seq" in new.columns:
        given = offered.groupBy("chunk_id").agg(F.min_by("_new", F.struct("seq", "_new")).alias("_new"))
    else:
        given = last_change(offered, "chunk_id", ["_new"])
    filled = chunks.join(given, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")
    return filled.withColumn("is_done", F.col("embedding").isNotNull())


def reset_embeddings(
    chunks: DataFrame, documents: DataFrame, ids: DataFrame, now: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Drop the vectors of the given documents and clear their done flag."""
    nothing = F.lit(None).cast(chunks.schema["embedding"].dataType)
    new_chunks = _set(_marked(chunks, ids, "document_id"), F.col("_hit"), {"embedding": nothing, "updated_at": _stamp(now)})
    new_docs = _set(
        _marked(documents, ids, "document_id"), F.col("_hit"), {"is_embedding_done": F.lit(False), "updated_at": _stamp(now)}
    )
    return new_chunks.drop("_hit"), new_docs.drop("_hit")


def delete_document_chunks(
    chunks: DataFrame, documents: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks without those of the given documents, documents with their flags reset, and the deleted counts."""
    kept = chunks.join(ids.select("document_id"), "document_id", "left_anti")
    docs = _set(
        _marked(documents, ids, "document_id"),
        F.col("_hit"),
        {"is_chunked": F.lit(False), "is_embedding_done": F.lit(False)},
    ).drop("_hit")
    gone = chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    return kept, docs, gone.groupBy("document_id").agg(F.count(F.lit(1)).alias("deleted"))


def embedding_progress(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Embedded, total and percent (0 without chunks)."""
    counted = chunks.groupBy(*(keys if keys is not None else ["document_id"])).agg(
        F.count("embedding").alias("embedded"), F.count(F.lit(1)).alias("total")
    )
    percent = F.when(F.col("total") > 0, F.col("embedded") / F.col("total") * 100).otherwise(0.0)
    return counted.withColumn("percent", percent)


def all_embedded(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, all_embedded); true for a document without chunks."""
    state = chunks.groupBy("document_id").agg(F.bool_and(F.col("embedding").isNotNull()).alias("all_embedded"))
    return documents.select("document_id").join(state, "document_id", "left").select(
        "document_id", F.coalesce("all_embedded", F.lit(True)).alias("all_embedded")
    )


def mark_embedded(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    joined = documents.join(all_embedded(chunks, documents), "document_id")
    return _set(joined, F.col("all_embedded"), {"is_embedding_done": F.lit(True)}).drop("all_embedded")


# --- configurations and descriptions -------------------------------------------------------------------


def upsert_config(configs: DataFrame, new: DataFrame, now: str | None = None) -> DataFrame:
    """(user_id, config, created_at, updated_at) after inserting or replacing (user_id, config)."""
    given = last_change(new.filter("config is not null").withColumn("_config", F.col("config")), "user_id", ["_config"])
    joined = configs.join(given, "user_id", "full")
    changed = F.col("_config").isNotNull()
    return joined.select(
        "user_id",
        F.coalesce("_config", "config").alias("config"),
        F.coalesce(F.col("created_at"), _stamp(now)).alias("created_at"),
        F.when(changed, _stamp(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def user_config(users: DataFrame, configs: DataFrame, default: str) -> DataFrame:
    joined = users.join(configs.select("user_id", "config"), "user_id", "left")
    return joined.select("user_id", F.coalesce("config", F.lit(default)).alias("config"))


def needs_description(description: Column, force: bool = False) -> Column:
    return F.lit(True) if force else F.trim(F.coalesce(description, F.lit(""))) == ""


def rollup_descriptions(documents: DataFrame, max_chars: int = 20_000, sep: str = DEFAULT_SEPARATOR) -> DataFrame:
    """(kb_id, text): descriptions of the live documents of a base joined by id, cut to ``max_chars``.

    Every description adds at least one character and a separator, so only so many of the first documents of a
    base can show in the cut text; the rest is left out before anything is gathered.  A base is first cut in
    ``SALTS`` parts, so that a large one is not sorted by one task.
    """
    live = documents.filter("not is_deleted").filter(F.coalesce("description", F.lit("")) != "")
    enough = max_chars // (len(sep) + 1) + 1
    short = live.select("kb_id", "document_id", F.substring("description", 1, max_chars).alias("description"))
    salted = short.withColumn("_salt", F.pmod(F.xxhash64("document_id"), F.lit(SALTS)))
    part = top_per_key(salted, ["kb_id", "_salt"], ["document_id"], enough, "_n").drop("_n")
    first = top_per_key(part, ["kb_id"], ["document_id"], enough, "_n")
    lists = first.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "description"))).alias("items"))
    return lists.select("kb_id", F.substring(F.array_join("items.description", sep), 1, max_chars).alias("text"))


def set_descriptions(table: DataFrame, new: DataFrame, key: str, now: str | None = None) -> DataFrame:
    """Descriptions (key, description) where given, with the time of the change."""
    given = last_change(new.filter("description is not null").withColumn("_new", F.col("description")), key, ["_new"])
    joined = table.join(given, key, "left")
    cond = F.col("_new").isNotNull()
    return _set(joined, cond, {"description": F.col("_new"), "updated_at": _stamp(now)}).drop("_new")
