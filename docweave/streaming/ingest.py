"""Continuous work on arriving documents, queries and messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.functions import folds
from docweave.functions.keywords import keywords
from docweave.functions.text import prepared_sentences, words

DOCUMENT_SCHEMA = "doc_id long, text string"
# One arriving batch holds at most this many files, so a backlog is worked off in steps.
FILES_PER_BATCH = 1000
# Groups that the keys of a de-duplicating stream are dealt to; each is a call and a state of its own.
DEDUPE_GROUPS = 2048


def window_chunks(docs: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """(doc_id, chunk, text, keywords): windows over the prepared sentences; row by row, for batch and stream alike."""
    clean = docs.select("doc_id", F.array_join(prepared_sentences(F.col("text")), " ").alias("text"))
    windows = F.transform(folds.fixed_windows(words(F.col("text")), size, overlap), lambda w: F.array_join(w, " "))
    made = clean.select("doc_id", F.posexplode(windows).alias("chunk", "text"))
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text", keywords(F.col("text")).alias("keywords"))


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    size: int = 64,
    overlap: int = 16,
    tasks: int | None = None,
    schema: str = DOCUMENT_SCHEMA,
) -> StreamingQuery:
    """Chunk documents that arrive as parquet under ``source`` and append them to ``target``, each exactly once.

    ``schema`` names the documents' columns, with an id of any type.  ``tasks`` deals the rows of a batch out, for sources that deliver few files with many documents.
    """
    docs = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(source)
    )
    dealt = docs.repartition(tasks) if tasks else docs
    return (
        window_chunks(dealt, size, overlap)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def dedupe_stream(log: DataFrame, ttl_seconds: int, key: str = "key", ts: str = "ts", groups: int = DEDUPE_GROUPS) -> DataFrame:
    """(key, ts) of the rows that find no live entry: the first of a key, and each that is more than ``ttl_seconds``
    later than the last one kept.

    Rows of a batch are taken in order of time, so the result does not depend on how rows in order fall into batches.
    Keys are dealt to ``groups`` by hash, so that a call works through many of them.  The state of a group is the time of each
    key's last kept row; a time goes with the first call after the watermark has passed its time to live, and the state once
    all have.
    """
    live = ttl_seconds * 1_000_000

    def walk(name, frames, state: GroupState):
        last, kept = dict(zip(*state.get)) if state.exists else {}, []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            keys, times = rows["key"].to_numpy(object), rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
            order = np.argsort(times, kind="stable")
            for own, at in zip(keys[order], times[order].tolist()):
                before = last.get(own)
                if before is None or at - before > live:
                    kept.append((own, at))
                    last[own] = at
        passed = state.getCurrentWatermarkMs()
        last = {own: at for own, at in last.items() if (at + live) // 1000 >= passed}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp((max(last.values()) + live) // 1000 + 1)
        else:
            state.remove()
        if kept:
            keys, times = zip(*kept)
            yield pd.DataFrame({"key": keys, "ts": np.array(times).astype("datetime64[us]")})

    rows = log.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).where("ts is not null")
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(groups)))
    each = dealt.withWatermark("ts", f"{ttl_seconds} seconds").groupBy("dealt")
    timeout = GroupStateTimeout.EventTimeTimeout
    return each.applyInPandasWithState(walk, "key string, ts timestamp", "keys array<string>, times array<long>", "append", timeout)


def conversation_stream(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running message count, newest time and system flag per conversation and day, late data bounded."""
    return (
        messages.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "conv_id")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.max("ts").alias("newest"),
            F.max(F.col("role") == "system").alias("has_system"),
        )
        .select("conv_id", F.col("window.start").alias("day"), "messages", "newest", "has_system")
    )


def upsert_batches(updates: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of changed rows under its number; readers keep the newest row per key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return (
        updates.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
