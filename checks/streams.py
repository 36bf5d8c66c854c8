"""Streams run to the end of what is there, and hooks for callers' own functions."""

import numpy as np
from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave import hooks
from docweave.functions import folds
from docweave.functions.keywords import REPLY_HEADER
from docweave.functions.vectors import as_double
from docweave.operators.querylog import QUERY_TTL_SECONDS
from docweave.session import scratch_path
from docweave.sources.readers import load
from docweave.streaming import ingest as W

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


def stored(d, name):
    """A table as a pattern: streams read folders or patterns, and a table here may be a single file."""
    return f"{d}/{name}.parque[t]"


@check(
    "w1_ingest_stream",
    f"""with {Q.SENTENCES}, whole as (select doc_id, string_agg(sentence, ' ' order by pos) as text from sentences group by all),
    w as (select doc_id, {Q.words('text')} as ws from whole),
    n as (select doc_id, ws, case when len(ws) <= 64 then 1 else ceil((len(ws) - 64) / 48.0)::bigint + 1 end as k from w where len(ws) > 0),
    i as (select doc_id, ws, unnest(range(k)) as chunk from n),
    made as materialized (select doc_id, chunk, doc_id * 1000000 + chunk as chunk_key, array_to_string(ws[chunk * 48 + 1 : chunk * 48 + 64], ' ') as text from i),
    {Q.keyword_rows('made', 'chunk_key', 'text')}
    select doc_id, chunk, text, coalesce(keywords, '') as keywords from made left join keyword_lists using (chunk_key)""",
)
def _(spark, d):
    target = scratch_path(spark, "ingested")
    tasks = spark.sparkContext.defaultParallelism
    W.ingest_stream(spark, stored(d, "documents"), target, scratch_path(spark, "offsets"), tasks=tasks).awaitTermination()
    return spark.read.parquet(target).withColumn("keywords", F.array_join("keywords", "|"))


@check("w1_ingest_text_ids", f"select * replace (md5(doc_id::varchar) as doc_id) from ({ORACLES['w1_ingest_stream']})")
def _(spark, d):
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    load(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("doc_id"), "text").write.parquet(source)
    tasks = spark.sparkContext.defaultParallelism
    W.ingest_stream(spark, source, target, scratch_path(spark, "offsets"), tasks=tasks, schema="doc_id string, text string").awaitTermination()
    return spark.read.parquet(target).withColumn("keywords", F.array_join("keywords", "|"))


def event_stream(spark, d):
    rows = spark.readStream.schema(load(spark, d, "events").schema).parquet(stored(d, "events"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@check(
    "w2_dedupe_stream",
    """with recursive e as (select user_id || ':' || event_type as key, ts from events where ts is not null),
    kept(key, ts) as (select key, min(ts) from e group by key
      union all select e.key, min(e.ts) from kept k join e on e.key = k.key and e.ts > k.ts + interval 1800 second group by e.key)
    select key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from kept""",
)
def _(spark, d):
    log = event_stream(spark, d).select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), "ts")
    target = scratch_path(spark, "deduped")
    once = W.dedupe_stream(log, QUERY_TTL_SECONDS)
    (
        once.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(target).select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@check(
    "w3_conversation_stream",
    """select user_id as conv_id, strftime(ts, '%Y-%m-%d') as day, count(*) as messages, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as newest,
       bool_or(event_type = 'error') as has_system from events group by user_id, strftime(ts, '%Y-%m-%d')""",
)
def _(spark, d):
    messages = event_stream(spark, d).select(
        F.col("user_id").alias("conv_id"), "ts", F.when(F.col("event_type") == "error", "system").otherwise("user").alias("role")
    )
    target = scratch_path(spark, "counts")
    W.upsert_batches(W.conversation_stream(messages), target, scratch_path(spark, "offsets")).awaitTermination()
    written = spark.read.parquet(target)
    latest = written.groupBy("conv_id", "day").agg(F.max_by(F.struct("messages", "newest", "has_system"), "batch").alias("r"))
    return latest.select(
        "conv_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "r.messages",
        F.date_format("r.newest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest"),
        "r.has_system",
    )


@check(
    "u1_length_function",
    f"select doc_id, len({Q.words('text')}) as n_words, case when text is not null then true end as whole from documents",
)
def _(spark, d):
    """Splitting by words instead of characters loses nothing."""
    pieces = folds.split_recursive(F.col("text"), 40, length=hooks.word_length)["piece"]
    rows = load(spark, d, "documents").withColumn("pieces", pieces)
    words = hooks.word_length(F.col("text"))
    return rows.select(
        "doc_id", words.cast("long").alias("n_words"), (F.array_join("pieces", "") == F.col("text")).alias("whole")
    )


@check("u2_embed", "select conv_id, turn, length(text)::double as a, (length(text) - length(replace(text, ' ', '')))::double as b from conversations")
def _(spark, d):
    def make():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts])

    rows = load(spark, d, "conversations").select("conv_id", "turn", "text")
    return hooks.embed(rows, make).select("conv_id", "turn", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@check(
    "u3_keyword_method",
    f"""with {Q.keyword_rows("(select conv_id * 1000 + turn as msg, text from conversations)", 'msg', 'text')}
    select conv_id, turn, coalesce(keywords, '') as nlp, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> ''), '|') as llm
    from conversations left join keyword_lists on msg = conv_id * 1000 + turn""",
)
def _(spark, d):
    text = F.col("text")
    reply = F.concat(F.lit(REPLY_HEADER + "\n"), text)
    return load(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(hooks.keyword_method("unknown")(text), "|").alias("nlp"),
        F.array_join(hooks.keyword_method("llm", reply)(text), "|").alias("llm"),
    )


@check(
    "u4_score_pairs",
    """select item_id, doc_id, round(1.0 / (1 + abs(length(b.text) - length(d.text))), 6)::double as score
       from benchmark b join documents d on d.doc_id // 4 = b.item_id // 4""",
)
def _(spark, d):
    def make():
        return lambda qs, ts: np.array([1.0 / (1 + abs(len(q) - len(t))) for q, t in zip(qs, ts)])

    items = load(spark, d, "benchmark").select("item_id", F.col("text").alias("query_text"), F.floor(F.col("item_id") / 4).alias("g"))
    texts = load(spark, d, "documents").select("doc_id", F.col("text").alias("chunk_text"), F.floor(F.col("doc_id") / 4).alias("g"))
    scored = hooks.score_pairs(items.join(texts, "g"), make)
    return scored.select("item_id", "doc_id", F.round("rerank_score", 6).alias("score"))


@check(
    "u5_resize_method",
    "select vec_id, label, len(embedding) + 16 as size, round(embedding[1]::double, 6) as first, 0.0::double as last from embeddings",
)
def _(spark, d):
    rows = load(spark, d, "embeddings").withColumn("v", hooks.resize_method("pad")(as_double(F.col("embedding")), 80))
    return rows.select(
        "vec_id", "label", F.size("v").cast("long").alias("size"), F.round(F.col("v")[0], 6).alias("first"), F.element_at("v", -1).alias("last")
    )


@check(
    "u6_outlier_method",
    f"""with {Q.SENTENCES}, l as (select doc_id, pos, length(sentence) % 4 - 1 as label from sentences)
    select doc_id, pos, case when label <> -1 then label else max(label) over (partition by doc_id) + 1 end as label from l""",
)
def _(spark, d):
    from checks.chunking import mixed

    return hooks.outlier_method("singleton")(mixed(spark, d)).select("doc_id", "pos", "label")
