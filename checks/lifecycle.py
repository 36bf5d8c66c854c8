"""Row state of chunks, documents and per-user configurations."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave.operators import store as L
from docweave.sources import tables
from docweave.sources.readers import load

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)

NOW = "2024-02-01 12:00:00"


# Times come from the event of the same number; ids to change come from the labels and the benchmark items.
def chunks(spark, d):
    times = load(spark, d, "events").select(F.col("event_id").alias("chunk_id"), F.col("ts").alias("create_time"))
    held = tables.chunks(spark, d).join(times, "chunk_id", "left")
    never = F.lit(None).cast("timestamp_ntz")
    return held.withColumns(
        {
            "updated_at": F.col("create_time"),
            "delete_time": F.when(F.col("is_deleted"), F.col("create_time")).otherwise(never),
        }
    )


def docs(spark, d):
    state = tables.documents(spark, d)
    size = F.length("kb_id") + F.col("document_id")
    return state.withColumns(
        {
            "is_chunked": size % 2 == 0,
            "is_embedding_done": size % 3 == 0,
            "is_deleted": ~F.col("status"),
            "description": F.when(size % 4 > 0, F.concat(F.lit("about "), "name", F.lit(" in "), "kb_id")),
            "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
        }
    )


def labelled_ids(spark, d):
    return load(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))


def asked_documents(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))


CHUNKS = f"""{Q.CHUNKS},
store as (select c.*, e.ts as create_time, e.ts as updated_at,
          case when is_deleted then e.ts end as delete_time
          from chunks c left join events e on e.event_id = c.chunk_id)"""
DOCS = f"""{Q.DOCS},
state as (select *, (length(kb_id) + document_id) % 2 = 0 as is_chunked, (length(kb_id) + document_id) % 3 = 0 as is_embedding_done,
          not status as is_deleted, case when (length(kb_id) + document_id) % 4 > 0 then 'about ' || name || ' in ' || kb_id end as description,
          timestamp '2024-01-01 00:00:00' as updated_at from docs)"""
IN_LABELS = "chunk_id in (select doc_id from labels)"
IN_BENCH = "document_id in (select item_id from benchmark)"
STAMP = f"timestamp '{NOW}'"


def text(df, *cols):
    """Times as text, so that both sides print them alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in cols})


def ts(col):
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') as {col}"


def new_chunks(spark, d):
    return load(spark, d, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("chunk_id"),
        F.col("item_id").alias("document_id"),
        F.col("text").alias("chunk_text"),
        F.lit(False).alias("is_deleted"),
    )


@check(
    "l1_insert_chunks",
    f"""with {CHUNKS} select chunk_id, document_id, chunk_text, is_deleted, embedding is null as pending from store
        union all select item_id + 1000000000, item_id, text, false, true from benchmark""",
)
def _(spark, d):
    out, _ = L.insert_chunks(chunks(spark, d), docs(spark, d), new_chunks(spark, d))
    return out.select("chunk_id", "document_id", "chunk_text", "is_deleted", F.col("embedding").isNull().alias("pending"))


@check("l1_mark_chunked", f"with {DOCS} select document_id, is_chunked or {IN_BENCH} as is_chunked from state")
def _(spark, d):
    _, out = L.insert_chunks(chunks(spark, d), docs(spark, d), new_chunks(spark, d))
    return out.select("document_id", "is_chunked")


@check(
    "l2_update_text",
    f"""with {CHUNKS}, u as (select s.*, l.doc_id is not null and not is_deleted as hit, 'new ' || l.quality as t
          from store s left join labels l on l.doc_id = chunk_id)
    select chunk_id, case when hit then t else chunk_text end as chunk_text, {ts('updated_at')} from
      (select * replace (case when hit then {STAMP} else updated_at end as updated_at) from u)""",
)
def _(spark, d):
    changes = load(spark, d, "labels").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("new "), F.col("quality").cast("string")).alias("new_text")
    )
    return text(L.update_text(chunks(spark, d), changes, NOW).select("chunk_id", "chunk_text", "updated_at"), "updated_at")


@check(
    "l3_soft_delete",
    f"""with {CHUNKS} select chunk_id, is_deleted or {IN_LABELS} as is_deleted,
        strftime(case when {IN_LABELS} and not is_deleted then {STAMP} else delete_time end, '%Y-%m-%d %H:%M:%S.%f') as delete_time from store""",
)
def _(spark, d):
    out = L.soft_delete(chunks(spark, d), labelled_ids(spark, d), NOW)
    return text(out.select("chunk_id", "is_deleted", "delete_time"), "delete_time")


@check(
    "l4_restore",
    f"""with {CHUNKS} select chunk_id, is_deleted and not {IN_LABELS} as is_deleted, {ts('delete_time')},
        strftime(case when {IN_LABELS} and is_deleted then {STAMP} else updated_at end, '%Y-%m-%d %H:%M:%S.%f') as updated_at from store""",
)
def _(spark, d):
    out = L.restore(chunks(spark, d), labelled_ids(spark, d), NOW)
    return text(out.select("chunk_id", "is_deleted", "delete_time", "updated_at"), "delete_time", "updated_at")


@check("l5_hard_delete", f"with {CHUNKS} select chunk_id, document_id from store where not {IN_LABELS}")
def _(spark, d):
    return L.hard_delete(chunks(spark, d), labelled_ids(spark, d)).select("chunk_id", "document_id")


@check("l6_list_chunks", f"with {CHUNKS} select chunk_id, chunk_text, is_deleted from store")
def _(spark, d):
    return L.list_chunks(chunks(spark, d)).select("chunk_id", "chunk_text", "is_deleted")


@check("l7_document_chunks", f"with {CHUNKS} select document_id, chunk_id, {ts('create_time')} from store")
def _(spark, d):
    out = L.document_chunks(chunks(spark, d)).select("document_id", "chunk_id", "create_time")
    return text(out, "create_time")


@check("l8_get_chunk", f"with {CHUNKS} select chunk_id, chunk_text from store where not is_deleted and {IN_LABELS}")
def _(spark, d):
    return L.get_chunk(chunks(spark, d), labelled_ids(spark, d)).select("chunk_id", "chunk_text")


@check("l9_reset_chunks", f"with {CHUNKS} select chunk_id, embedding is null or {IN_BENCH} as pending from store")
def _(spark, d):
    out, _ = L.reset_embeddings(chunks(spark, d), docs(spark, d), asked_documents(spark, d), NOW)
    return out.select("chunk_id", F.col("embedding").isNull().alias("pending"))


@check("l9_reset_documents", f"with {DOCS} select document_id, is_embedding_done and not {IN_BENCH} as is_embedding_done from state")
def _(spark, d):
    _, out = L.reset_embeddings(chunks(spark, d), docs(spark, d), asked_documents(spark, d), NOW)
    return out.select("document_id", "is_embedding_done")


@check("l10_delete_document_chunks", f"with {CHUNKS} select document_id, count(*) as deleted from store where {IN_BENCH} group by all")
def _(spark, d):
    return L.delete_document_chunks(chunks(spark, d), docs(spark, d), asked_documents(spark, d))[2]


@check(
    "l10_documents_after",
    f"""with {DOCS} select document_id, is_chunked and not {IN_BENCH} as is_chunked,
        is_embedding_done and not {IN_BENCH} as is_embedding_done from state""",
)
def _(spark, d):
    out = L.delete_document_chunks(chunks(spark, d), docs(spark, d), asked_documents(spark, d))[1]
    return out.select("document_id", "is_chunked", "is_embedding_done")


@check(
    "l11_all_embedded",
    f"""with {CHUNKS}, d as (select distinct vec_id as document_id from embeddings union select document_id from store)
    select d.document_id, coalesce(bool_and(case when s.chunk_id is not null then embedding is not null end), true) as all_embedded
    from d left join store s using (document_id) group by all""",
)
def _(spark, d):
    held = chunks(spark, d)
    known = load(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"))
    everyone = known.union(held.select("document_id")).distinct()
    return L.all_embedded(held, everyone)


@check(
    "l12_embedding_progress",
    f"""with {CHUNKS} select document_id, count(embedding) as embedded, count(*) as total,
        round(count(embedding) / count(*) * 100, 4) as percent from store group by all""",
)
def _(spark, d):
    return L.embedding_progress(chunks(spark, d)).withColumn("percent", F.round("percent", 4))


@check(
    "l13_mark_embedded",
    f"""with {CHUNKS}, {DOCS},
    a as (select document_id, bool_and(embedding is not null) as done from store group by all)
    select s.document_id, is_embedding_done or coalesce(done, true) as is_embedding_done from state s left join a using (document_id)""",
)
def _(spark, d):
    return L.mark_embedded(docs(spark, d), chunks(spark, d)).select("document_id", "is_embedding_done")


def user_configs(spark, d):
    """One stored configuration per user: the properties of the user's first event."""
    first = F.min_by(F.struct("props", "ts"), "event_id").alias("e")
    rows = load(spark, d, "events").filter("event_type <> 'view'").groupBy("user_id").agg(first)
    return rows.select("user_id", F.col("e.props").alias("config"), F.col("e.ts").alias("created_at"), F.col("e.ts").alias("updated_at"))


def new_configs(spark, d):
    return load(spark, d, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(
        F.concat(F.lit('{"turns": '), F.count(F.lit(1)).cast("string"), F.lit("}")).alias("config")
    )


CONFIGS = """configs as (select user_id, arg_min(props, event_id) as config, arg_min(ts, event_id) as created_at
  from events where event_type <> 'view' group by all),
fresh as (select conv_id as user_id, '{"turns": ' || count(*) || '}' as config from conversations group by all)"""


@check(
    "l14_upsert_config",
    f"""with {CONFIGS} select user_id, coalesce(f.config, c.config) as config,
        strftime(coalesce(created_at, {STAMP}), '%Y-%m-%d %H:%M:%S.%f') as created_at,
        strftime(case when f.config is not null then {STAMP} else created_at end, '%Y-%m-%d %H:%M:%S.%f') as updated_at
        from configs c full join fresh f using (user_id)""",
)
def _(spark, d):
    return text(L.upsert_config(user_configs(spark, d), new_configs(spark, d), NOW), "created_at", "updated_at")


@check(
    "l15_user_config",
    f"""with {CONFIGS}, u as (select c_custkey as user_id from customer)
    select user_id, coalesce(config, '{{}}') as config from u left join configs using (user_id)""",
)
def _(spark, d):
    users = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return L.user_config(users, user_configs(spark, d), "{}")


@check("l16_needs_description", f"with {DOCS} select document_id, description is null as needed, true as forced from state")
def _(spark, d):
    about = F.col("description")
    return docs(spark, d).select(
        "document_id", L.needs_description(about).alias("needed"), L.needs_description(about, force=True).alias("forced")
    )


@check(
    "l17_rollup_descriptions",
    f"""with {DOCS} select kb_id, substring(string_agg(description, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by document_id), 1, 20000) as text
        from state where not is_deleted and description is not null group by kb_id""",
)
def _(spark, d):
    return L.rollup_descriptions(docs(spark, d))


@check(
    "l18_set_descriptions",
    f"""with {DOCS} select document_id, coalesce(b.text, description) as description,
        strftime(case when b.text is not null then {STAMP} else updated_at end, '%Y-%m-%d %H:%M:%S.%f') as updated_at
        from state left join benchmark b on item_id = document_id""",
)
def _(spark, d):
    new = load(spark, d, "benchmark").select(F.col("item_id").alias("document_id"), F.col("text").alias("description"))
    out = L.set_descriptions(docs(spark, d), new, "document_id", NOW)
    return text(out.select("document_id", "description", "updated_at"), "updated_at")


# Changes as they come from a log: several to a chunk, not in order of seq, with deletes and restores.
CHANGE_LOG = """log as (select event_id % 1500 as chunk_id, (event_id * 7919) % 100003 as seq, event_id,
  case event_id % 7 when 0 then 'delete' when 1 then 'restore' when 2 then 'other' else 'update' end as op, case when event_id % 11 > 0 then props end as new_text from events)"""


def change_log(spark, d):
    kind = F.col("event_id") % 7
    op = F.when(kind == 0, "delete").when(kind == 1, "restore").when(kind == 2, "other").otherwise("update")
    return load(spark, d, "events").select(
        (F.col("event_id") % 1500).alias("chunk_id"), ((F.col("event_id") * 7919) % 100003).alias("seq"), "event_id", op.alias("op"),
        F.when(F.col("event_id") % 11 > 0, F.col("props")).alias("new_text"),
    )


@check(
    "l2_apply_changes",
    f"""with recursive {CHUNKS}, {CHANGE_LOG},
    known as (select chunk_id, seq, new_text, case op when 'delete' then 0 when 'restore' then 1 else 2 end as r from log where op <> 'other'),
    steps as (select *, row_number() over (partition by chunk_id order by seq, r, new_text nulls first) as i from known),
    walk as (
      select chunk_id, 0 as i, is_deleted as dead, chunk_text as t, false as changed, false as gone from store
      union all
      select w.chunk_id, s.i, case r when 0 then true when 1 then false else dead end,
             case when r = 2 and not dead and new_text is not null then new_text else t end,
             changed or (r = 2 and not dead and new_text is not null), gone or r = 0
      from walk w join steps s on s.chunk_id = w.chunk_id and s.i = w.i + 1),
    ends as (select * from walk qualify row_number() over (partition by chunk_id order by i desc) = 1)
    select s.chunk_id, t as chunk_text, dead as is_deleted, {ts('updated_at')}, {ts('delete_time')} from
      (select s.chunk_id, t, dead, case when changed then {STAMP} else updated_at end as updated_at, case when gone then {STAMP} else delete_time end as delete_time
       from store s join ends e on e.chunk_id = s.chunk_id) s""",
)
def _(spark, d):
    out = L.apply_changes(chunks(spark, d), change_log(spark, d), NOW)
    return text(out.select("chunk_id", "chunk_text", "is_deleted", "updated_at", "delete_time"), "updated_at", "delete_time")


@check(
    "l2_update_text_in_order",
    f"""with {CHUNKS}, {CHANGE_LOG},
    u as (select chunk_id, max_by(new_text, {{'s': seq, 't': new_text}}) as t from log where new_text is not null group by all)
    select s.chunk_id, case when t is not null and not is_deleted then t else chunk_text end as chunk_text from store s left join u on u.chunk_id = s.chunk_id""",
)
def _(spark, d):
    return L.update_text(chunks(spark, d), change_log(spark, d), NOW).select("chunk_id", "chunk_text")
