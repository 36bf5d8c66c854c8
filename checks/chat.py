"""Prompts, conversations, memory and the query log."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from checks.retrieval import TOP
from docweave.functions import text as T
from docweave.functions.keywords import keywords
from docweave.operators import conversations as H
from docweave.operators import prompts as P
from docweave.operators import querylog as G
from docweave.plans import retrieve as plan
from docweave.sources import tables
from docweave.sources.readers import load

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)

NOW = "2024-01-30 12:00:00"


def turns(spark, d):
    return load(spark, d, "conversations")


# A memory per message: assistant texts are summaries, keywords are topics, paragraphs points, sentences questions.
def memories(spark, d):
    rows = turns(spark, d)
    none = F.expr("cast(array() as array<string>)")
    said = F.col("role") == "assistant"
    return rows.withColumn(
        "memory",
        F.struct(
            F.when(said, F.col("text")).otherwise("").alias("summary"),
            keywords(F.col("text")).alias("topics"),
            F.when(~said, T.paragraphs(F.col("text"))).otherwise(none).alias("key_points"),
            T.raw_sentences(F.col("text")).alias("last_questions"),
            F.struct(F.when(~said, F.col("role")).alias("current_focus")).alias("context"),
        ),
    )


NL = "chr(10)"
SPLIT = f"string_split(regexp_replace(text, '([.!?]){Q.WS_RE}+', '\\1' || {Q.SENTINEL}, 'g'), {Q.SENTINEL})"
PARAS = f"list_filter(list_transform(string_split(text, {NL}), lambda x: {Q.strip('x')}), lambda x: x <> '')"
MEMORIES = f"""{Q.keyword_rows('(select conv_id * 1000 + turn as msg, text from conversations)', 'msg', 'text')},
memories as (
  select conv_id, turn, case when role = 'assistant' then text else '' end as summary,
         replace(coalesce(keywords, ''), '|', ', ') as topics,
         case when role <> 'assistant' then {PARAS} else [] end as points, {SPLIT} as qs,
         case when role <> 'assistant' then role end as focus
  from conversations left join keyword_lists on msg = conv_id * 1000 + turn)"""


def bullets(items, head):
    return f"""case when len({items}) > 0 then '{head}' || {NL} ||
        array_to_string(list_transform({items}, lambda x: '- ' || x || {NL}), '') || {NL} else '' end"""


@check(
    "p3_memory_section",
    f"""with {MEMORIES} select conv_id, turn, '### LỊCH SỬ CUỘC HỘI THOẠI:' || {NL}
        || case when summary <> '' then 'Tóm tắt: ' || summary || {NL} || {NL} else '' end
        || case when topics <> '' then 'Chủ đề: ' || topics || {NL} || {NL} else '' end
        || {bullets('points', 'Các điểm chính đã đề cập:')} || {bullets('qs[-3:]', 'Các câu hỏi gần đây:')}
        || case when focus is not null then 'Trọng tâm hiện tại: ' || focus || {NL} || {NL} else '' end as section from memories""",
)
def _(spark, d):
    return memories(spark, d).select("conv_id", "turn", P.memory_section(F.col("memory")).alias("section"))


@check(
    "p4_kb_section",
    f"""select n_nationkey, case when n_nationkey % 5 = 0 then '' else '### THÔNG TIN CƠ SỞ KIẾN THỨC:' || {NL} || 'Tiêu đề: ' || n_name || {NL} || {NL}
        || case when r_name <> 'ASIA' then 'Mô tả: ' || r_name || {NL} || {NL} else '' end end as section
        from nation join region on r_regionkey = n_regionkey""",
)
def _(spark, d):
    rows = load(spark, d, "nation").join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    about = F.when(F.col("r_name") != "ASIA", F.col("r_name"))
    return rows.select("n_nationkey", P.kb_section(F.col("n_name"), about, F.col("n_nationkey") % 5 != 0).alias("section"))


def system_rows(spark, d):
    """System message of a conversation: its first system turn."""
    first = turns(spark, d).filter("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("content"))
    return first


def said_rows(spark, d):
    return turns(spark, d).filter("role <> 'system'").withColumnRenamed("text", "content")


def current_rows(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(F.concat(F.lit("next after "), F.max("turn").cast("string")).alias("content"))


MESSAGES = f"""system_rows as (select conv_id, arg_min(text, turn) as content from conversations where role = 'system' group by all),
recent as (select * from conversations where role <> 'system' qualify row_number() over (partition by conv_id order by turn desc) <= 4),
current_rows as (select conv_id, 'next after ' || max(turn) as content from conversations group by all),
messages as (
  select conv_id, 0 as section, 0 as spot, 'system' as role, content from system_rows
  union all select conv_id, 1, turn, role, text from recent
  union all select conv_id, 2, 0, 'user', content from current_rows)"""


def built(spark, d):
    recent = H.recent_messages(said_rows(spark, d), 4)
    return H.build_messages(system_rows(spark, d), recent, current_rows(spark, d))


@check(
    "p5_messages_to_prompt",
    f"""with {MESSAGES} select conv_id, string_agg(case role when 'system' then 'System' when 'user' then 'User' else 'Assistant' end
        || ': ' || content, {NL} || {NL} order by section, spot) as prompt from messages group by conv_id""",
)
def _(spark, d):
    return built(spark, d).select("conv_id", P.messages_to_prompt(F.col("messages")).alias("prompt"))


@check(
    "p6_merge_params",
    """select event_id, user_id::varchar as top_k, json_extract_string(props, '$.k') as k,
       case when event_type = 'view' then floor(value)::bigint::varchar else '1024' end as max_tokens, false as reserved,
       case when event_type in ('view', 'click') then 4 else 3 end + case when event_type = 'click' then 1 else 0 end - case when event_type = 'view' then 1 else 0 end as n
       from events""",
)
def _(spark, d):
    events = load(spark, d, "events")
    base = F.create_map(F.lit("max_tokens"), F.lit("1024"), F.lit("top_k"), F.col("user_id").cast("string"))
    request = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.when(F.col("event_type") == "view", F.create_map(F.lit("max_tokens"), F.col("value").cast("string")))
        .when(
            F.col("event_type") == "click",
            F.create_map(F.lit("conversation_memory"), F.lit("x"), F.lit("temperature"), F.lit("0.5"), F.lit("top_p"), F.lit("1")),
        )
        .otherwise(F.expr("cast(map() as map<string,string>)")),
    )
    merged = events.select("event_id", P.merge_params(base, request).alias("p"))
    return merged.select(
        "event_id",
        F.col("p")["top_k"].alias("top_k"),
        F.col("p")["k"].alias("k"),
        F.col("p")["max_tokens"].alias("max_tokens"),
        F.map_contains_key("p", "conversation_memory").alias("reserved"),
        F.size("p").alias("n"),
    )


@check(
    "p7_query_context",
    f"""with {MEMORIES} select conv_id, turn, 'Các câu hỏi trước đó:' || {NL}
        || array_to_string(list_transform(qs[-2:], lambda q: '- ' || q), {NL})
        || case when summary <> '' then {NL} || 'Tóm tắt hội thoại:' || {NL} || summary else '' end as context from memories""",
)
def _(spark, d):
    return memories(spark, d).select("conv_id", "turn", P.query_context(F.col("memory")).alias("context"))


@check(
    "p8_override",
    """select event_id, case when event_type = 'view' then event_type when event_type = 'click' then 'default' else 'default' end as instruction from events""",
)
def _(spark, d):
    custom = F.when(F.col("event_type") == "view", F.col("event_type")).when(F.col("event_type") == "click", F.lit("  "))
    return load(spark, d, "events").select("event_id", P.override(F.lit("default"), custom).alias("instruction"))


@check("h1_recent_messages", "select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 10")
def _(spark, d):
    return H.recent_messages(turns(spark, d), 10)


def timed(spark, d):
    """The event log as messages: a user is a conversation, errors are system messages."""
    role = F.when(F.col("event_type") == "error", "system").when(F.col("event_type") == "click", "assistant").otherwise("user")
    return load(spark, d, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("message_id"), "ts", role.alias("role"), F.col("props").alias("content")
    )


TIMED = f"""timed as (select user_id as conv_id, event_id as message_id, ts,
  case event_type when 'error' then 'system' when 'click' then 'assistant' else 'user' end as role, props as content from events),
history as (select * from timed where role <> 'system' and ts > timestamp '{NOW}' - interval 24 hour
            qualify row_number() over (partition by conv_id order by ts desc, message_id desc) <= 10)"""


def recent_timed(spark, d):
    return H.history(timed(spark, d).filter("role <> 'system'"), NOW)


@check("h2_history", f"with {TIMED} select conv_id, message_id, role, content from history")
def _(spark, d):
    return recent_timed(spark, d).select("conv_id", "message_id", "role", "content")


@check(
    "h3_conversation_stats",
    f"""with {TIMED}, s as (select distinct conv_id from timed where role = 'system'),
    h as (select conv_id, count(*) as n, min(ts) as a, max(ts) as b from history group by all)
    select conv_id, coalesce(n, 0) as history_count, s.conv_id is not null as has_system,
           strftime(a, '%Y-%m-%d %H:%M:%S.%f') as oldest, strftime(b, '%Y-%m-%d %H:%M:%S.%f') as newest
    from h full join s using (conv_id)""",
)
def _(spark, d):
    out = H.conversation_stats(recent_timed(spark, d), timed(spark, d).filter("role = 'system'"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("oldest", "newest")})


@check(
    "h4_active_conversations",
    f"""with {TIMED} select conv_id, message_id from timed where conv_id in
        (select conv_id from timed group by conv_id having max(ts) >= timestamp '{NOW}' - interval 24 hour)""",
)
def _(spark, d):
    return H.active_conversations(timed(spark, d), NOW).select("conv_id", "message_id")


@check(
    "h5_build_messages",
    f"""with {MESSAGES} select conv_id, row_number() over (partition by conv_id order by section, spot) - 1 as place, role, content from messages""",
)
def _(spark, d):
    rows = built(spark, d).select("conv_id", F.posexplode("messages").alias("place", "m"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content")


@check(
    "h6_has_history",
    f"""with {TIMED} select c_custkey as conv_id, c_custkey in (select conv_id from history) or c_custkey in
        (select conv_id from timed where role = 'system') as has_history from customer""",
)
def _(spark, d):
    everyone = load(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"))
    return H.has_history(everyone, recent_timed(spark, d), timed(spark, d).filter("role = 'system'"))


def stored_memories(spark, d):
    """Memories as JSON, one per message, some with keys missing."""
    rows = turns(spark, d).withColumn("conv_id", F.col("conv_id") * 1000 + F.col("turn"))
    user = F.col("role") == "user"
    body = F.struct(
        F.when(user, F.col("text")).alias("summary"),
        F.when(user, T.raw_sentences(F.col("text"))).alias("last_questions"),
        F.when(user, F.struct(F.col("turn").alias("message_count"))).alias("metadata"),
    )
    return rows.select("conv_id", "text", H.parse_memory(F.to_json(body)).alias("memory"))


STORED = f"""stored as (select conv_id * 1000 + turn as conv_id, text, role = 'user' as u, turn,
  case when role = 'user' then {SPLIT} else [] end as qs from conversations)"""


@check(
    "h7_update_memory",
    f"""with {STORED} select conv_id, case when u then text else '' end || ' User hỏi về: ' || substring(text, 1, 50) || '...' as summary,
        array_to_string(list_append(qs, text)[-5:], '|') as questions, case when u then turn else 0 end + 2 as message_count,
        '{NOW}' as last_updated from stored""",
)
def _(spark, d):
    rows = stored_memories(spark, d)
    asked = rows.select("conv_id", F.col("text").alias("question"))
    out = H.update_memory(rows.select("conv_id", "memory"), asked, F.lit(NOW))
    return out.select(
        "conv_id",
        F.col("memory.summary").alias("summary"),
        F.array_join("memory.last_questions", "|").alias("questions"),
        F.col("memory.metadata.message_count").alias("message_count"),
        F.col("memory.metadata.last_updated").alias("last_updated"),
    )


@check(
    "h8_validate_memory",
    f"""with {STORED} select conv_id, case when u then text else '' end as summary, len(qs) as n_questions, 0::bigint as n_topics,
        case when u then turn else 0 end as message_count, '{NOW}' as last_updated from stored""",
)
def _(spark, d):
    out = stored_memories(spark, d).withColumn("m", H.validate_memory(F.col("memory"), F.lit(NOW)))
    return out.select(
        "conv_id",
        F.col("m.summary").alias("summary"),
        F.size("m.last_questions").cast("long").alias("n_questions"),
        F.size("m.topics").cast("long").alias("n_topics"),
        F.col("m.metadata.message_count").alias("message_count"),
        F.col("m.metadata.last_updated").alias("last_updated"),
    )


@check(
    "h9_extract_json",
    """select event_id, case when event_type <> 'error' then props end as body from events""",
)
def _(spark, d):
    reply = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone")))
        .when(F.col("event_type") == "error", F.concat(F.lit("no json: "), "props"))
        .otherwise(F.concat(F.lit("```"), "props", F.lit("```")))
    )
    return load(spark, d, "events").select("event_id", H.extract_json(reply).alias("body"))


# --- query log: an event is a request; its type and first property make the query --------------------------


def log(spark, d):
    events = load(spark, d, "events")
    query = F.concat(F.lit("  "), F.upper("event_type"), F.lit(' "'), F.get_json_object("props", "$.k"), F.lit('" ?'))
    return events.select(
        F.col("event_id").alias("query_id"),
        query.alias("query_text"),
        (F.col("user_id") % 7).cast("string").alias("kb_id"),
        F.col("event_type").isin("click", "view").alias("hit"),
    ).withColumn("key", G.query_key(F.col("query_text"), F.col("kb_id"), F.lit("default")))


LOG = """log as (select event_id as query_id, event_type, (user_id % 7)::varchar as kb_id, json_extract_string(props, '$.k') as k,
  event_type in ('click', 'view') as hit,
  md5('{"config_id": "default", "knowledge_base_id": "' || (user_id % 7) || '", "query": "' || lower(event_type) || ' \\"' ||
      json_extract_string(props, '$.k') || '\\" ?"}') as key from events)"""


@check("q1_query_key", f"with {LOG} select query_id, key from log")
def _(spark, d):
    return log(spark, d).select("query_id", "key")




@check(
    "q2_rerank_key",
    f"""with ids as (select doc_id // 4 as document_id, source, list_sort(list(doc_id::varchar)) as ids from documents group by all),
    b as (select item_id, lower(text) as q, ids, source from benchmark join ids on document_id = item_id // 4)
    select item_id, source, md5('{{"chunk_ids": [' || array_to_string(list_transform(ids, lambda i: '"' || i || '"'), ', ') || '], "model": "m1", "query": '
        || to_json({Q.strip('q')})::varchar || '}}') as key from b""",
)
def _(spark, d):
    docs = load(spark, d, "documents")
    ids = docs.groupBy(F.floor(F.col("doc_id") / 4).alias("document_id"), "source").agg(
        F.collect_list(F.col("doc_id").cast("string")).alias("ids")
    )
    items = load(spark, d, "benchmark").withColumn("document_id", F.floor(F.col("item_id") / 4))
    return items.join(ids, "document_id").select(
        "item_id", "source", G.rerank_key(F.col("text"), F.col("ids"), "m1").alias("key")
    )


@check(
    "q3_hit_stats",
    f"""with {LOG} select kb_id, count(*) filter (hit) as hit_count, count(*) filter (not hit) as miss_count,
        round(count(*) filter (hit) / count(*) * 100, 2) as hit_rate from log group by kb_id""",
)
def _(spark, d):
    return G.hit_stats(log(spark, d), ["kb_id"])


@check(
    "q4_log_summary",
    f"""with {LOG}, r as (select conv_id || ':' || turn as key, role = 'user' as hit from conversations)
    select (select count(*) from log) as total_query_requests, (select count(*) from r) as total_rerank_requests,
      (select count(*) from log where hit) as query_saves, (select count(*) from r where hit) as rerank_saves,
      (select count(distinct key) from log) + (select count(distinct key) from r) as total_entries,
      round((select count(*) from log where hit) / (select count(*) from log) * 100, 2) as query_hit_rate,
      round((select count(*) from r where hit) / (select count(*) from r) * 100, 2) as rerank_hit_rate""",
)
def _(spark, d):
    reranks = turns(spark, d).select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("key"),
        (F.col("role") == "user").alias("hit"),
    )
    return G.log_summary(log(spark, d), reranks)


@check(
    "q5_retrieve_once",
    f"""with {LOG}, first as (select key, min(query_id) as lead from log group by key)
    select query_id, lead * 2 as answer from log join first using (key)""",
)
def _(spark, d):
    requests = log(spark, d).select("query_id", "query_text", "kb_id", "key")

    def run(lead):
        return lead.select("query_id", (F.col("query_id") * 2).alias("answer"))

    return G.retrieve_once(requests, run, F.col("key"))


@check("q5_retrieve_once_search", f"with {TOP} select query_id, chunk_id, round(similarity + 1e-12, 6) as similarity, rank from hits")
def _(spark, d):
    queries = tables.queries(spark, d)
    held = tables.chunks(spark, d).withColumn("keywords", keywords(F.col("chunk_text")))
    documents = tables.documents(spark, d)
    key = G.query_key(F.col("query_text"), F.col("kb_id"), F.lit("default"))
    found = G.retrieve_once(queries, lambda lead: plan.retrieve(lead, held, documents), key)
    return found.withColumns({"similarity": F.round(F.col("similarity") + 1e-12, 6), "rank": F.col("rank").cast("long")})
