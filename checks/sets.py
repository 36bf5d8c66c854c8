"""Question-answer sets and query configurations."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave.functions import text as T
from docweave.operators import configs as G
from docweave.operators import datasets as D
from docweave.sources.readers import load, load_texts

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


# A record per user turn: the turn is the question, the next turn the answer, documents carry content by language.
def records(spark, d):
    turns = load(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("content"), "lang", "n_chars")

    def only(lang):
        return F.when(F.col("lang") == lang, F.col("content"))

    rows = turns.filter("role = 'user'").join(after, ["conv_id", "turn"], "left").join(docs, "conv_id")
    plain = F.col("turn") % 2 == 1
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("n"),
        F.when(F.col("lang") == "es", F.concat(F.lit("own_"), F.col("conv_id").cast("string"))).alias("id"),
        F.struct(
            F.when(F.col("lang") != "es", F.concat(F.lit("doc_"), F.col("conv_id").cast("string"))).alias("id"),
            F.when(F.col("lang") != "de", F.col("lang")).alias("kind"),
            F.col("n_chars").alias("word_count"),
            F.struct(only("fr").alias("text")).alias("summary"),
            only("en").alias("text"),
            only("de").alias("full_text"),
        ).alias("document"),
        F.when(~plain, F.struct(F.col("text"))).alias("question"),
        F.when(plain, F.col("text")).alias("question_plain"),
        F.when(~plain & F.col("reply").isNotNull(), F.array(F.struct(F.col("reply").alias("text")))).alias("answers"),
        F.when(plain, F.col("reply")).alias("answer_plain"),
    )


RECORDS = """records as materialized (
  select c.conv_id * 1000 + c.turn as n, c.conv_id, c.turn, c.text as question, a.text as answer, d.text as content, d.lang, d.n_chars,
         case when lang <> 'es' then 'doc_' || c.conv_id else 'unknown' end as doc, lang <> 'es' as has_id
  from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn = c.turn + 1 join documents d on d.doc_id = c.conv_id
  where c.role = 'user'),
keyed as (select *, case when has_id then 'doc_' || conv_id else 'own_' || conv_id end as source_document_id from records)"""


def keyed(spark, d):
    rows = D.qa_fields(records(spark, d))
    return rows.withColumn("source_document_id", D.document_key(F.col("document.id"), F.col("id"), F.col("n")))


@check(
    "d1_flatten_qa",
    f"""with {RECORDS}, first as (select doc, arg_min(case when lang in ('fr', 'en', 'de') then content else '' end, n) as content from records group by doc)
    select n, question, coalesce(answer, '') as ground_truth_answer, case when content <> '' then content end as context,
           md5(doc) as chunk_id, doc as source_document_id from (select records.* exclude content, first.content from records join first using (doc))""",
)
def _(spark, d):
    return D.flatten_qa(records(spark, d)).select(
        "n",
        "question",
        "ground_truth_answer",
        F.get("relevant_contexts", F.lit(0)).alias("context"),
        F.get("relevant_chunk_ids", F.lit(0)).alias("chunk_id"),
        "source_document_id",
    )


@check(
    "d2_first_documents",
    f"""with {RECORDS}, f as (select source_document_id from keyed group by all order by min(n) limit 5)
    select n, source_document_id from keyed where source_document_id in (select source_document_id from f)""",
)
def _(spark, d):
    return D.first_documents(keyed(spark, d), 5).select("n", "source_document_id")


@check(
    "d3_document_stats",
    f"""with {RECORDS} select source_document_id, count(*) as qa_count, case when any_value(lang) <> 'de' then any_value(lang) else 'unknown' end as kind,
        any_value(n_chars) as word_count from keyed group by source_document_id""",
)
def _(spark, d):
    return D.document_stats(keyed(spark, d))


@check(
    "d4_document_mapping",
    f"""with {RECORDS}, p as (select *, (row_number() over (partition by source_document_id order by n) - 1) // 2 as page from keyed)
    select source_document_id, page, string_agg(question, ' # ' order by n) as questions, string_agg(coalesce(answer, ''), ' # ' order by n) as answers,
           string_agg(n::varchar, ',' order by n) as original_indices from p group by all""",
)
def _(spark, d):
    return D.document_mapping(keyed(spark, d), page_size=2).select(
        "source_document_id",
        "page",
        F.array_join("questions", " # ").alias("questions"),
        F.array_join("answers", " # ").alias("answers"),
        F.array_join(F.col("original_indices").cast("array<string>"), ",").alias("original_indices"),
    )


@check(
    "d5_document_key",
    """select n_nationkey, case when n_regionkey = 0 then 'doc_' || n_name when n_regionkey = 1 then 'own_' || n_nationkey else 'item_' || n_nationkey end as key from nation""",
)
def _(spark, d):
    region = F.col("n_regionkey")
    doc = F.when(region == 0, F.concat(F.lit("doc_"), "n_name"))
    own = F.when(region == 1, F.concat(F.lit("own_"), F.col("n_nationkey").cast("string")))
    return load(spark, d, "nation").select("n_nationkey", D.document_key(doc, own, F.col("n_nationkey")).alias("key"))


@check(
    "d6_qa_fields",
    f"with {RECORDS} select n, question as question_text, coalesce(answer, '') as answers, case when lang = 'de' then 'unknown' else lang end as kind from records",
)
def _(spark, d):
    return D.qa_fields(records(spark, d)).select("n", "question_text", F.array_join("answer_texts", " | ").alias("answers"), "kind")


# A paper per document: five paragraphs to a section; a question per paragraph, the last one without an answer.
def papers(spark, d):
    paras = load_texts(spark, d, "documents").select("doc_id", "source", T.paragraphs(F.col("text")).alias("p"))
    rows = paras.filter(F.size("p") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / 5).cast("int"))
    first_word = lambda x: F.get(T.words(x), F.lit(0))
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Paper "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("abstract"),
        F.struct(
            F.transform(starts, lambda i: F.concat(F.lit("Section "), i.cast("string"))).alias("section_name"),
            F.transform(starts, lambda i: F.slice("p", i * 5 + 1, 5)).alias("paragraphs"),
        ).alias("full_text"),
        F.struct(
            F.transform("p", lambda x: F.concat(F.lit("What about "), first_word(x), F.lit("?"))).alias("question"),
            F.transform(
                F.slice("p", 1, F.size("p") - 1),
                lambda x, i: F.struct(
                    F.array(
                        F.struct(
                            F.when(i % 3 == 0, x).otherwise("").alias("free_form_answer"),
                            F.when(i % 3 == 1, F.array(first_word(x), F.lit("etc"))).otherwise(F.expr("cast(array() as array<string>)")).alias("extractive_spans"),
                            F.array(x).alias("evidence"),
                        )
                    ).alias("answer")
                ),
            ).alias("answers"),
        ).alias("qas"),
    )


PAPERS = f"""paras as (select doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '') as p from documents),
para_rows as (select doc_id, source, len(p) as n, unnest(range(len(p))) as i, unnest(p) as para from paras),
asked_rows as (select *, {Q.words('para')}[1] as w from para_rows)"""


@check(
    "d7_explode_paper_qa",
    f"""with {PAPERS} select 'What about ' || w || '?' as question, case i % 3 when 0 then para when 1 then w || ' etc' else '' end as ground_truth_answer,
        para as context, 'qasper_' || doc_id || '_' || i as chunk_id, doc_id::varchar as source_document_id from asked_rows where i < n - 1""",
)
def _(spark, d):
    return D.explode_paper_qa(papers(spark, d)).select(
        "question",
        "ground_truth_answer",
        F.get("relevant_contexts", F.lit(0)).alias("context"),
        F.get("relevant_chunk_ids", F.lit(0)).alias("chunk_id"),
        "source_document_id",
    )


@check(
    "d8_paper_qa_arrays",
    f"""with {PAPERS} select doc_id::varchar as source_document_id, string_agg('What about ' || w || '?', '|' order by i) as questions,
        count(*) - 1 as n_answers from asked_rows group by doc_id""",
)
def _(spark, d):
    return D.paper_qa_arrays(papers(spark, d)).select(
        "source_document_id", F.array_join("question", "|").alias("questions"), F.size("answers").cast("long").alias("n_answers")
    )


@check(
    "d9_paper_to_text",
    f"""with {PAPERS}, l as (select doc_id, source, i // 5 as s, i, para from para_rows),
    sections as (select doc_id, source, s, 'Section ' || s || chr(10) || string_agg(para, chr(10) order by i) as t from l group by doc_id, source, s)
    select doc_id as id, 'Paper ' || doc_id || chr(10) || 'Abstract' || chr(10) || source || chr(10) || 'Full Text' || chr(10) || string_agg(t, chr(10) order by s) as text
    from sections group by doc_id, source""",
)
def _(spark, d):
    return D.paper_to_text(papers(spark, d))


@check(
    "d10_parse_generated_qa",
    """with r as (select conv_id, turn, text, role from conversations where role <> 'system')
    select 'about ' || turn as question, case when role = 'user' then 'yes' else 'N/A' end as ground_truth_answer, text as context,
           (conv_id * 1000 + turn)::varchar as chunk_id, case when role = 'user' then conv_id::varchar else 'unknown_document' end as source_document_id
    from r
    union all select 'N/A', 'second', text, (conv_id * 1000 + turn)::varchar, conv_id::varchar from r where role = 'user'""",
)
def _(spark, d):
    user = F.col("role") == "user"
    rows = load(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"),
        F.when(user, F.col("conv_id")).alias("document_id"),
        F.col("text").alias("chunk_text"),
        F.when(
            user,
            F.concat(F.lit('[{"question": "about '), F.col("turn").cast("string"), F.lit('", "ground_truth_answer": "yes"}, {"ground_truth_answer": "second"}]')),
        )
        .when(F.col("role") == "system", F.lit('{"question": "not a list"}'))
        .otherwise(F.concat(F.lit(' [{"question": "about '), F.col("turn").cast("string"), F.lit('"}]')))
        .alias("reply"),
    )
    return D.parse_generated_qa(rows).select(
        "question",
        "ground_truth_answer",
        F.get("relevant_contexts", F.lit(0)).alias("context"),
        F.get("relevant_chunk_ids", F.lit(0)).alias("chunk_id"),
        "source_document_id",
    )


@check(
    "d11_append_dataset",
    "select conv_id as id, text as question, null::varchar as origin from conversations union all select item_id, text, 'benchmark' from benchmark",
)
def _(spark, d):
    old = load(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("question"))
    new = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("benchmark").alias("origin"))
    return D.append_dataset(old, new)


@check("d12_first_n", f"with {RECORDS} select n, question from records order by n limit 20")
def _(spark, d):
    return D.first_n(D.qa_fields(records(spark, d)), 20).select("n", F.col("question_text").alias("question"))


# --- configurations: an event is a configuration of its user's base ------------------------------------------


def configs(spark, d):
    kind = F.col("event_type")
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("kb_id"),
        F.when(kind != "view", kind == "purchase").alias("is_default"),
        F.when(kind == "error", "inactive").when(kind != "click", "active").alias("status"),
        ((kind == "signup") | (F.col("value") > 90)).alias("is_deleted"),
        F.col("ts").alias("create_time"),
        F.lit(None).cast("timestamp_ntz").alias("delete_time"),
        F.concat(F.lit("cfg "), F.col("value").cast("decimal(18,2)").cast("string")).alias("name_config"),
        F.col("props").alias("llm_config"),
    )


CONFIGS = """configs as (
  select event_id as id, user_id as kb_id, case when event_type <> 'view' then event_type = 'purchase' end as is_default,
    case when event_type = 'error' then 'inactive' when event_type <> 'click' then 'active' end as status,
    event_type = 'signup' or value > 90 as is_deleted, ts as create_time, 'cfg ' || value::decimal(18, 2) as name_config, props as llm_config
  from events),
live as (select * replace (coalesce(is_default, false) as is_default, coalesce(status, 'active') as status) from configs where not is_deleted),
defaults as (select kb_id, arg_max(id, {'t': create_time, 'i': id}) as default_id from live where is_default and status = 'active' group by kb_id)"""


def params(spark, d):
    """Request parameters of an event as texts."""
    kind = F.col("event_type")
    return load(spark, d, "events").select(
        "event_id",
        F.create_map(
            F.lit("max_chunks"),
            F.when(kind == "view", F.get_json_object("props", "$.k")).otherwise("many"),
            F.lit("temperature"),
            F.col("value").cast("decimal(18,2)").cast("string"),
            F.lit("use_reranker"),
            F.when(kind == "click", "True").when(kind == "error", "FALSE").otherwise("maybe"),
            F.lit("note"),
            F.lit("12"),
        ).alias("params"),
    )


@check(
    "g1_coerce_params",
    """select event_id, case when event_type = 'view' then json_extract_string(props, '$.k')::bigint end as max_chunks,
       case when value >= 0 then value::decimal(18, 2)::double end as temperature, case event_type when 'click' then true when 'error' then false end as use_reranker,
       concat_ws('|', case when event_type <> 'view' then 'max_chunks=many' end, 'note=12', case when value < 0 then 'temperature=' || value::decimal(18, 2) end,
         case when event_type not in ('click', 'error') then 'use_reranker=maybe' end) as rest from events""",
)
def _(spark, d):
    typed = params(spark, d).select("event_id", G.coerce_params(F.col("params")).alias("p"))
    entries = F.array_sort(F.transform(F.map_entries("p.rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return typed.select("event_id", "p.max_chunks", "p.temperature", "p.use_reranker", F.array_join(entries, "|").alias("rest"))


@check(
    "g2_enforce_one_default",
    f"""with {CONFIGS}, made as (select c.* from configs c join labels on doc_id = id where is_default),
    w as (select kb_id, arg_max(id, {{'t': create_time, 'i': id}}) as winner from made group by kb_id)
    select id, kb_id, case when winner is not null then id = winner else is_default end as is_default from configs left join w using (kb_id)""",
)
def _(spark, d):
    changed = load(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return G.enforce_one_default(configs(spark, d), changed).select("id", "kb_id", "is_default")


@check("g3_configs_of", f"with {CONFIGS} select id, kb_id, is_default, status from live")
def _(spark, d):
    return G.configs_of(configs(spark, d)).select("id", "kb_id", "is_default", "status")


@check("g4_default_config", f"with {CONFIGS} select kb_id, default_id from defaults")
def _(spark, d):
    return G.default_config(configs(spark, d))


@check(
    "g5_resolve_config",
    f"""with {CONFIGS}, r as (select c_custkey as request_id, c_custkey % 200 as kb_id, case when c_mktsegment = 'BUILDING' then c_custkey end as config_id from customer),
    n as (select kb_id, arg_max(id, {{'t': create_time, 'i': id}}) as newest from live group by kb_id)
    select request_id, coalesce(l.id, default_id, newest) as config_id from r left join live l on l.id = r.config_id
    left join defaults d on d.kb_id = r.kb_id left join n on n.kb_id = r.kb_id""",
)
def _(spark, d):
    requests = load(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"),
        (F.col("c_custkey") % 200).alias("kb_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey")).alias("config_id"),
    )
    return G.resolve_config(requests, configs(spark, d), any_config=True)


@check(
    "g6_update_config_in_order",
    f"""with {CONFIGS}, c as (select event_id % 700 as id, (event_id * 7919) % 100003 as seq, case when event_id % 3 > 0 then event_type end as a,
           case when event_id % 5 > 2 then props end as b from events),
    x as (select id, max_by(a, {{'s': seq, 'a': a, 'b': b}}) filter (a is not null) as a, max_by(b, {{'s': seq, 'a': a, 'b': b}}) filter (b is not null) as b from c group by all)
    select configs.id, coalesce(x.a, name_config) as name_config, coalesce(x.b, status) as status from configs left join x on x.id = configs.id""",
)
def _(spark, d):
    changes = load(spark, d, "events").select(
        (F.col("event_id") % 700).alias("id"), ((F.col("event_id") * 7919) % 100003).alias("seq"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("name_config"), F.when(F.col("event_id") % 5 > 2, F.col("props")).alias("status"),
    )
    return G.update_config(configs(spark, d), changes, ["name_config", "status"]).select("id", "name_config", "status")


@check(
    "g6_update_config",
    f"""with {CONFIGS} select id, coalesce(case when toxic = 0 then 'renamed' end, name_config) as name_config,
        coalesce(case when quality = 1 then 'inactive' end, status) as status from configs left join labels on doc_id = id""",
)
def _(spark, d):
    changes = load(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 0, "renamed").alias("name_config"),
        F.when(F.col("quality") == 1, "inactive").alias("status"),
    )
    return G.update_config(configs(spark, d), changes, ["name_config", "status"]).select("id", "name_config", "status")


@check(
    "g7_delete_config",
    f"""with {CONFIGS}, m as (select c.*, doc_id is not null as gone from configs c left join labels on doc_id = id),
    lost as (select distinct kb_id from m where gone and is_default),
    heirs as (select kb_id, arg_max(id, {{'t': create_time, 'i': id}}) as heir from m where not gone and not is_deleted and kb_id in (select kb_id from lost) group by kb_id)
    select id, is_deleted or gone as is_deleted, case when gone then '2024-02-01' end as deleted_on, is_default or coalesce(id = heir, false) as is_default
    from m left join heirs using (kb_id)""",
)
def _(spark, d):
    ids = load(spark, d, "labels").select(F.col("doc_id").alias("id"))
    out = G.delete_config(configs(spark, d), ids, "2024-02-01 12:00:00")
    return out.select("id", "is_deleted", F.date_format("delete_time", "yyyy-MM-dd").alias("deleted_on"), "is_default")


@check(
    "g8_parse_config",
    """select event_id, case when event_type not in ('error', 'signup') then json_extract_string(props, '$.k') end as k,
       case when event_type in ('error', 'signup') then 0 else 1 end::bigint as n from events""",
)
def _(spark, d):
    stored = F.when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).when(F.col("event_type") != "signup", F.col("props"))
    parsed = load(spark, d, "events").select("event_id", G.parse_config(stored).alias("c"))
    return parsed.select("event_id", F.try_element_at("c", F.lit("k")).alias("k"), F.size("c").cast("long").alias("n"))


@check(
    "g9_model_category",
    """with m as (select p_partkey, case p_partkey % 7 when 0 then 'GPT-4 ' when 1 then 'text-embedding-3 ' when 2 then 'Gemini ' when 3 then 'Command R '
         when 4 then 'embed-v3 ' when 5 then 'Vistral-7B ' else '' end || p_name as model from part)
    select p_partkey, case when contains(model, 'GPT') or contains(model, 'text-embedding') or contains(model, 'ada') then 'openai'
      when contains(model, 'Gemini') then 'google' when contains(model, 'Cohere') or contains(model, 'Command') or contains(model, 'embed-') then 'cohere'
      when contains(lower(model), 'vistral') then 'local' end as category from m""",
)
def _(spark, d):
    names = F.array(*[F.lit(n) for n in ("GPT-4 ", "text-embedding-3 ", "Gemini ", "Command R ", "embed-v3 ", "Vistral-7B ", "")])
    model = F.concat(F.get(names, (F.col("p_partkey") % 7).cast("int")), F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", G.model_category(model).alias("category"))
