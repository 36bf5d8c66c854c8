"""Retrieval and contexts."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave.functions.keywords import keywords
from docweave.functions.text import words
from docweave.operators import prompts as P
from docweave.operators import retrieval as R
from docweave.plans import retrieve as plan
from docweave.sources import tables
from docweave.sources.readers import load

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


def store(spark, d):
    held = tables.chunks(spark, d).withColumn("keywords", keywords(F.col("chunk_text")))
    return tables.queries(spark, d), held, tables.documents(spark, d)


HELD = f"""{Q.STORE},
held as materialized (select c.*, docs.kb_id, docs.name from chunks c join docs using (document_id) where status and not is_deleted)"""

SEMANTIC = f"""{HELD},
scored as (
  select query_id, chunk_id, round(1 - list_cosine_similarity(vector, embedding), 9) as distance,
         round(list_distance(vector, embedding), 6) as l2
  from asked a join held h on a.kb_id = h.kb_id),
semantic as (
  select query_id, chunk_id, round(1 - coalesce(distance, 1), 9) as similarity,
         row_number() over (partition by query_id order by distance nulls last, l2 nulls last, chunk_id) as rank
  from scored qualify rank <= 20)"""

KEYWORD = f"""{Q.keyword_rows('documents', 'doc_id', 'text')},
asked_words as (select query_id, kb_id, unnest(keywords) as w from asked),
keyword as (
  select query_id, chunk_id, 0.0::double as similarity, row_number() over (partition by query_id order by chunk_id) as rank
  from (select distinct a.query_id, h.chunk_id from asked_words a join held h on h.kb_id = a.kb_id
        join keyword_words k on k.doc_id = h.chunk_id and k.w = a.w) qualify rank <= 3)"""

HYBRID = f"""{SEMANTIC}, {KEYWORD},
hybrid as (
  select query_id, chunk_id, similarity, row_number() over (partition by query_id order by list, rank) as place from (
    select *, 0 as list from semantic union all
    select *, 1 as list from keyword k where not exists (select 1 from semantic s where s.query_id = k.query_id and s.chunk_id = k.chunk_id)))"""

TOP = f"""{HYBRID},
hits as (select query_id, chunk_id, similarity, row_number() over (partition by query_id order by similarity desc, place) as rank
         from hybrid qualify rank <= 10)"""

# The nudge makes values that end in a 5 at the cut round the same way in both engines.
COLS = "query_id, chunk_id, round(similarity + 1e-12, 6) as similarity"


def shown(df):
    out = df.withColumn("similarity", F.round(F.col("similarity") + 1e-12, 6))
    for c in ("rank", "place", "n", "threads", "batch"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("long"))
    return out


@check("r1_semantic_search", f"with {SEMANTIC} select {COLS}, rank from semantic")
def _(spark, d):
    return shown(R.semantic_search(*store(spark, d), 20))


@check("r2_keyword_search", f"with {HELD}, {KEYWORD} select {COLS}, rank from keyword")
def _(spark, d):
    return shown(R.keyword_search(*store(spark, d), 3))


def found(spark, d):
    return plan.candidates(*store(spark, d))


@check("r3_hybrid", f"with {HYBRID} select {COLS}, place from hybrid")
def _(spark, d):
    return shown(found(spark, d))


@check("r4_top_chunks", f"with {TOP} select {COLS}, rank from hits")
def _(spark, d):
    return shown(R.top_chunks(found(spark, d), 10).drop("place"))


# Scores stand in for a cross-encoder's; some candidates have none.
SCORE = "case when (chunk_id * 31 + query_id * 17) % 11 <> 0 then ((chunk_id * 7919 + query_id * 104729) % 97) / 97.0::double end"


def with_score(df):
    mixed = (F.col("chunk_id") * 7919 + F.col("query_id") * 104729) % 97
    has = (F.col("chunk_id") * 31 + F.col("query_id") * 17) % 11 != 0
    return df.withColumn("rerank_score", F.when(has, mixed / F.lit(97.0)))


@check(
    "r5_rerank",
    f"""with {HYBRID}, s as (select *, {SCORE} as score from hybrid)
    select {COLS}, row_number() over (partition by query_id order by score desc nulls last, place) as rank
    from s qualify rank <= 10""",
)
def _(spark, d):
    return shown(R.rerank(with_score(found(spark, d)), 10).drop("place", "rerank_score"))


GREET = "(" + ", ".join(f"'{g}'" for g in R.GREETINGS) + ")"
PARTS = " or ".join(f"contains(q, '{g}')" for g in R.GREETING_PARTS)


@check(
    "r6_skip_rerank",
    f"""with c as (select conv_id, turn, unnest([text, string_split(text, ' ')[1]]) as query_text,
                  unnest(['message', 'first word']) as part, conv_id % 7 + 2 as n from conversations),
    l as (select *, {Q.strip('lower(query_text)')} as q from c)
    select conv_id, turn, part, n <= 3 or q in {GREET} or (length(q) <= 10 and ({PARTS})) or length({Q.strip('query_text')}) < 5 as skip from l""",
)
def _(spark, d):
    asked = F.create_map(F.lit("message"), F.col("text"), F.lit("first word"), F.split("text", " ")[0])
    turns = load(spark, d, "conversations")
    queries = turns.select("conv_id", "turn", F.explode(asked).alias("part", "query_text"), (F.col("conv_id") % 7 + 2).alias("n"))
    return R.skip_rerank(queries).select("conv_id", "turn", "part", "skip")


BALANCED = f"""{HYBRID},
counted as (select *, count(*) over (partition by query_id) as n,
            row_number() over (partition by query_id order by similarity desc, place) as by_sim from hybrid),
planned as (select *, case when n > 3 and n % 3 <> 0 and n % 2 <> 0 then 1 else 0 end as gone,
            case when n <= 3 then 1 when n % 3 = 0 then 3 when n % 2 = 0 then 2 when (n - 1) % 3 = 0 then 3 else 2 end as threads from counted),
balanced as (select query_id, chunk_id, similarity, case when gone > 0 then by_sim else place end as place, n - gone as n, threads
             from planned where by_sim <= n - gone)"""


@check("r7_balance_candidates", f"with {BALANCED} select {COLS}, place, n, threads::bigint as threads from balanced")
def _(spark, d):
    return shown(R.balance_candidates(found(spark, d)))


@check(
    "r8_score_batches",
    f"""with {HYBRID}, s as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id order by place) - 1 as i from hybrid)
    select {COLS}, place, i // (case when n <= 8 then n when n <= 16 then 8 else 16 end) as batch from s""",
)
def _(spark, d):
    return shown(R.score_batches(found(spark, d)))


BM25 = f"""terms as (select h.kb_id, h.chunk_id, {Q.words('lower(chunk_text)')} as ts from held h),
bases as (select kb_id, count(*) as n, avg(len(ts)) as avg_dl from terms group by kb_id),
tf as (select kb_id, chunk_id, dl, term, count(*) as tf from (select kb_id, chunk_id, len(ts) as dl, unnest(ts) as term from terms) group by all),
df as (select kb_id, term, count(*) as df from tf group by all),
asked_terms as (select distinct query_id, kb_id, unnest({Q.words('lower(query_text)')}) as term from asked),
bm25 as (
  select query_id, chunk_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) as similarity,
         row_number() over (partition by query_id order by round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) desc, chunk_id) as rank
  from asked_terms a join tf using (kb_id, term) join df using (kb_id, term) join bases using (kb_id)
  group by query_id, chunk_id qualify rank <= 20)"""


@check(
    "r9_fuse",
    f"""with {SEMANTIC}, {BM25},
    a as (select query_id, chunk_id, case when max(similarity) over w > min(similarity) over w then (similarity - min(similarity) over w) / (max(similarity) over w - min(similarity) over w) else 0 end as s
          from semantic window w as (partition by query_id)),
    b as (select query_id, chunk_id, case when max(similarity) over w > min(similarity) over w then (similarity - min(similarity) over w) / (max(similarity) over w - min(similarity) over w) else 0 end as s
          from bm25 window w as (partition by query_id))
    select query_id, chunk_id, round(coalesce(a.s, 0) * 0.7 + coalesce(b.s, 0) * 0.3, 6) as score
    from a full join b using (query_id, chunk_id)""",
)
def _(spark, d):
    s = store(spark, d)
    fused = R.fuse(R.semantic_search(*s, 20), R.bm25(*s, 20), 0.7)
    return fused.withColumn("score", F.round("score", 6))


@check("r10_bm25", f"with {HELD}, {BM25} select {COLS}, rank from bm25")
def _(spark, d):
    return shown(R.bm25(*store(spark, d), 20))


@check(
    "r11_naive_hybrid",
    f"""with {SEMANTIC}, {BM25}, u as (select query_id, chunk_id, 0 as list, rank from semantic union all select query_id, chunk_id, 1, rank from bm25),
    o as (select * from u qualify row_number() over (partition by query_id, chunk_id order by list, rank) = 1)
    select query_id, chunk_id, row_number() over (partition by query_id order by list, rank) as place from o""",
)
def _(spark, d):
    s = store(spark, d)
    made = R.naive_hybrid(R.semantic_search(*s, 20), R.bm25(*s, 20))
    return made.withColumn("place", F.col("place").cast("long"))


@check(
    "r12_coerce_limit",
    """with v as (select event_id, case event_id % 5 when 0 then props when 1 then value::decimal(18, 2)::varchar when 2 then ' ' || user_id || ' '
         when 3 then '-' || user_id else event_type end as raw from events)
    select event_id, case when regexp_full_match(trim(raw), '[+-]?[0-9]+') then trim(raw)::bigint else 10 end as max_chunks from v""",
)
def _(spark, d):
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.col("value").cast("decimal(18,2)").cast("string"))
        .when(kind == 2, F.concat(F.lit(" "), user, F.lit(" ")))
        .when(kind == 3, F.concat(F.lit("-"), user))
        .otherwise(F.col("event_type"))
    )
    return load(spark, d, "events").select("event_id", R.coerce_limit(raw).alias("max_chunks"))


@check("r13_retrieve", f"with {TOP} select {COLS}, rank from hits")
def _(spark, d):
    return shown(plan.retrieve(*store(spark, d)))


@check(
    "r13_retrieve_reranked",
    f"""with {HYBRID}, n as (select h.*, count(*) over (partition by query_id) as n, {Q.strip('lower(query_text)')} as q
         from hybrid h join asked using (query_id)),
    f as (select *, n <= 3 or q in {GREET} or (length(q) <= 10 and ({PARTS})) or length(q) < 5 as skip,
          row_number() over (partition by query_id order by similarity desc, place) as by_sim,
          case when n > 3 and n % 3 <> 0 and n % 2 <> 0 then 1 else 0 end as gone from n),
    k as (select query_id, chunk_id, similarity, case when skip then null else {SCORE} end as score,
          case when not skip and gone > 0 then by_sim else place end as place from f where skip or by_sim <= n - gone)
    select {COLS}, row_number() over (partition by query_id order by score desc nulls last, place) as rank from k qualify rank <= 10""",
)
def _(spark, d):
    queries, held, documents = store(spark, d)
    scores = with_score(plan.candidates(queries, held, documents)).select("query_id", "chunk_id", "rerank_score")
    return shown(plan.retrieve(queries, held, documents, scores=scores))


# Every query with its own settings: a limit as text, sometimes none, and whether to rerank.
RERANKED_MIXED = f"""{HYBRID}, settings as (
  select *, case query_id % 4 when 0 then '3' when 1 then ' 7 ' when 2 then 'many' end as max_chunks,
         case query_id % 3 when 0 then false when 1 then true end as use_reranker, {Q.strip('lower(query_text)')} as q from asked),
n as (select h.*, count(*) over (partition by query_id) as n, q, coalesce(use_reranker, true) as wants,
             case query_id % 4 when 0 then 3 when 1 then 7 else 10 end as cut from hybrid h join settings using (query_id)),
f as (select *, not wants or n <= 3 or q in {GREET} or (length(q) <= 10 and ({PARTS})) or length(q) < 5 as skip,
      row_number() over (partition by query_id order by similarity desc, place) as by_sim,
      case when n > 3 and n % 3 <> 0 and n % 2 <> 0 then 1 else 0 end as gone from n),
k as (select *, case when skip then null else {SCORE} end as score, case when not skip and gone > 0 then by_sim else place end as spot
      from f where skip or by_sim <= n - gone),
mixed as (select query_id, chunk_id, similarity, score as rerank_score,
                 row_number() over (partition by query_id order by case when wants then score else similarity end desc nulls last, spot) as rank
          from k qualify rank <= cut)"""


def mixed_settings(queries):
    limit = F.when(F.col("query_id") % 4 == 0, "3").when(F.col("query_id") % 4 == 1, " 7 ").when(F.col("query_id") % 4 == 2, "many")
    use = F.when(F.col("query_id") % 3 == 0, False).when(F.col("query_id") % 3 == 1, True)
    return queries.withColumn("max_chunks", limit).withColumn("use_reranker", use)


@check(
    "r13_result_rows",
    f"""with {RERANKED_MIXED} select query_id, chunk_id, round(similarity + 1e-12, 6) as similarity, round(rerank_score, 6) as rerank_score, rank,
      document_id, h.name as document_name, null::varchar as link, chunk_text from mixed join held h using (chunk_id)""",
)
def _(spark, d):
    queries, held, documents = store(spark, d)
    scores = with_score(plan.candidates(queries, held, documents)).select("query_id", "chunk_id", "rerank_score")
    hits = plan.retrieve_scored(mixed_settings(queries), held, documents, scores=scores)
    return shown(plan.result_rows(hits, held, documents)).withColumn("rerank_score", F.round("rerank_score", 6))


# Ids of another type; ties then fall to the lowest text.
def text_store(spark, d):
    queries, held, documents = store(spark, d)
    own = {c: F.md5(F.col(c).cast("string")) for c in ("query_id", "chunk_id", "document_id")}
    return tuple(df.withColumns({c: v for c, v in own.items() if c in df.columns}) for df in (queries, held, documents))


def text_ids(sql):
    """The store's tables under text ids."""
    return sql.replace(Q.STORE, f"""{Q.CHUNKS.replace('chunks as', 'long_chunks as')}, {Q.DOCS.replace('docs as', 'long_docs as')},
{Q.ASKED.replace('asked as', 'long_asked as').replace('join docs on docs.', 'join long_docs docs on docs.')},
chunks as (select * replace (md5(chunk_id::varchar) as chunk_id, md5(document_id::varchar) as document_id) from long_chunks),
docs as (select * replace (md5(document_id::varchar) as document_id) from long_docs),
asked as (select * replace (md5(query_id::varchar) as query_id) from long_asked)""").replace(
        Q.keyword_rows("documents", "doc_id", "text"), Q.keyword_rows("(select md5(doc_id::varchar) as doc_id, text from documents)", "doc_id", "text")
    )


@check("r1_search_text_ids", f"with {text_ids(SEMANTIC)} select {COLS}, rank from semantic")
def _(spark, d):
    return shown(R.semantic_search(*text_store(spark, d), 20))


@check("r10_bm25_text_ids", f"with {text_ids(HELD)}, {BM25} select {COLS}, rank from bm25")
def _(spark, d):
    return shown(R.bm25(*text_store(spark, d), 20))


@check("r13_retrieve_text_ids", f"with {text_ids(TOP)} select {COLS}, rank from hits")
def _(spark, d):
    return shown(plan.retrieve(*text_store(spark, d)))


@check(
    "r14_with_fallback",
    f"""with {HELD}, {KEYWORD}, c as (select query_id, count(*) as n from keyword group by all)
    select a.query_id, case when n is null then '{R.NO_ANSWER}' end as answer, coalesce(n, 0) as n_chunks
    from asked a left join c on c.query_id = a.query_id""",
)
def _(spark, d):
    queries, held, documents = store(spark, d)
    return R.with_fallback(queries, R.keyword_search(queries, held, documents, 3))


CONTEXTS = f"""{TOP},
contexts as (select query_id, string_agg('[Nguồn: ' || h.name || '] ' || chunk_text, chr(10) || chr(10) order by rank) as context
             from hits join held h using (chunk_id) group by query_id)"""


@check("p1_build_context", f"with {CONTEXTS} select query_id, context from contexts")
def _(spark, d):
    queries, held, documents = store(spark, d)
    return plan.contexts(plan.retrieve(queries, held, documents), held, documents)


@check(
    "p2_build_user",
    f"""with {CONTEXTS} select query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Q: ' || query_text || ' / ' || query_text
        || chr(10) || chr(10) || 'Answer in one paragraph.' as prompt from contexts join asked using (query_id)""",
)
def _(spark, d):
    queries, held, documents = store(spark, d)
    rows = plan.contexts(plan.retrieve(queries, held, documents), held, documents).join(
        queries.select("query_id", "query_text"), "query_id"
    )
    prompt = P.build_user(
        F.lit("Context:\n{{context}}"),
        F.lit("Q: {{query}} / {{query}}"),
        F.lit("Answer in one paragraph."),
        F.col("context"),
        F.col("query_text"),
    )
    return rows.select("query_id", prompt.alias("prompt"))


@check(
    "k1_query_keywords",
    f"select item_id, array_to_string({Q.keyword_list('text')}, '|') as keywords, len({Q.words('text')}) as n_words from benchmark",
)
def _(spark, d):
    return load(spark, d, "benchmark").select(
        "item_id",
        F.array_join(keywords(F.col("text")), "|").alias("keywords"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
