"""Ranking and text metrics, and statistics over result tables."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from checks.retrieval import SEMANTIC, store
from docweave.operators import evaluation as V
from docweave.operators import retrieval as R
from docweave.plans.evaluate import evaluate
from docweave.sources.readers import load, load_texts

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


# Retrieved: the chunks a vector search finds.  Relevant: the chunks of the document the query stems from.
def ranking(spark, d):
    queries, held, documents = store(spark, d)
    vectors = held.select("chunk_id", F.col("embedding").alias("vector"))
    hits = R.semantic_search(queries, held, documents, 10)
    retrieved = hits.join(vectors, "chunk_id").select(F.col("query_id").alias("question_id"), "rank", "vector")
    relevant = queries.select(F.col("query_id").alias("question_id"), "document_id").join(
        held.select("document_id", F.col("chunk_id").alias("rel_id"), F.col("embedding").alias("rel_vector")), "document_id"
    )
    asked = queries.select(F.col("query_id").alias("question_id"))
    return asked, retrieved, relevant.select("question_id", "rel_id", "rel_vector")


PAIRS = f"""{SEMANTIC},
questions as (select query_id as question_id, document_id from asked),
retrieved as (select query_id as question_id, s.rank, c.embedding as vector from semantic s join chunks c using (chunk_id) where s.rank <= 10),
relevant as (select question_id, chunk_id as rel_id, embedding as rel_vector from questions join chunks using (document_id)),
pairs as materialized (select question_id, rank, rel_id, round(coalesce(list_cosine_similarity(vector, rel_vector), 0), 9) as sim
          from retrieved join relevant using (question_id)),
n_rel as (select question_id, count(*) as n from relevant group by all)"""


@check("v1_matches", f"with {PAIRS} select question_id, rank, bool_or(sim > 0.3) as hit from pairs group by all")
def _(spark, d):
    _, retrieved, relevant = ranking(spark, d)
    return V.matches(V.scored_pairs(retrieved, relevant), 0.3).withColumn("rank", F.col("rank").cast("long"))


P_AT = "select question_id, count(distinct case when sim > {t} and rank <= 5 then rank end) / 5 as v from pairs group by all"


@check(
    "v2_precision_at_k",
    f"with {PAIRS}, p as ({P_AT.format(t=0.5)}) select question_id, round(coalesce(v, 0), 6) as precision_at_k from questions left join p using (question_id)",
)
def _(spark, d):
    asked, retrieved, relevant = ranking(spark, d)
    out = V.precision_at_k(asked, V.scored_pairs(retrieved, relevant))
    return out.withColumn("precision_at_k", F.round("precision_at_k", 6))


def recall_sql(k, t, name):
    return f"""round(coalesce(count(distinct case when sim > {t} and rank <= {k} then rel_id end) / max(n), 0), 6) as {name}"""


JOINED = "from questions left join n_rel using (question_id) left join pairs using (question_id) group by question_id"


@check("v3_recall_at_k", f"with {PAIRS} select question_id, {recall_sql(5, 0.3, 'recall_at_k')} {JOINED}")
def _(spark, d):
    asked, retrieved, relevant = ranking(spark, d)
    out = V.recall_at_k(asked, V.scored_pairs(retrieved, relevant), relevant)
    return out.withColumn("recall_at_k", F.round("recall_at_k", 6))


RECALLS = ", ".join(recall_sql(k, 0.2, f"recall_at_{k}") for k in range(1, 6))


@check("v4_recall_multi_k", f"with {PAIRS} select question_id, {RECALLS} {JOINED}")
def _(spark, d):
    asked, retrieved, relevant = ranking(spark, d)
    out = V.recall_multi_k(asked, V.scored_pairs(retrieved, relevant), relevant, [1, 2, 3, 4, 5])
    return out.withColumns({f"recall_at_{k}": F.round(f"recall_at_{k}", 6) for k in range(1, 6)})


@check("v5_mrr", f"with {PAIRS} select question_id, round(coalesce(1 / min(case when sim > 0.5 then rank end), 0), 6) as mrr {JOINED}")
def _(spark, d):
    asked, retrieved, relevant = ranking(spark, d)
    return V.mrr(asked, V.scored_pairs(retrieved, relevant)).withColumn("mrr", F.round("mrr", 6))


NDCG = """gains as (select question_id, sum(1 / log2(rank + 1)) as dcg from (select distinct question_id, rank from pairs where sim > 0.5 and rank <= 5) group by all),
ideals as (select question_id, list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) as ideal from n_rel)"""


@check(
    "v6_ndcg",
    f"with {PAIRS}, {NDCG} select question_id, round(coalesce(dcg / ideal, 0), 6) as ndcg from questions left join gains using (question_id) left join ideals using (question_id)",
)
def _(spark, d):
    asked, retrieved, relevant = ranking(spark, d)
    return V.ndcg(asked, V.scored_pairs(retrieved, relevant), relevant).withColumn("ndcg", F.round("ndcg", 6))


# Answers are the turns of a conversation, the truth is the turn before.
def answers(spark, d):
    rows = load_texts(spark, d, "conversations", "conv_id", "turn", "text")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    return rows.join(before, ["conv_id", "turn"]).select(key, F.col("text").alias("answer"), "truth")


ANSWERS = """answers as (select a.conv_id * 1000 + a.turn as id, a.text as answer, b.text as truth
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1),
ws as materialized (select id, answer, truth, {a} as a, {b} as b from answers)""".format(
    a=Q.words(Q.normalized("answer")), b=Q.words(Q.normalized("truth"))
)

GRAMS = """grams as (
  select id, n, gram, sum(side = 0) as in_c, sum(side = 1) as in_r from (
    select id, n, 0 as side, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i : i + n - 1], ' '))) as gram
    from ws join (select unnest([1, 2, 3, 4]) as n) on len(a) >= n
    union all
    select id, n, 1, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i : i + n - 1], ' ')))
    from ws join (select unnest([1, 2, 3, 4]) as n) on len(b) >= n)
  group by all),
hits as (select id, n, sum(least(in_c, in_r)) as m, sum(in_c) as t from grams group by all),
prec as (select ws.id, k.n, case when coalesce(m, 0) = 0 then 0.1 else m end / greatest(coalesce(t, 0), 1) as p, coalesce(m, 0) as m
         from ws join (select unnest([1, 2, 3, 4]) as n) k on true left join hits on hits.id = ws.id and hits.n = k.n),
bleus as (
  select ws.id, case when sum(case when n = 1 then m end) = 0 then 0 else
           (case when len(a) > len(b) then 1 when len(a) = 0 then 0 else exp(1 - len(b) / len(a)) end) * exp(sum(0.25 * ln(p))) end as bleu,
         case when sum(case when n = 1 then m end) = 0 then 0 else
           (case when len(a) > len(b) then 1 when len(a) = 0 then 0 else exp(1 - len(b) / len(a)) end) * max(case when n = 1 then p end) end as bleu_1
  from ws join prec using (id) group by ws.id, a, b)"""


@check("v7_bleu", f"with {ANSWERS}, {GRAMS} select id, round(bleu, 6) as bleu from bleus")
def _(spark, d):
    out = V.bleu(answers(spark, d), {"bleu": (0.25,) * 4})
    return out.withColumn("bleu", F.round("bleu", 6))


@check("v8_bleu_n", f"with {ANSWERS}, {GRAMS} select id, round(bleu_1, 6) as bleu_1, round(bleu, 6) as bleu_4 from bleus")
def _(spark, d):
    return V.bleu_n(answers(spark, d)).select("id", F.round("bleu_1", 6).alias("bleu_1"), F.round("bleu_4", 6).alias("bleu_4"))


ROUGE = """sets as (select id, n, count(*) filter (in_c > 0) as na, count(*) filter (in_r > 0) as nb, count(*) filter (in_c > 0 and in_r > 0) as shared from grams group by all),
pr as (select id, n, case when na > 0 then shared / na else 0 end as p, case when nb > 0 then shared / nb else 0 end as r from sets),
rouges as (select id, max(case when n = 1 then 2 * p * r / (p + r + 1e-8) end) as rouge_1, max(case when n = 2 then 2 * p * r / (p + r + 1e-8) end) as rouge_2 from pr group by id)"""


@check(
    "v9_rouge_n",
    f"with {ANSWERS}, {GRAMS}, {ROUGE} select ws.id, round(coalesce(rouge_1, 0), 6) as rouge_1, round(coalesce(rouge_2, 0), 6) as rouge_2 from ws left join rouges using (id)",
)
def _(spark, d):
    a, b = F.col("answer"), F.col("truth")
    return answers(spark, d).select(
        "id", F.round(V.rouge_n(a, b, 1), 6).alias("rouge_1"), F.round(V.rouge_n(a, b, 2), 6).alias("rouge_2")
    )


# One row of the table of common lengths per word of the answer.
LCS = """steps as (
  select id, a, b, 0 as i, list_transform(range(len(b) + 1), lambda x: 0::bigint) as row from ws
  union all
  select id, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [case when b[j] = a[i + 1] then row[j] + 1 else row[j + 1] end]),
    lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0::bigint])
  from steps where i < len(a)),
lcs as (select id, len(a) as n, len(b) as m, row[len(b) + 1] as lcs from steps where i = len(a))"""


@check(
    "v10_rouge_l",
    f"""with recursive {ANSWERS}, {LCS}, pr as (select id, case when n > 0 then lcs / n else 0 end as p, case when m > 0 then lcs / m else 0 end as r from lcs)
    select id, round(2 * p * r / (p + r + 1e-8), 6) as rouge_l from pr""",
)
def _(spark, d):
    return V.rouge_l(answers(spark, d)).withColumn("rouge_l", F.round("rouge_l", 6))


OVERLAP = "case when len(b) = 0 then 0 else len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(b)) end"


@check("v11_token_overlap", f"with {ANSWERS} select id, round({OVERLAP}, 6) as overlap from ws")
def _(spark, d):
    return answers(spark, d).select("id", F.round(V.token_overlap(F.col("answer"), F.col("truth")), 6).alias("overlap"))


@check(
    "v12_semantic_similarity",
    """select a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 6) as similarity
       from embeddings a left join embeddings b on b.vec_id = a.vec_id * 2 + 1""",
)
def _(spark, d):
    a = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = a.select(F.col("vec_id").alias("other"), F.col("v").alias("w"))
    joined = a.join(b, F.col("other") == F.col("vec_id") * 2 + 1, "left")
    return joined.select("vec_id", F.round(V.semantic_similarity(F.col("v"), F.col("w")), 6).alias("similarity"))


REPLY_SQL = """case event_type when 'view' then ' ' || (value::decimal(18, 2))::varchar || ' ' when 'click' then (user_id % 12)::varchar
  when 'error' then 'ERROR' when 'signup' then '-1' else props end"""


def reply():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", F.concat(F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .when(kind == "click", (F.col("user_id") % 12).cast("string"))
        .when(kind == "error", F.lit("ERROR"))
        .when(kind == "signup", F.lit("-1"))
        .otherwise(F.col("props"))
    )


@check(
    "v13_judge_score",
    """select event_id, case when user_id % 10 = 0 then 0 when event_type = 'view' then least(greatest(value::decimal(18, 2)::double / 10, 0), 1)
       when event_type = 'click' then least((user_id % 12) / 10, 1) when event_type = 'signup' then 0 else 0.5 end::double as score from events""",
)
def _(spark, d):
    given = F.when(F.col("user_id") % 10 != 0, F.lit("text"))
    return load(spark, d, "events").select("event_id", V.judge_score(reply(), given).alias("score"))


# Result rows: the measures of an order line stand in for the scores of a question.
def results(spark, d):
    line = load(spark, d, "lineitem")
    names = {
        "faithfulness_score": F.col("l_discount") * 10,
        "relevancy_score": F.col("l_tax") * 10,
        "context_recall_score": F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50),
        "similarity_score": F.col("l_quantity") / 100,
        "precision_at_k": F.col("l_linenumber") / 7.0,
        "recall_at_k": 1.0 / F.col("l_linenumber"),
        "mrr": F.col("l_discount") + 0.5,
        "ndcg": F.col("l_tax") + 1.0,
        "bleu": F.col("l_discount") * F.col("l_tax"),
        "bleu_1": F.col("l_discount") / 2,
        "bleu_4": F.col("l_tax") / 2,
        "semantic_similarity": F.col("l_quantity") / 60,
    }
    out = line.select(F.col("l_orderkey").alias("question_id"), *[c.alias(n) for n, c in names.items()])
    return out.withColumn("overall_score", V.overall())


RESULTS = """results as (
  select l_orderkey as question_id, l_discount * 10 as faithfulness_score, l_tax * 10 as relevancy_score,
    case when l_returnflag <> 'R' then l_quantity / 50 end as context_recall_score, l_quantity / 100 as similarity_score,
    l_linenumber / 7.0::double as precision_at_k, 1.0::double / l_linenumber as recall_at_k, l_discount + 0.5 as mrr, l_tax + 1.0 as ndcg,
    l_discount * l_tax as bleu, l_discount / 2 as bleu_1, l_tax / 2 as bleu_4, l_quantity / 60 as semantic_similarity,
    (l_discount * 10 + l_tax * 10 + case when l_returnflag <> 'R' then l_quantity / 50 end + l_quantity / 100 + l_linenumber / 7.0::double
     + 1.0::double / l_linenumber + l_discount + 0.5 + l_tax + 1.0 + l_discount * l_tax + l_discount / 2 + l_tax / 2 + l_quantity / 60) / 13 as overall_score
  from lineitem),
long as (unpivot results on columns(* exclude question_id) into name metric value value)"""
STATS = f"""{RESULTS},
stats as (select metric, round(avg(value), 4) as average, round(stddev_pop(value), 4) as std, round(min(value), 4) as min,
  round(max(value), 4) as max, count(*) as count from long group by metric)"""


@check("v14_overall", f"with {RESULTS} select question_id, round(overall_score, 6) as overall_score from results")
def _(spark, d):
    return results(spark, d).select("question_id", F.round("overall_score", 6).alias("overall_score"))


def judged(spark, d):
    """Answers, retrieved and relevant vectors of the benchmark questions."""
    asked, retrieved, relevant = ranking(spark, d)
    queries, held, _ = store(spark, d)
    texts = held.select(F.col("chunk_id").alias("question_id"), F.col("chunk_text").alias("generated_answer"), F.col("embedding").alias("truth_vector"))
    digits = F.col("question_id") % 13
    rows = queries.select(
        F.col("query_id").alias("question_id"),
        F.col("query_text").alias("question"),
        F.col("query_text").alias("ground_truth"),
        F.col("vector").alias("answer_vector"),
    ).join(texts, "question_id")
    return (
        rows.withColumn("faithfulness_reply", digits.cast("string"))
        .withColumn("relevancy_reply", F.when(digits == 3, F.lit("n/a")).otherwise((digits / 2).cast("string")))
        .withColumn("context_recall_reply", F.lit(" 7.5 ")),
        retrieved,
        relevant,
    )


# Bench answer of a question: the stored text of the same number.
EVAL = f"""{PAIRS}, {NDCG},
answers as (select query_id as id, chunk_text as answer, query_text as truth from asked join chunks on chunk_id = query_id),
ws as materialized (select id, answer, truth, {Q.words(Q.normalized('answer'))} as a, {Q.words(Q.normalized('truth'))} as b from answers),
{GRAMS.replace('hits as (', 'gram_hits as (').replace('left join hits on hits.id = ws.id and hits.n = k.n', 'left join gram_hits gh on gh.id = ws.id and gh.n = k.n')},
{ROUGE}, {LCS},
lpr as (select id, case when n > 0 then lcs / n else 0 end as p, case when m > 0 then lcs / m else 0 end as r from lcs),
recalls as (select question_id, {recall_sql(5, 0.3, 'recall_at_k')}, {RECALLS},
  coalesce(1 / min(case when sim > 0.5 then rank end), 0) as mrr, count(distinct case when sim > 0.5 and rank <= 5 then rank end) / 5 as precision_at_k {JOINED}),
counts as (select question_id, count(*) as c from retrieved group by all),
everything as (
  select q.question_id, coalesce(c, 0) as retrieved_contexts_count,
    least((q.question_id % 13) / 10, 1) as faithfulness_score,
    case when q.question_id % 13 = 3 then 0.5 else (q.question_id % 13) / 20 end as relevancy_score,
    case when coalesce(c, 0) > 0 then 0.75 else 0 end as context_recall_score, {OVERLAP} as similarity_score,
    precision_at_k, recall_at_k, recall_at_1, recall_at_2, recall_at_3, recall_at_4, recall_at_5, mrr, coalesce(dcg / ideal, 0) as ndcg,
    bleu, bleu_1, bleu as bleu_4, coalesce(rouge_1, 0) as rouge_1, coalesce(rouge_2, 0) as rouge_2, 2 * lpr.p * lpr.r / (lpr.p + lpr.r + 1e-8) as rouge_l,
    coalesce(list_cosine_similarity(asked.vector, ch.embedding), 0) as semantic_similarity
  from questions q join asked on asked.query_id = q.question_id join chunks ch on ch.chunk_id = q.question_id join ws on ws.id = q.question_id
  join bleus on bleus.id = ws.id left join rouges on rouges.id = ws.id join lpr on lpr.id = ws.id join recalls r on r.question_id = q.question_id
  left join gains g on g.question_id = q.question_id left join ideals i on i.question_id = q.question_id left join counts ct on ct.question_id = q.question_id)"""
METRICS = (
    "faithfulness_score relevancy_score context_recall_score similarity_score precision_at_k recall_at_k recall_at_1 recall_at_2 "
    "recall_at_3 recall_at_4 recall_at_5 mrr ndcg bleu bleu_1 bleu_4 rouge_1 rouge_2 rouge_l semantic_similarity"
).split()


@check(
    "v15_evaluate",
    f"""with recursive {EVAL} select question_id, retrieved_contexts_count, {', '.join(f'round({m}, 3)::double as {m}' for m in METRICS)},
      round(({' + '.join(V.OVERALL_TERMS)}) / 13, 3)::double as overall_score from everything""",
)
def _(spark, d):
    return evaluate(*judged(spark, d))


@check("v15_evaluate_text_ids", f"select * replace (md5(question_id::varchar) as question_id) from ({ORACLES['v15_evaluate']})")
def _(spark, d):
    own = {c: F.md5(F.col(c).cast("string")) for c in ("question_id", "rel_id")}
    return evaluate(*[df.withColumns({c: v for c, v in own.items() if c in df.columns}) for df in judged(spark, d)])


@check("v16_metric_stats", f'with {STATS} select metric, average, std, "min", "max", count from stats')
def _(spark, d):
    return V.metric_stats(results(spark, d))


@check(
    "v17_category_summary",
    f"""with {STATS}, cats as (select * from (values {', '.join(f"('{c}', '{m}', {i})" for c, ms in V.CATEGORIES.items() for i, m in enumerate(ms))}) t(category, metric, place)),
    j as (select * from stats join cats using (metric))
    select category, round(avg(average), 4) as category_average, count(*) as metrics_count,
           arg_max(metric, average - place * 1e-9) as best_metric, max(average) as best_score from j group by category""",
)
def _(spark, d):
    return V.category_summary(V.metric_stats(results(spark, d)))


@check("v18_quick_stats", f'with {STATS} select metric, average, "min", "max", count from stats')
def _(spark, d):
    return V.quick_stats(results(spark, d))


@check(
    "v19_numeric_columns",
    """select 'l_suppkey' as metric, count(*) as count from lineitem union all select 'l_tax', count(*) from lineitem
       union all select 'l_quantity', count(*) from lineitem""",
)
def _(spark, d):
    rows = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), "l_suppkey", "l_tax", "l_quantity", "l_returnflag", "l_shipdate"
    )
    return V.quick_stats(rows, V.numeric_columns(rows)).select("metric", "count")


@check(
    "v20_union_results",
    """select l_orderkey as question_id, l_tax as mrr, null::double as ndcg from lineitem
       union all select o_orderkey, null, o_totalprice from orders""",
)
def _(spark, d):
    a = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_tax").alias("mrr"))
    b = load(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_totalprice").alias("ndcg"))
    return V.union_results(a, b)


@check("v21_answered", "select conv_id, turn from conversations where role = 'assistant'")
def _(spark, d):
    rows = load(spark, d, "conversations").withColumn(
        "generated_answer", F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "user", F.lit(""))
    )
    return V.answered(rows).select("conv_id", "turn")
