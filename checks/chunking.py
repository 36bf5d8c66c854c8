"""Chunking, clusters and TF-IDF similarity."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave.functions import folds
from docweave.functions.text import paragraphs, words
from docweave.operators import chunking as C
from docweave.operators import clusters as G
from docweave.operators import similarity as M
from docweave.operators.sentences import prepared
from docweave.plans.semantic import ChunkingConfig, semantic_chunks
from docweave.sources.readers import load, load_texts

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


def six_places(col):
    """Rounded, with a nudge: values that end in a 5 at the cut round the same way in both engines."""
    return F.round(F.col(col) + 1e-12, 6)


def docs(spark, d):
    return load_texts(spark, d, "documents", "doc_id", "text")


def sentences(spark, d):
    return prepared(docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


# Labels of the operator checks: runs of 40 sentences, or by sentence length with -1 for outliers.
def runs(spark, d):
    return sentences(spark, d).withColumn("label", F.floor(F.col("pos") / 40))


def mixed(spark, d):
    return sentences(spark, d).withColumn("label", (F.length("sentence") % 4 - 1).cast("long"))


RUNS = f"{Q.SENTENCES},\nlabelled as materialized (select doc_id, pos, sentence, pos // 40 as label from sentences)"
MIXED = f"{Q.SENTENCES},\nlabelled as materialized (select doc_id, pos, sentence, length(sentence) % 4 - 1 as label from sentences)"


def packing(limit, source="labelled"):
    new = f"(l.label <> p.label or p.len + length(l.sentence) > {limit})"
    return f"""packed as (
  select doc_id, pos, 0 as chunk, length(sentence) as len, label, sentence from {source} where pos = 0
  union all
  select l.doc_id, l.pos, case when {new} then p.chunk + 1 else p.chunk end,
         case when {new} then length(l.sentence) else p.len + length(l.sentence) end, l.label, l.sentence
  from packed p join {source} l on l.doc_id = p.doc_id and l.pos = p.pos + 1),
chunks as (select doc_id, chunk::bigint as chunk, string_agg(sentence, ' ' order by pos) as text from packed group by all)"""


def merging(source, minimum=50, exempt="false"):
    return f"""numbered as (
  select *, sum(case when chunk = 0 or length(text) >= {minimum} or {exempt} then 1 else 0 end)
            over (partition by doc_id order by chunk) - 1 as target from {source}),
merged as (select doc_id, target::bigint as chunk, string_agg(text, ' ' order by chunk) as text from numbered group by all)"""


def split_sql(size):
    """One CTE per separator; a path of piece numbers keeps the order."""
    steps = ["level0 as (select doc_id, [0] as path, text as piece, true as is_open, true as start from documents where text <> '')"]
    for i, sep in enumerate(folds.SEPARATORS):
        mark = " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in sep) or "''"
        parts = "string_split(piece, '')" if sep == "" else f"string_split(replace(piece, {mark}, {Q.SENTINEL} || {mark}), {Q.SENTINEL})"
        cut = "is_open" if sep == "" else f"is_open and contains(piece, {mark})"
        steps.append(f"""level{i + 1} as (
  select doc_id, list_append(path, i) as path, part as piece, length(part) >= {size} as is_open,
         i = 1 or length(part) >= {size} or length(parts[i - 1]) >= {size} as start from (
    select doc_id, path, parts, unnest(range(1, len(parts) + 1)) as i, unnest(parts) as part from (
      select doc_id, path, list_filter({parts}, lambda x: x <> '') as parts from level{i} where {cut}))
  union all select doc_id, list_append(path, 0), piece, is_open, start from level{i} where not ({cut}))""")
    last = f"level{len(folds.SEPARATORS)}"
    steps.append(f"""pieces as materialized (
  select doc_id, row_number() over (partition by doc_id order by path) - 1 as chunk, piece, start from {last})""")
    return ",\n".join(steps)


@check("c1_split_recursive", f"with {split_sql(200)} select doc_id, chunk, piece as text from pieces")
def _(spark, d):
    return C.split_recursive(docs(spark, d), 200)


@check(
    "c2_merge_splits",
    f"""with recursive {split_sql(400)},
    walk as (
      select doc_id, chunk, 0 as run, length(piece) as total, piece from pieces where chunk = 0
      union all
      select p.doc_id, p.chunk, case when p.start or w.total + length(p.piece) > 400 then run + 1 else run end,
             case when p.start or w.total + length(p.piece) > 400 then length(p.piece) else w.total + length(p.piece) end, p.piece
      from walk w join pieces p on p.doc_id = w.doc_id and p.chunk = w.chunk + 1),
    joined as (select doc_id, run, {Q.strip("string_agg(piece, '' order by chunk)")} as text from walk group by doc_id, run)
    select doc_id, row_number() over (partition by doc_id order by run) - 1 as chunk, text from joined where text <> ''""",
)
def _(spark, d):
    return C.recursive_chunks(docs(spark, d), 400, 0)


def carried(cur, g):
    return f"coalesce(list_sum(list_transform({cur}[{g} + 1:], lambda x: length(x))), 0)"


@check(
    "c2_recursive_chunks",
    f"""with recursive {split_sql(400)},
    walk as (
      select doc_id, chunk, [piece] as cur, null::varchar as closed from pieces where chunk = 0
      union all
      select doc_id, chunk, case when start then [piece] when is_full then list_append(cur[gone + 1:], piece) else list_append(cur, piece) end,
             case when start or is_full then array_to_string(cur, '') end
      from (
        select p.doc_id, p.chunk, p.piece, p.start, w.cur, {carried('w.cur', '0')} + length(p.piece) > 400 as is_full,
               list_filter(range(len(w.cur) + 1), lambda g: {carried('w.cur', 'g')} <= 60
                 and ({carried('w.cur', 'g')} + length(p.piece) <= 400 or {carried('w.cur', 'g')} = 0))[1] as gone
        from walk w join pieces p on p.doc_id = w.doc_id and p.chunk = w.chunk + 1)),
    made as (
      select doc_id, chunk, {Q.strip('closed')} as text from walk where closed is not null
      union all
      select doc_id, chunk + 1, {Q.strip("array_to_string(cur, '')")} from walk qualify row_number() over (partition by doc_id order by chunk desc) = 1)
    select doc_id, row_number() over (partition by doc_id order by chunk) - 1 as chunk, text from made where text <> ''""",
)
def _(spark, d):
    return C.recursive_chunks(docs(spark, d), 400, 60)


@check(
    "c3_fixed_windows",
    f"""with w as (select doc_id, {Q.words('text')} as ws from documents),
    n as (select doc_id, ws, case when len(ws) <= 64 then 1 else ceil((len(ws) - 64) / 48.0)::bigint + 1 end as k from w where len(ws) > 0),
    i as (select doc_id, ws, unnest(range(k)) as chunk from n)
    select doc_id, chunk, array_to_string(ws[chunk * 48 + 1 : chunk * 48 + 64], ' ') as text from i""",
)
def _(spark, d):
    return C.fixed_windows(docs(spark, d), 64, 16)


@check("c4_token_count", f"select doc_id, len({Q.words('text')}) as tokens from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", C.token_count(F.col("text")).alias("tokens"))


ADJACENT = f"""{Q.TFIDF},
adjacent as (
  select s.doc_id, s.pos, round(coalesce(sum(a.w * b.w), 0), 9) as sim
  from sentences s left join weights a on a.doc_id = s.doc_id and a.pos = s.pos
  left join weights b on b.doc_id = a.doc_id and b.pos = a.pos - 1 and b.token = a.token
  where s.pos > 0 group by all)"""


@check("c5_adjacent_similarity", f"with {ADJACENT} select doc_id, pos, round(sim + 1e-12, 6) as sim from adjacent")
def _(spark, d):
    return M.adjacent_similarity(sentences(spark, d)).withColumn("sim", six_places("sim"))


SEQUENTIAL = f"""{ADJACENT},
labelled as materialized (
  select s.doc_id, s.pos, s.sentence,
         (sum(case when sim < 0.3 then 1 else 0 end) over (partition by s.doc_id order by s.pos))::bigint as label
  from sentences s left join adjacent a on a.doc_id = s.doc_id and a.pos = s.pos)"""


@check("c6_group_sequential", f"with {SEQUENTIAL} select doc_id, pos, label from labelled")
def _(spark, d):
    return C.group_sequential(sentences(spark, d)).select("doc_id", "pos", "label")


def pairs_sql(threshold):
    return f"""{Q.TFIDF},
firsts as (select doc_id, sentence, min(pos) as pos, count(*) as copies from sentences group by all),
indexed as (select w.* from weights w join firsts using (doc_id, pos)),
dots as (
  select a.doc_id, a.pos as a, b.pos as b, round(sum(a.w * b.w), 9) as sim
  from indexed a join indexed b on a.doc_id = b.doc_id and a.token = b.token and a.pos < b.pos group by all),
pairs as materialized (
  select d.doc_id, a, b, sim, fa.copies as copies_a, fb.copies as copies_b from dots d
  join firsts fa on fa.doc_id = d.doc_id and fa.pos = a join firsts fb on fb.doc_id = d.doc_id and fb.pos = b
  where sim >= {threshold})"""


@check(
    "c7_pairwise_similarity",
    f"with {pairs_sql(0.3)} select doc_id, a, b, round(sim + 1e-12, 6) as sim, copies_a, copies_b from pairs",
)
def _(spark, d):
    return M.pairwise_similarity(sentences(spark, d), 0.3).withColumn("sim", six_places("sim"))


@check(
    "c8_similarity_profile",
    f"""with {Q.TFIDF},
    dots as (select a.doc_id, a.pos as a, b.pos as b, sum(a.w * b.w) as sim
             from weights a join weights b on a.doc_id = b.doc_id and a.token = b.token group by all),
    hist as (select doc_id, round(sim, 6) + 0.0 as sim, count(*) as pairs from dots group by all),
    zeros as (select s.doc_id, 0.0 as sim, n * n - coalesce(p, 0) as pairs from sizes s
              left join (select doc_id, count(*) as p from dots group by all) using (doc_id)),
    hall as (select doc_id, sim, sum(pairs)::bigint as pairs from (select * from hist union all select * from zeros)
             where sim < 0.999 and pairs > 0 group by all),
    cum as (select *, sum(pairs) over (partition by doc_id order by sim) as upto, sum(pairs) over (partition by doc_id) as total from hall),
    quart as (select doc_id, p, (total - 1) * p as place from (select distinct doc_id, total from cum), (values (0.25::double), (0.5), (0.75)) t(p)),
    ends as (select q.doc_id, p, place, min(case when upto > floor(place) then sim end) as lo, min(case when upto > ceil(place) then sim end) as hi
             from quart q join cum using (doc_id) group by all),
    q as (select doc_id, p, lo + (hi - lo) * (place - floor(place)) as v from ends)
    select c.doc_id, min(sim) as sim_min, max(sim) as sim_max, round(sum(sim * pairs) / sum(pairs) + 1e-10, 8) as sim_mean,
           round(max(a.v), 8) as sim_p25, round(max(b.v), 8) as sim_median, round(max(e.v), 8) as sim_p75
    from cum c join q a on a.doc_id = c.doc_id and a.p = 0.25 join q b on b.doc_id = c.doc_id and b.p = 0.5
    join q e on e.doc_id = c.doc_id and e.p = 0.75 group by c.doc_id""",
)
def _(spark, d):
    # The nudge keeps means that end in a 5 from rounding two ways.
    return M.similarity_profile(sentences(spark, d)).withColumn("sim_mean", F.round(F.col("sim_mean") + 1e-10, 8))


# min-label propagation; the keyed table keeps one row per sentence
def components_sql(nodes, edges):
    return f"""sides as materialized (select doc_id, a, b from {edges} union all select doc_id, b, a from {edges}),
roots(doc_id, pos, root) using key (doc_id, pos) as (
  select doc_id, pos, pos from {nodes}
  union
  select s.doc_id, s.b, min(r.root) from roots r join sides s on s.doc_id = r.doc_id and s.a = r.pos
  join recurring.roots o on o.doc_id = s.doc_id and o.pos = s.b where r.root < o.root group by s.doc_id, s.b)"""


THRESHOLD = f"""{pairs_sql(0.3)}, {components_sql('firsts', 'pairs')},
first_labels as (select doc_id, pos, dense_rank() over (partition by doc_id order by root) - 1 as label from roots),
clustered as materialized (
  select s.doc_id, s.pos, s.sentence, l.label from sentences s join firsts f on f.doc_id = s.doc_id and f.sentence = s.sentence
  join first_labels l on l.doc_id = f.doc_id and l.pos = f.pos)"""


@check("c9_cluster_threshold", f"with recursive {THRESHOLD} select doc_id, pos, label from clustered")
def _(spark, d):
    return G.cluster_threshold(sentences(spark, d), 0.3).select("doc_id", "pos", F.col("label").cast("long"))


DENSITY = f"""{pairs_sql(1 - 0.7 * 0.7 / 2)},
near as (select doc_id, pos, sum(c) as near from (select doc_id, a as pos, copies_b as c from pairs union all
         select doc_id, b, copies_a from pairs) group by all),
dense as materialized (select f.doc_id, f.pos, f.copies from firsts f left join near using (doc_id, pos)
          where coalesce(near, 0) + copies - 1 >= 5),
inside as (select p.doc_id, a, b from pairs p join dense x on x.doc_id = p.doc_id and x.pos = a
           join dense y on y.doc_id = p.doc_id and y.pos = b),
{components_sql('dense', 'inside')},
kept as (select r.doc_id, r.pos, r.root from roots r join dense using (doc_id, pos)
         qualify sum(copies) over (partition by r.doc_id, root) >= 10),
first_labels as (select doc_id, pos, dense_rank() over (partition by doc_id order by root) - 1 as label from kept),
clustered as materialized (
  select s.doc_id, s.pos, s.sentence, coalesce(l.label, -1) as label from sentences s
  join firsts f on f.doc_id = s.doc_id and f.sentence = s.sentence
  left join first_labels l on l.doc_id = f.doc_id and l.pos = f.pos)"""


@check("c10_cluster_density", f"with recursive {DENSITY} select doc_id, pos, label from clustered")
def _(spark, d):
    return G.cluster_density(sentences(spark, d), 0.3, 10).select("doc_id", "pos", F.col("label").cast("long"))


NEAREST = """outliers as (select * from {src} where label = -1), members as (select * from {src} where label <> -1),
shared as (
  select a.doc_id, a.pos, b.pos as near_pos, round(sum(a.w * b.w), 9) as sim
  from weights a join outliers o on o.doc_id = a.doc_id and o.pos = a.pos
  join weights b on b.doc_id = a.doc_id and b.token = a.token join members m on m.doc_id = b.doc_id and m.pos = b.pos
  group by all having round(sum(a.w * b.w), 9) > 0),
best as (select doc_id, pos, near_pos from shared qualify row_number() over (partition by doc_id, pos order by sim desc, near_pos) = 1),
fallback as (select doc_id, min(pos) as first_pos from members group by all),
placed as (
  select l.doc_id, l.pos, l.sentence, case when l.label <> -1 then l.label else coalesce(m.label, 0) end as label
  from {src} l left join best b on b.doc_id = l.doc_id and b.pos = l.pos left join fallback f on f.doc_id = l.doc_id
  left join members m on m.doc_id = l.doc_id and m.pos = coalesce(b.near_pos, f.first_pos))"""


@check(
    "c11_outliers_nearest",
    f"""with {Q.TFIDF}, labelled as materialized (select doc_id, pos, sentence, length(sentence) % 4 - 1 as label from sentences),
    {NEAREST.format(src='labelled')} select doc_id, pos, label from placed""",
)
def _(spark, d):
    return G.outliers_nearest(mixed(spark, d)).select("doc_id", "pos", "label")


@check(
    "c12_outliers_separate",
    f"""with {MIXED} select doc_id, pos, case when label <> -1 then label else max(label) over (partition by doc_id)
        + (sum((label = -1)::bigint) over (partition by doc_id order by pos))::bigint end as label from labelled""",
)
def _(spark, d):
    return G.outliers_separate(mixed(spark, d)).select("doc_id", "pos", "label")


@check(
    "c13_outliers_singleton",
    f"""with {MIXED} select doc_id, pos, case when label <> -1 then label
        else max(label) over (partition by doc_id) + 1 end as label from labelled""",
)
def _(spark, d):
    return G.outliers_singleton(mixed(spark, d)).select("doc_id", "pos", "label")


@check(
    "c14_cluster_stats",
    f"""with {MIXED}, sized as (select *, count(*) over (partition by doc_id, label) as sentences,
          row_number() over (partition by doc_id, label order by pos) as sample from labelled),
    n as (select doc_id, count(distinct label) as clusters from labelled group by all)
    select doc_id, label, clusters, sentences, sample,
           case when length(sentence) > 100 then substring(sentence, 1, 97) || '...' else sentence end as sentence
    from sized join n using (doc_id) where sample <= 2""",
)
def _(spark, d):
    return G.cluster_stats(mixed(spark, d), 2).withColumn("sample", F.col("sample").cast("long"))


@check(
    "c15_order_sentences",
    f"with {MIXED} select doc_id, pos, row_number() over (partition by doc_id order by label, pos) - 1 as place from labelled",
)
def _(spark, d):
    return G.order_sentences(mixed(spark, d), preserve=False).select("doc_id", "pos", "place")


@check("c16_pack_chunks", f"with recursive {RUNS}, {packing(2000)} select doc_id, chunk, text from chunks")
def _(spark, d):
    return C.pack_chunks(runs(spark, d), 2000)


OVERSIZED = """groups as (
  select doc_id, label, string_agg(sentence, ' ' order by pos) as text, count(*) as n, min(pos) as first from labelled group by all),
big as (select doc_id, label from groups where length(text) > 1000 and n > 1),
inner_rows as materialized (select l.doc_id, l.label, l.sentence, row_number() over (partition by l.doc_id, l.label order by l.pos) - 1 as pos
               from labelled l join big using (doc_id, label)),
cut as (
  select doc_id, label, pos, 0 as part, length(sentence) as len, sentence from inner_rows where pos = 0
  union all
  select l.doc_id, l.label, l.pos, case when p.len + length(l.sentence) > 1000 then p.part + 1 else p.part end,
         case when p.len + length(l.sentence) > 1000 then length(l.sentence) else p.len + length(l.sentence) end, l.sentence
  from cut p join inner_rows l on l.doc_id = p.doc_id and l.label = p.label and l.pos = p.pos + 1),
everything as (
  select doc_id, label, part, string_agg(sentence, ' ' order by pos) as text, true as is_part from cut group by doc_id, label, part
  union all
  select doc_id, label, 0, text, false from groups g where not exists (select 1 from big b where b.doc_id = g.doc_id and b.label = g.label)),
pieces as (select doc_id, row_number() over (partition by doc_id order by label, part) - 1 as chunk, text, is_part as part from everything)"""


@check("c17_split_oversized", f"with recursive {RUNS}, {OVERSIZED} select doc_id, chunk, text, part from pieces")
def _(spark, d):
    return C.split_oversized(runs(spark, d), 1000)


def small_chunks(spark, d):
    """Packed at 120 characters, so that many chunks fall below the minimum."""
    return C.pack_chunks(runs(spark, d), 120)


@check(
    "c18_merge_small",
    f"with recursive {RUNS}, {packing(120)}, {merging('chunks', 60)} select doc_id, chunk, text from merged",
)
def _(spark, d):
    return C.merge_small(small_chunks(spark, d), 60)


@check(
    "c19_add_overlap",
    f"""with recursive {RUNS}, {packing(120)}, base as materialized (select * from chunks),
    prefixed as (
      select doc_id, chunk, text from base where chunk = 0
      union all
      select b.doc_id, b.chunk, case when len({Q.words('p.text')}) > 5
        then array_to_string({Q.words('p.text')}[-5:], ' ') || ' ' || b.text else b.text end
      from prefixed p join base b on b.doc_id = p.doc_id and b.chunk = p.chunk + 1)
    select doc_id, chunk, text from prefixed""",
)
def _(spark, d):
    return C.add_overlap(small_chunks(spark, d), 5)


REPLY = "'note' || chr(10) || 'split_after: ' || turn || ', ' || (conv_id % 9 + 2) || ', ' || (length(text) % 50)"


@check(
    "c20_parse_split_points",
    f"""with r as (select conv_id, turn, [turn, conv_id % 9 + 2, length(text) % 50] as n from conversations)
    select conv_id, turn, case when n[1] <= n[2] and n[2] <= n[3] and n[1] >= 2 then array_to_string(n, ',') end as points from r""",
)
def _(spark, d):
    reply = F.concat(
        F.lit("note\nsplit_after: "),
        F.col("turn").cast("string"),
        F.lit(", "),
        (F.col("conv_id") % 9 + 2).cast("string"),
        F.lit(", "),
        (F.length("text") % 50).cast("string"),
    )
    points = folds.parse_split_points(reply, F.lit(2))
    joined = F.when(points.isNotNull(), F.array_join(points.cast("array<string>"), ","))
    return load(spark, d, "conversations").select("conv_id", "turn", joined.alias("points"))


PIECES = f"""pieces as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '') as ps,
  n_chars % 5 + 1 as p1, n_chars % 7 + 6 as p2 from documents),
rows_ as (select doc_id, p1, p2, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as piece from pieces)"""


@check(
    "c21_regroup",
    f"""with {PIECES}, g as (select doc_id, piece, i, (i > p1)::bigint + (i > p2)::bigint as chunk from rows_)
    select doc_id, chunk, string_agg(piece, ' ' order by i) as text from g group by doc_id, chunk""",
)
def _(spark, d):
    rows = load_texts(spark, d, "documents").select(
        "doc_id",
        paragraphs(F.col("text")).alias("pieces"),
        F.array(F.col("n_chars") % 5 + 1, F.col("n_chars") % 7 + 6).alias("points"),
    )
    made = rows.select("doc_id", F.posexplode(folds.regroup(F.col("pieces"), F.col("points"))).alias("chunk", "text"))
    return made.withColumn("chunk", F.col("chunk").cast("long"))


@check(
    "c22_budget_windows",
    f"""with recursive {PIECES}, t as materialized (select doc_id, i, piece, len({Q.words('piece')}) as n, count(*) over (partition by doc_id) as total from rows_),
    walk as (
      select doc_id, i, 1 as first, n as used from t where i = 1
      union all
      select t.doc_id, t.i, case when used > 80 then t.i else first end, case when used > 80 then n else used + n end
      from walk w join t on t.doc_id = w.doc_id and t.i = w.i + 1)
    select doc_id, (first - 1)::bigint as first, count(*) as taken,
           string_agg('<|start_chunk_' || i || '|>' || piece || '<|end_chunk_' || i || '|>', '' order by i) as prompt
    from walk join t using (doc_id, i) where first < total group by doc_id, first""",
)
def _(spark, d):
    rows = docs(spark, d).select("doc_id", paragraphs(F.col("text")).alias("pieces"))
    made = rows.select("doc_id", F.explode(folds.budget_windows(F.col("pieces"), 80)).alias("w"))
    return made.select("doc_id", F.col("w.first").cast("long").alias("first"), F.col("w.taken").cast("long").alias("taken"), F.col("w.text").alias("prompt"))


SEMANTIC = f"""{SEQUENTIAL}, {OVERSIZED.replace('1000', '2000')}, {merging('pieces', 50, 'part')},
{Q.keyword_rows("(select doc_id * 1000000 + chunk as chunk_key, text from merged)", 'chunk_key', 'text')}"""


@check(
    "c23_semantic_chunks_sequential",
    f"""with recursive {SEMANTIC} select doc_id, chunk, text, coalesce(keywords, '') as keywords
        from merged left join keyword_lists on chunk_key = doc_id * 1000000 + chunk""",
)
def _(spark, d):
    made = semantic_chunks(docs(spark, d), ChunkingConfig(use_clustering=False))
    return made.withColumn("keywords", F.array_join("keywords", "|"))


def clustered_sql(clusters, nearest):
    return f"""{clusters}, {nearest.format(src='clustered')},
ordered as materialized (select doc_id, pos, sentence, label from placed), {packing(2000, 'ordered')}, {merging('chunks', 50)},
{Q.keyword_rows("(select doc_id * 1000000 + chunk as chunk_key, text from merged)", 'chunk_key', 'text')}"""


CLUSTERED = clustered_sql(DENSITY, NEAREST)


@check(
    "c23_semantic_chunks_clustered",
    f"""with recursive {CLUSTERED} select doc_id, chunk, text, coalesce(keywords, '') as keywords
        from merged left join keyword_lists on chunk_key = doc_id * 1000000 + chunk""",
)
def _(spark, d):
    made = semantic_chunks(docs(spark, d))
    return made.withColumn("keywords", F.array_join("keywords", "|"))


@check("e1_tfidf", f"with {Q.TFIDF} select doc_id, pos, token, round(w, 6) as w from weights")
def _(spark, d):
    return M.tfidf(sentences(spark, d)).withColumn("w", F.round("w", 6))


@check(
    "e2_sparse_cosine",
    f"with {pairs_sql(0.6)} select doc_id, a, b, round(sim + 1e-12, 6) as sim, copies_a, copies_b from pairs",
)
def _(spark, d):
    return M.sparse_cosine(sentences(spark, d), 0.6).withColumn("sim", six_places("sim"))


# Ids of another type: the same rows under texts.
def text_ids(df):
    return df.withColumn("doc_id", F.md5(F.col("doc_id").cast("string")))


@check(
    "c7_pairwise_text_ids",
    f"with {pairs_sql(0.3)} select md5(doc_id::varchar) as doc_id, a, b, round(sim + 1e-12, 6) as sim, copies_a, copies_b from pairs",
)
def _(spark, d):
    return M.pairwise_similarity(text_ids(sentences(spark, d)), 0.3).withColumn("sim", six_places("sim"))


@check("c10_density_text_ids", f"with recursive {DENSITY} select md5(doc_id::varchar) as doc_id, pos, label from clustered")
def _(spark, d):
    return G.cluster_density(text_ids(sentences(spark, d)), 0.3, 10).select("doc_id", "pos", F.col("label").cast("long"))


# Dense vectors: how often eight letters occur, less a share of the length.  They stand in for a model's.
LETTERS = "entariso"


def embedded(rows):
    n = F.length("sentence")
    counts = [(n - F.length(F.replace("sentence", F.lit(c)))).cast("double") - n / F.lit(12.0) for c in LETTERS]
    return rows.withColumn("vector", F.array(*counts))


EMBEDDED = f"""{Q.SENTENCES},
embedded as materialized (select doc_id, pos, sentence, [
  {', '.join(f"length(sentence) - length(replace(sentence, '{c}', '')) - length(sentence) / 12.0::double" for c in 'entariso')}]::double[] as v from sentences)"""


def dense_pairs_sql(threshold):
    return f"""{EMBEDDED},
firsts as materialized (select doc_id, sentence, v, min(pos) as pos, count(*) as copies from embedded group by all),
pairs as materialized (
  select * from (
    select x.doc_id, x.pos as a, y.pos as b, round(list_cosine_similarity(x.v, y.v), 9) as sim, x.copies as copies_a, y.copies as copies_b
    from firsts x join firsts y on x.doc_id = y.doc_id and x.pos < y.pos) where sim >= {threshold})"""


ADJACENT_DENSE = f"""{EMBEDDED},
adjacent as (select y.doc_id, y.pos, round(list_cosine_similarity(x.v, y.v), 9) as sim from embedded x join embedded y on x.doc_id = y.doc_id and y.pos = x.pos + 1)"""


@check("c5_adjacent_dense", f"with {ADJACENT_DENSE} select doc_id, pos, round(sim + 1e-12, 6) as sim from adjacent")
def _(spark, d):
    return M.adjacent_similarity(embedded(sentences(spark, d))).withColumn("sim", six_places("sim"))


@check(
    "c7_pairwise_dense",
    f"with {dense_pairs_sql(0.97)} select doc_id, a, b, round(sim + 1e-12, 6) as sim, copies_a, copies_b from pairs",
)
def _(spark, d):
    return M.pairwise_similarity(embedded(sentences(spark, d)), 0.97).withColumn("sim", six_places("sim"))


THRESHOLD_DENSE = THRESHOLD.replace(pairs_sql(0.3), dense_pairs_sql(0.97))
DENSITY_DENSE = DENSITY.replace(pairs_sql(1 - 0.7 * 0.7 / 2), dense_pairs_sql("1 - (1 - 0.8::double) * (1 - 0.8::double) / 2"))

NEAREST_DENSE = """outliers as (select * from {src} where label = -1), members as (select * from {src} where label <> -1),
best as (
  select o.doc_id, o.pos, m.pos as near_pos from outliers o join members m on m.doc_id = o.doc_id
  join embedded x on x.doc_id = o.doc_id and x.pos = o.pos join embedded y on y.doc_id = m.doc_id and y.pos = m.pos
  qualify row_number() over (partition by o.doc_id, o.pos order by round(list_cosine_similarity(x.v, y.v), 9) desc, m.pos) = 1),
placed as (
  select l.doc_id, l.pos, l.sentence, case when l.label <> -1 then l.label else coalesce(m.label, 0) end as label
  from {src} l left join best b on b.doc_id = l.doc_id and b.pos = l.pos left join members m on m.doc_id = l.doc_id and m.pos = b.near_pos)"""


@check("c9_threshold_dense", f"with recursive {THRESHOLD_DENSE} select doc_id, pos, label from clustered")
def _(spark, d):
    return G.cluster_threshold(embedded(sentences(spark, d)), 0.97).select("doc_id", "pos", F.col("label").cast("long"))


@check("c10_density_dense", f"with recursive {DENSITY_DENSE} select doc_id, pos, label from clustered")
def _(spark, d):
    return G.cluster_density(embedded(sentences(spark, d)), 0.8, 10).select("doc_id", "pos", F.col("label").cast("long"))


@check(
    "c11_nearest_dense",
    f"""with {EMBEDDED}, labelled as materialized (select doc_id, pos, sentence, length(sentence) % 4 - 1 as label from sentences),
    {NEAREST_DENSE.format(src='labelled')} select doc_id, pos, label from placed""",
)
def _(spark, d):
    return G.outliers_nearest(embedded(mixed(spark, d))).select("doc_id", "pos", "label")


@check(
    "c23_semantic_dense",
    f"""with recursive {clustered_sql(DENSITY_DENSE, NEAREST_DENSE)} select doc_id, chunk, text, coalesce(keywords, '') as keywords
        from merged left join keyword_lists on chunk_key = doc_id * 1000000 + chunk""",
)
def _(spark, d):
    made = semantic_chunks(docs(spark, d), ChunkingConfig(threshold=0.8), embed=embedded)
    return made.withColumn("keywords", F.array_join("keywords", "|"))


@check(
    "c23_semantic_dense_sequential",
    f"""with recursive {SEMANTIC.replace(ADJACENT, ADJACENT_DENSE)} select doc_id, chunk, text, coalesce(keywords, '') as keywords
        from merged left join keyword_lists on chunk_key = doc_id * 1000000 + chunk""",
)
def _(spark, d):
    made = semantic_chunks(docs(spark, d), ChunkingConfig(use_clustering=False), embed=embedded)
    return made.withColumn("keywords", F.array_join("keywords", "|"))
