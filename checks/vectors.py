"""Dense vectors: distances, resizing, choice of method, preservation."""


from pyspark.sql import functions as F

from checks.registry import registrar
from docweave.functions import vectors as V
from docweave.operators import drift as D
from docweave.operators import store as L
from docweave.operators import resizing as Z
from docweave.sources import tables
from docweave.sources.readers import load

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


def vecs(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


VECS = "vecs as (select vec_id, label, embedding::double[] as v, len(embedding) as d from embeddings)"


def listed(df, col="v"):
    """One row per component, rounded."""
    return df.select("vec_id", F.posexplode(col).alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x")
    )


LISTED = "select vec_id, i, round(x, 6) + 0.0 as x from (select vec_id, unnest(range(len(r))) as i, unnest(r) as x from grown)"


@check(
    "e3_cosine_l2",
    f"""with {VECS} select a.vec_id, round(1 - list_cosine_similarity(a.v, b.v), 6) as distance, round(list_distance(a.v, b.v), 6) as l2,
        round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) as similarity
        from vecs a left join vecs b on b.vec_id = a.vec_id + 1""",
)
def _(spark, d):
    a = vecs(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    return a.join(b, "vec_id", "left").select(
        "vec_id",
        F.round(V.cosine_distance(v, w), 6).alias("distance"),
        F.round(V.l2(v, w), 6).alias("l2"),
        F.round(V.similarity(v, w), 6).alias("similarity"),
    )


@check("e4_resize_truncate", f"with {VECS}, grown as (select vec_id, v[1:48] as r from vecs) {LISTED}")
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 48)))


@check(
    "e5_resize_pad",
    f"with {VECS}, grown as (select vec_id, list_concat(v, list_transform(range(100 - d), lambda i: 0.0::double)) as r from vecs) {LISTED}",
)
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 100, "pad")))


NORM = "sqrt(list_dot_product({0}, {0}))"


@check(
    "e6_resize_redistribute",
    f"""with {VECS}, raw as (select vec_id, v, list_concat(v, list_transform(range(200 - d), lambda i: v[i % d + 1] * 0.5 / (1 + i // d))) as r from vecs),
    grown as (select vec_id, list_transform(r, lambda x: x * {NORM.format('v')} / {NORM.format('r')}) as r from raw) {LISTED}""",
)
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 200, "redistribute")))


@check(
    "e7_resize_dct",
    f"""with {VECS}, x as (select vec_id, d, unnest(range(d)) as i, unnest(v) as x from vecs),
    dots as (select vec_id, d, k, sum(x * cos(pi() * (2 * i + 1) * k / (2.0 * d))) as c
             from x join (select unnest(range(64)) as k) on true group by all),
    coeff as (select vec_id, k, c * sqrt(case when k = 0 then 1.0 else 2.0 end / d) as c from dots),
    back as (select vec_id, j, sum(c * sqrt((case when k = 0 then 1.0 else 2.0 end) / 96) * cos(pi() * (2 * j + 1) * k / 192.0)) as y
             from coeff join (select unnest(range(96)) as j) on true group by vec_id, j),
    size as (select vec_id, sqrt(sum(y * y)) as n from back group by all),
    own as (select vec_id, {NORM.format('v')} as n from vecs)
    select vec_id, j as i, round(y * own.n / size.n, 6) + 0.0 as x from back join size using (vec_id) join own using (vec_id)""",
)
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 96, "dct")))


# The fixed-seed matrix of the operator, spelled out for SQL: one list per target component.
GAUSSIAN = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in V._gaussian_map(64, 96).T) + "]"


@check(
    "e8_resize_linear",
    f"""with {VECS}, m as (select {GAUSSIAN}::double[][] as rows_),
    raw as (select vec_id, v, list_transform(rows_, lambda r: list_dot_product(v, r)) as r from vecs join m on true),
    grown as (select vec_id, list_transform(r, lambda x: x * {NORM.format('v')} / {NORM.format('r')}) as r from raw) {LISTED}""",
)
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 96, "linear")))


@check("e9_reduce_pca")
def _(spark, d):
    return listed(Z.reduce_pca(vecs(spark, d), "v", 8), "reduced")


@check(
    "e10_projected_dots",
    f"""with {VECS} select a.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 as dot, round({NORM.format('a.v')}, 6) as size
        from vecs a join vecs b on b.vec_id = a.vec_id + 1""",
)
def _(spark, d):
    """Growing by an orthogonal projection keeps dot products and lengths."""
    grown = vecs(spark, d).withColumn("v", V.project_orthogonal(F.col("v"), 128)).select("vec_id", "v")
    nxt = grown.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return grown.join(nxt, "vec_id").select(
        "vec_id", (F.round(V.dot(F.col("v"), F.col("w")), 6) + 0.0).alias("dot"), F.round(V.norm(F.col("v")), 6).alias("size")
    )


@check("e10_project_orthogonal")
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.project_orthogonal(F.col("v"), 128)))


@check(
    "e11_resize_decay",
    f"""with {VECS}, raw as (select vec_id, list_transform(range(150), lambda i: v[i % d + 1] * pow(0.5, i // d)) as r from vecs),
    grown as (select vec_id, list_transform(r, lambda x: x / {NORM.format('r')}) as r from raw) {LISTED}""",
)
def _(spark, d):
    return listed(vecs(spark, d).withColumn("v", V.resize(F.col("v"), 150, "decay")))


@check(
    "e12_choose_method",
    """with r as (select distinct p_size * 16 as src, (p_partkey % 12 + 1) * 64 as tgt from part),
    s as (select *, tgt / src::double as q from r),
    m as (select *, 0.5 * (case when q <= 2 then 0.9 else 0.3 end) + 0.3 * 0.9 + 0.2 * 0.8 as a,
      0.5 * (case when q > 2 and q <= 4 then 0.8 else 0.4 end) + 0.3 * 0.6 + 0.2 * 0.9 as b,
      0.5 * (case when q > 4 then 0.9 else 0.6 end) + 0.3 * 0.7 + 0.2 * 0.95 as c,
      0.5 * (case when q < 0.5 then 0.9 else 0.2 end) + 0.3 * 0.9 + 0.2 * 0.7 as e from s)
    select src, tgt, case greatest(a, b, c, e) when a then 'linear' when b then 'dct' when c then 'weighted' else 'pca' end as method from m""",
)
def _(spark, d):
    pairs = load(spark, d, "part").select(
        (F.col("p_size") * 16).alias("src"), ((F.col("p_partkey") % 12 + 1) * 64).alias("tgt")
    ).distinct()
    return pairs.select("src", "tgt", Z.choose_method(F.col("src"), F.col("tgt")).alias("method"))


@check(
    "e13_cosine_drift",
    f"""with {VECS}, p as (select a.vec_id, a.v as x, b.v as y from vecs a join vecs b on b.vec_id = a.vec_id + 1)
    select 'truncate' as method, round(avg(abs(list_cosine_similarity(x, y) - list_cosine_similarity(x[1:32], y[1:32]))), 6) as drift, count(*) as pairs from p""",
)
def _(spark, d):
    before = vecs(spark, d).select("vec_id", F.col("v").alias("vector"))
    after = before.withColumn("vector", V.resize_truncate(F.col("vector"), 32))
    drift = Z.cosine_drift(before, after)
    return drift.select(F.lit("truncate").alias("method"), F.round("drift", 6).alias("drift"), "pairs")


@check(
    "e13_sampled_drift",
    f"""with {VECS}, n as (select vec_id, v, row_number() over (order by md5('11:' || vec_id), vec_id) - 1 as i, count(*) over () as n from vecs),
    p as (select a.vec_id, abs(list_cosine_similarity(a.v, b.v) - list_cosine_similarity(a.v[1:32], b.v[1:32])) as change
      from n a join (select unnest(range(1, 5)) as o) on true join n b on b.i = (a.i + o) % a.n where o < a.n),
    m as (select vec_id, avg(change) as own from p group by vec_id)
    select (select round(avg(change), 6) from p) as drift, (select round(2 * stddev_samp(own) / sqrt(count(*)), 6) from m) as error,
      (select count(*) from p) as pairs""",
)
def _(spark, d):
    before = vecs(spark, d).select("vec_id", F.col("v").alias("vector"))
    after = before.withColumn("vector", V.resize_truncate(F.col("vector"), 32))
    drift = D.sampled_drift(before, after, partners=4, seed=11)
    return drift.select(F.round("drift", 6).alias("drift"), F.round("error", 6).alias("error"), "pairs")


# One row per method and size: how well resizing kept each vector's similarity to the next.
STUDY = f"""{VECS}, p as (select a.v as x, b.v as y from vecs a join vecs b on b.vec_id = a.vec_id + 1),
kept as (
  select 'truncate' as method, t, abs(list_cosine_similarity(x, y) - list_cosine_similarity(x[1:t], y[1:t])) as change from p join (select unnest([16, 32, 48, 64]) as t) on true
  union all
  select 'pad', t, abs(list_cosine_similarity(x, y) - list_cosine_similarity(list_resize(x, t, 0.0), list_resize(y, t, 0.0))) from p join (select unnest([80, 96, 128]) as t) on true
  union all
  select 'decay', t, abs(list_cosine_similarity(x, y) - list_cosine_similarity(
    list_transform(range(t), lambda i: x[i % 64 + 1] * pow(0.5, i // 64)), list_transform(range(t), lambda i: y[i % 64 + 1] * pow(0.5, i // 64))))
  from p join (select unnest([80, 96, 128]) as t) on true),
study as (select method, t / 64.0::double as ratio, round(1 - avg(change), 6) as preservation from kept group by method, t)"""


def study(spark, d):
    before = vecs(spark, d).select("vec_id", F.col("v").alias("vector"))
    out = None
    for name, sizes in {"truncate": (16, 32, 48, 64), "pad": (80, 96, 128), "decay": (80, 96, 128)}.items():
        for t in sizes:
            resized = V.resize_truncate(F.col("vector"), t) if name == "truncate" else V.resize(F.col("vector"), t, name)
            row = Z.cosine_drift(before, before.withColumn("vector", resized)).select(
                F.lit(name).alias("method"), F.lit(t / 64.0).alias("ratio"), F.round(1 - F.col("drift"), 6).alias("preservation")
            )
            out = row if out is None else out.unionByName(row)
    return out


@check(
    "e14_best_per_method",
    f"""with {STUDY} select method, arg_max(ratio, {{'p': preservation, 'r': -ratio}}) as best_ratio, max(preservation) as best_preservation
    from study group by method""",
)
def _(spark, d):
    return Z.best_per_method(study(spark, d))


@check(
    "e15_method_distribution",
    """with s as (select (p_partkey % 12 + 1) * 64 / (p_size * 16)::double as q from part),
    m as (select 0.5 * (case when q <= 2 then 0.9 else 0.3 end) + 0.3 * 0.9 + 0.2 * 0.8 as a,
      0.5 * (case when q > 2 and q <= 4 then 0.8 else 0.4 end) + 0.3 * 0.6 + 0.2 * 0.9 as b,
      0.5 * (case when q > 4 then 0.9 else 0.6 end) + 0.3 * 0.7 + 0.2 * 0.95 as c,
      0.5 * (case when q < 0.5 then 0.9 else 0.2 end) + 0.3 * 0.9 + 0.2 * 0.7 as e from s),
    d as (select case greatest(a, b, c, e) when a then 'linear' when b then 'dct' when c then 'weighted' else 'pca' end as method from m)
    select method, count(*) as selections, round(count(*) / sum(count(*)) over (), 6) as share from d group by method""",
)
def _(spark, d):
    chosen = Z.choose_method(F.col("p_size") * 16, (F.col("p_partkey") % 12 + 1) * 64)
    rows = load(spark, d, "part").select(chosen.alias("method"))
    return Z.method_distribution(rows).withColumn("share", F.round("share", 6))


PENDING = """pending as (select doc_id as chunk_id, doc_id // 4 as document_id, text from documents d
  where not exists (select 1 from embeddings e where e.vec_id = d.doc_id))"""


@check("e16_pending_chunks", f"with {PENDING} select chunk_id, document_id from pending where exists (select 1 from labels l where l.doc_id = chunk_id)")
def _(spark, d):
    ids = load(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return L.pending_chunks(tables.chunks(spark, d), ids=ids).select("chunk_id", "document_id")


@check(
    "e17_fill_embeddings",
    """select doc_id as chunk_id, round(coalesce(e.embedding[1]::double, case when n_chars % 2 = 0 then n_chars / 1000.0::double end), 6) as first,
       coalesce(len(e.embedding), case when n_chars % 2 = 0 then 2 end)::bigint as size, e.embedding is not null or n_chars % 2 = 0 as is_done
       from documents left join embeddings e on e.vec_id = doc_id""",
)
def _(spark, d):
    new = (
        load(spark, d, "documents")
        .filter("n_chars % 2 = 0")
        .select(F.col("doc_id").alias("chunk_id"), F.array(F.col("n_chars") / 1000.0, F.lit(1.0)).alias("embedding"))
    )
    return L.fill_embeddings(tables.chunks(spark, d), new).select(
        "chunk_id",
        F.round(F.get("embedding", F.lit(0)), 6).alias("first"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("size"),
        "is_done",
    )


