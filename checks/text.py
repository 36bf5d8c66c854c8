"""Sources, text preparation and keywords."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import registrar
from docweave.functions import keywords as K
from docweave.functions import text as T
from docweave.operators import sentences as S
from docweave.session import scratch_path
from docweave.sources import readers, writers
from docweave.sources.readers import load, load_texts

QUERIES, ORACLES = {}, {}
check = registrar(QUERIES, ORACLES)


def docs(spark, d):
    return load_texts(spark, d, "documents")


@check("s1_load", "select doc_id, lang, source, n_chars from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars")


@check("s2_read_text_files", "select line from (select unnest(string_split(text, chr(10))) as line from documents) where line <> ''")
def _(spark, d):
    path = scratch_path(spark, "texts")
    docs(spark, d).select("text").write.text(path)
    files = readers.read_text_files(spark, path)
    return files.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


@check(
    "s3_table_to_text",
    """select c_custkey, concat_ws(' ', c_custkey::varchar, c_name, c_nationkey::varchar, c_mktsegment) as line
       from customer""",
)
def _(spark, d):
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return readers.table_to_text(load(spark, d, "customer"), cols).select("c_custkey", "line")


@check(
    "s4_read_json_records",
    """select 'array' as kind, item_id, text from benchmark union all select 'lines' as kind, item_id, text from benchmark
       union all select 'array' as kind, doc_id as item_id, text from documents""",
)
def _(spark, d):
    records = load(spark, d, "benchmark").select("item_id", "text")
    lines, arrays = scratch_path(spark, "records"), scratch_path(spark, "arrays")
    writers.write_results(records, lines)
    writers.write_json_arrays(records.union(load(spark, d, "documents").select("doc_id", "text")), arrays)
    schema = "item_id long, text string"
    read = readers.read_json_records(spark, arrays, schema).withColumn("kind", F.lit("array"))
    return read.unionByName(readers.read_json_records(spark, lines, schema, lines=True).withColumn("kind", F.lit("lines")))


@check(
    "s5_write_chunks",
    f"""with {Q.keyword_rows('documents', 'doc_id', 'text')}
        select doc_id as document_id, text as chunk_text, coalesce(keywords, '') as keywords,
               null::varchar as config_id, true as pending from documents left join keyword_lists using (doc_id)""",
)
def _(spark, d):
    path = scratch_path(spark, "chunks")
    made = docs(spark, d).select(
        F.col("doc_id").alias("document_id"),
        F.col("text").alias("chunk_text"),
        K.keywords(F.col("text")).alias("keywords"),
    )
    writers.write_chunks(made, path)
    return spark.read.parquet(path).select(
        "document_id",
        "chunk_text",
        F.array_join("keywords", "|").alias("keywords"),
        "config_id",
        F.col("embedding").isNull().alias("pending"),
    )


@check("s6_write_results", "select s_suppkey, s_name, s_nationkey from supplier")
def _(spark, d):
    path = scratch_path(spark, "results")
    writers.write_results(load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "csv")
    return spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_nationkey int")


@check(
    "s7_pack_metadata",
    """select doc_id, json_object('lang', lang, 'source', source, 'n_chars', n_chars, 'quality', quality)::varchar as metadata
       from documents left join labels using (doc_id)""",
)
def _(spark, d):
    rows = docs(spark, d).join(load(spark, d, "labels"), "doc_id", "left")
    return writers.pack_metadata(rows, ["lang", "source", "n_chars", "quality"]).select("doc_id", "metadata")


@check(
    "s8_assign_batches",
    "select event_id, (row_number() over (order by event_id) - 1) // 64 as batch from events",
)
def _(spark, d):
    return writers.assign_batches(load(spark, d, "events").select("event_id"), 64, "event_id")


@check(
    "s8_batches_by_hash",
    "select event_id, (row_number() over (order by ts, event_id) - 1) // 64 as batch from (select event_id, md5(event_id::varchar) as ts from events)",
)
def _(spark, d):
    rows = load(spark, d, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("key"))
    return writers.assign_batches(rows, 64, "key").select("event_id", "batch")


@check("t1_split_sentences", f"with {Q.RAW_SENTENCES} select doc_id, pos, sentence from raw_sentences")
def _(spark, d):
    return S.split_sentences(docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@check("t2_clean_text", f"select doc_id, {Q.clean('text')} as cleaned from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@check(
    "t3_filter_short",
    f"""with {Q.RAW_SENTENCES} select doc_id, pos, sentence from raw_sentences
        where length({Q.strip('sentence')}) > 4""",
)
def _(spark, d):
    return S.filter_short(S.split_sentences(docs(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@check(
    "t4_filter_markers",
    f"""with {Q.RAW_SENTENCES} select doc_id, pos, sentence from raw_sentences
        where not regexp_matches(sentence, {Q.MARK_RE})""",
)
def _(spark, d):
    return S.filter_markers(S.split_sentences(docs(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@check("t5_html_to_text", f"select page_id, {Q.html_text('html')} as content from pages")
def _(spark, d):
    return load_texts(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("content"))


def source_records(spark, d):
    """Source records with whichever of the content fields the language and source of a document give it."""
    pages = load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")

    def only(cond):
        return F.when(cond, F.col("text"))

    return (
        docs(spark, d)
        .join(pages, "doc_id", "left")
        .select(
            "doc_id",
            F.struct(
                F.struct(only(F.col("lang") == "fr").alias("text")).alias("summary"),
                only(F.col("lang") == "de").alias("full_text"),
                F.coalesce("html", only(F.col("lang") == "es")).alias("text"),
                only(F.col("source") == "src1").alias("story"),
                only(F.col("source") == "src2").alias("context"),
            ).alias("document"),
            F.struct(
                only(F.col("source") == "src3").alias("text"),
                only(F.col("source") == "src4").alias("story"),
                only(F.col("source") == "src5").alias("context"),
            ).alias("top"),
        )
    )


SOURCE_RECORDS = """records as (
  select doc_id, lang, source, text as whole, coalesce(html, case when lang = 'es' then text end) as body
  from documents left join (select page_id as doc_id, html from pages) using (doc_id))"""


@check(
    "t6_best_content",
    f"""with {SOURCE_RECORDS}, cleaned as (select *, {Q.html_text('body')} as clean from records),
    labelled as (select *, case
      when lang = 'fr' then 'summary.text' when lang = 'de' then 'full_text'
      when body like '%<%' and body like '%>%' and length(clean) > 100 then 'text (cleaned HTML)'
      when body like '%<%' and body like '%>%' then 'text (HTML, too short after cleaning)'
      when body is not null then 'text' when source = 'src1' then 'story' when source = 'src2' then 'context'
      when source = 'src3' then 'text (fallback)' when source = 'src4' then 'story (fallback)'
      when source = 'src5' then 'context (fallback)' else 'none' end as origin from cleaned)
    select doc_id, origin, case
      when origin = 'text (cleaned HTML)' then clean when origin = 'text' then body
      when origin in ('none', 'text (HTML, too short after cleaning)') then null else whole end as content
    from labelled""",
)
def _(spark, d):
    best = T.best_content(F.col("document"), F.col("top"))
    return source_records(spark, d).select("doc_id", best.alias("best")).select(
        "doc_id", F.col("best.source").alias("origin"), F.col("best.text").alias("content")
    )


@check("t7_normalize_answer", f"select conv_id, turn, {Q.normalized('text')} as answer from conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("answer"))


@check(
    "t8_clean_name",
    """with a as (select page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.-]', '', 'g'), '\\.{2,}', '.', 'g') as n from pages),
    b as (select page_id, regexp_replace(n, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g') as n from a)
    select page_id, case when length(n) between 3 and 63 then n end as name from b""",
)
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.clean_name(F.col("url")).alias("name"))


@check(
    "t9_split_paragraphs",
    f"""select doc_id, unnest(range(len(p))) as pos, unnest(p) as paragraph from (
      select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '') as p
      from documents)""",
)
def _(spark, d):
    return S.split_paragraphs(docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@check(
    "t10_content_gate",
    f"""select doc_id, case when length({Q.strip('text')}) = 0 then 'empty' when length({Q.strip('text')}) < 100
        then 'needs_ocr' else 'ok' end as gate from documents""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", T.content_gate(F.col("text")).alias("gate"))


@check(
    "t11_word_count",
    f"""select doc_id, coalesce(case when quality = 1 then n_chars end, len({Q.words('text')})) as n_words
        from documents left join labels using (doc_id)""",
)
def _(spark, d):
    rows = docs(spark, d).join(load(spark, d, "labels"), "doc_id", "left")
    known = F.when(F.col("quality") == 1, F.col("n_chars"))
    return rows.select("doc_id", T.word_count(F.col("text"), known).alias("n_words"))


@check("t12_truncate", "select doc_id, substring(text, 1, 15000) as input from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.truncate(F.col("text"), 15000).alias("input"))


@check("t13_safe_id", """select page_id, regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g') as file_id from pages""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("file_id"))


@check(
    "k1_keywords",
    f"""with {Q.keyword_rows('documents', 'doc_id', 'text')}
        select doc_id, coalesce(keywords, '') as keywords from documents left join keyword_lists using (doc_id)""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(K.keywords(F.col("text")), "|").alias("keywords"))


# Tags stand in for a tagger's output: every word gets one by its length.
TAGS = ["N", "V", "Np", "A", "Nc"]


def tagged_words(col):
    names = F.array(*[F.lit(t) for t in TAGS])
    return F.transform(
        T.words(col), lambda w: F.struct(w.alias("word"), F.get(names, F.length(w) % len(TAGS)).alias("tag"))
    )


@check(
    "k2_select_tagged",
    f"""with w as (select conv_id, turn, list_transform(list_filter({Q.words('text')}, lambda w: length(w) % 5 in (0, 2, 4)),
          lambda w: lower(w)) as nouns from conversations),
    k as (select conv_id, turn, list_filter(nouns, lambda w: length(w) > 2 and w not in {Q.STOP}) as nouns from w)
    select conv_id, turn, array_to_string(list_filter(nouns, lambda w, i: list_position(nouns, w) = i)[1:20], '|') as nouns
    from k""",
)
def _(spark, d):
    picked = K.select_tagged(tagged_words(F.col("text")))
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(picked, "|").alias("nouns"))


@check(
    "k3_parse_keyword_lines",
    f"""select conv_id, turn, array_to_string(list_filter(list_transform(string_split('Từ khóa:' || chr(10) || text, chr(10)),
        lambda x: {Q.strip('x')}), lambda x: x <> '' and x <> 'Từ khóa:'), '|') as phrases from conversations""",
)
def _(spark, d):
    reply = F.concat(F.lit(K.REPLY_HEADER + "\n"), F.col("text"))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(K.parse_keyword_lines(reply), "|").alias("phrases")
    )


@check(
    "k4_stop_words",
    f"""select doc_id, len(list_filter({Q.words('lower(text)')}, lambda w: w not in
        ('the', 'and', 'of', 'to', 'in') )) as kept from documents where lang = 'en'
        union all select doc_id, len(list_filter({Q.words('lower(text)')}, lambda w: w not in {Q.STOP})) as kept
        from documents where lang <> 'en'""",
)
def _(spark, d):
    lists = {"en": ["the", "and", "of", "to", "in"]}
    lowered = T.words(F.lower(F.col("text")))
    english = F.filter(lowered, lambda w: ~w.isin(K.stop_words("en", lists)))
    other = F.filter(lowered, lambda w: ~w.isin(K.stop_words("vi")))
    kept = F.when(F.col("lang") == "en", F.size(english)).otherwise(F.size(other))
    return docs(spark, d).select("doc_id", kept.cast("long").alias("kept"))
