"""The registered queries of this subpackage, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docweave.llm import oracles
from docweave.llm.bpe import encode_and_decode
from docweave.llm.fingerprints import fingerprint_documents
from docweave.llm.html import extract_pages
from docweave.llm.kdtree import exact_top_k
from docweave.llm.lines import dedupe_lines
from docweave.llm.lm import score_documents
from docweave.llm.merkle import document_manifest
from docweave.llm.near import near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.phrases import mine_phrases
from docweave.llm.quality import grade_documents
from docweave.llm.token_files import read_token_shards, write_token_shards
from docweave.llm.url_filters import host_of, judge_urls
from docweave.session import scratch_path
from docweave.sources.readers import load

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_document_fingerprints")
def _(spark, d):
    return fingerprint_documents(load(spark, d, "documents"))


@query("op4_exact_top_k")
def _(spark, d):
    return exact_top_k(load(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_bpe_round_trip")
def _(spark, d):
    return encode_and_decode(load(spark, d, "documents"), WORD_BPE)


@query("op6_token_shards")
def _(spark, d):
    target = scratch_path(spark, "token-shards")
    write_token_shards(load(spark, d, "documents"), target, WORD_BPE)
    return read_token_shards(spark, target)


@query("op7_html_main_text")
def _(spark, d):
    return extract_pages(load(spark, d, "pages"))


@query("op8_best_fit_packing")
def _(spark, d):
    return pack_documents(load(spark, d, "documents"))


@query("op2_line_dedup")
def _(spark, d):
    return dedupe_lines(load(spark, d, "documents"))


@query("op3_quality_grades")
def _(spark, d):
    return grade_documents(load(spark, d, "documents"), load(spark, d, "labels"))


@query("op9_minhash_near_dedup")
def _(spark, d):
    return near_duplicates(load(spark, d, "documents"), k=4)


@query("op10_lm_scores")
def _(spark, d):
    return score_documents(load(spark, d, "documents"))


@query("op11_merkle_manifest", oracles.MERKLE)
def _(spark, d):
    return document_manifest(load(spark, d, "documents"))


# Rules (verdict, host, path) of the query, and the names of the hosts whose URLs make up its list.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = "ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm"


@query("op12_url_filters", oracles.URLS)
def _(spark, d):
    pages = load(spark, d, "pages")
    listed = pages.where(host_of(F.col("url")).rlike(rf"(^|\.)({LISTED_HOSTS})\.")).select("url")
    return judge_urls(pages, listed, URL_RULES)


@query("op13_phrase_mining", oracles.PHRASES)
def _(spark, d):
    return mine_phrases(load(spark, d, "documents"))
