"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from docweave.functions.keywords import VIETNAMESE
from docweave.functions.text import CLEAN_DROP, NOT_WORD_OR_SPACE, WHITESPACE, WORD_TOKEN, WS


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
STOP = "(" + ", ".join(text_literal(w) for w in VIETNAMESE) + ")"
# Marks cut points on this side; the tables hold no such character.
SENTINEL = "chr(57344)"
WS_RE = WS
DROP_RE = text_literal(CLEAN_DROP)
# Letters of either case, in this dialect's own way: its (?i) folds all letters.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]*"
HEADINGS = "điều|chương|mục|phần|phụ lục|article|section|part|appendix"
MARK_RE = text_literal(rf"(?i)^{BLANK}({HEADINGS})?{BLANK}([0-9]+\.)+([0-9]+)?{BLANK}\.?{BLANK}$")
NORM_RE = text_literal(NOT_WORD_OR_SPACE)
TOKEN_RE = text_literal(WORD_TOKEN)


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def clean(x: str) -> str:
    spaced = f"regexp_replace({x}, '{WS_RE}+', ' ', 'g')"
    return strip(f"regexp_replace({spaced}, {DROP_RE}, '', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_RE}+'), lambda w: w <> '')"


def keyword_list(x: str, min_len: int = 3, limit: int = 10) -> str:
    kept = f"list_filter({words(f'lower({x})')}, lambda w: length(w) > {min_len} and w not in {STOP})"
    first = f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"
    return f"{first}[1:{limit}]"


def keyword_rows(table: str, key: str, text: str, min_len: int = 3, limit: int = 10) -> str:
    """CTEs keyword_words (key, w, n) and keyword_lists (key, keywords joined by '|')."""
    return f"""keyword_words as (
  select {key}, w, row_number() over (partition by {key} order by min(i)) as n from (
    select {key}, unnest(ws) as w, unnest(range(len(ws))) as i from (select {key}, {words(f'lower({text})')} as ws from {table}))
  where length(w) > {min_len} and w not in {STOP} group by {key}, w qualify n <= {limit}),
keyword_lists as (select {key}, string_agg(w, '|' order by n) as keywords from keyword_words group by {key})"""


def html_text(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        out = f"replace({out}, '{entity}', '{char}')"
    return strip(f"regexp_replace({out}, '{WS_RE}+', ' ', 'g')")


def normalized(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, {NORM_RE}, '', 'g')"


# (doc_id, pos, sentence): sentences as cut, pos 0-based
RAW_SENTENCES = f"""raw_sentences as (
  select doc_id, pos - 1 as pos, parts[pos] as sentence from (
    select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos from (
      select doc_id, string_split(regexp_replace(text, '([.!?]){WS_RE}+', '\\1' || {SENTINEL}, 'g'), {SENTINEL}) as parts
      from documents)))"""

# (doc_id, pos, sentence): long enough, cleaned, no markers, renumbered
SENTENCES = f"""{RAW_SENTENCES},
sentences as (
  select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, sentence from (
    select doc_id, pos, {clean('sentence')} as sentence from raw_sentences
    where length({strip('sentence')}) > 4)
  where not regexp_matches(sentence, {MARK_RE}))"""

# (doc_id, pos, token, w): TF-IDF weights per document, length 1 per sentence
TFIDF = f"""{SENTENCES},
token_rows as (
  select doc_id, pos, unnest(regexp_extract_all(lower(sentence), {TOKEN_RE})) as token from sentences),
tf as (select doc_id, pos, token, count(*) as tf from token_rows group by all),
df as (select doc_id, token, count(*) as df from tf group by all),
sizes as (select doc_id, count(*) as n from sentences group by all),
raw_weights as (
  select tf.doc_id, pos, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w
  from tf join df using (doc_id, token) join sizes using (doc_id)),
weights as (
  select doc_id, pos, token, w / sqrt(sum(w * w) over (partition by doc_id, pos)) as w from raw_weights)"""

CHUNKS = """chunks as (
  select d.doc_id as chunk_id, d.doc_id // 4 as document_id, d.text as chunk_text,
         e.embedding::double[] as embedding, e.label, coalesce(l.toxic, 0) = 1 as is_deleted
  from documents d left join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id)"""

DOCS = """docs as (
  select d.doc_id // 4 as document_id, min(source) as kb_id, bool_and(coalesce(quality, 1) = 1) as status,
         'doc_' || (d.doc_id // 4) as name
  from documents d left join labels l on l.doc_id = d.doc_id group by d.doc_id // 4)"""

ASKED = f"""asked as (
  select b.item_id as query_id, b.text as query_text, {keyword_list('b.text')} as keywords,
         e.embedding::double[] as vector, docs.kb_id, docs.document_id
  from benchmark b join embeddings e on e.vec_id = b.item_id join docs on docs.document_id = b.item_id // 4)"""

STORE = f"{CHUNKS},\n{DOCS},\n{ASKED}"
