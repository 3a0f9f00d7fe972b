"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.chat_format import format_conversations, read_back
from ledgerloom.llm.common import read, tokenizer_file
from ledgerloom.llm.decontaminate import contaminated
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.html_text import extract_pages
from ledgerloom.llm.lexical_search import top_k
from ledgerloom.llm.line_dedup import line_dedup
from ledgerloom.llm.lm_score import score_documents
from ledgerloom.llm.ngram_join import near_duplicates
from ledgerloom.llm.periodic_runs import periodic_runs
from ledgerloom.llm.quality import score, train
from ledgerloom.llm.token_counts import token_counts
from ledgerloom.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: Links and components of 5-word shingles, on a table ``{docs}``.
COMPONENTS_SQL = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM {docs}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


@query(
    "op1_ngram_join",
    "WITH RECURSIVE "
    + COMPONENTS_SQL.format(docs="documents")
    + " SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN component USING (doc_id)",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read(spark, sf, "documents"))


@query("op2_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(read(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


@query(
    "op3_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT y.doc_id, y.pos, y.line, h.k IS NOT NULL AND y.doc_id <> h.keeper AS lost
  FROM keyed y LEFT JOIN hot h ON y.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup(read(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_lm_score")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(read(spark, sf, "documents"))


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return score(docs, train(docs, read(spark, sf, "labels")))


@query("op6_warc")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return archive_pages(read(spark, sf, "pages")).drop("url", "html")


@query("op7_decontamination")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(read(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query(
    "op9_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(read(spark, sf, "documents"))


@query("op10_html_text")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(read(spark, sf, "pages"))


@query(
    "op11_chat_format",
    r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, length('### : </turn>' || chr(10)) + length(role) + len(regexp_extract_all(role, '[\\:]'))
            + length(text) + len(regexp_extract_all(text, '\\|</turn>'))
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars
  FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    forged = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    return read_back(format_conversations(rows), ordered=True)


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The places whose words take the places of the n words, for the ids that have them repeated."""
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs(read(spark, sf, "documents"), places=planted, with_texts=False)


@query(
    "op13_lexical_search",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs),
held AS (SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, len(t) AS n, unnest(t) AS t FROM docs) GROUP BY ALL),
wanted AS (
  SELECT DISTINCT i, item_id, t FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY t, n_docs),
scores AS (
  SELECT i, item_id, d, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN held USING (t) JOIN weights USING (t), total GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
