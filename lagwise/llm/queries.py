"""The thin registered queries of this subpackage over the given tables, and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table and derives digest columns from the
operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import load_coder
from .collocation import mine_collocations
from .conversation import damage, repair_all
from .exact_dedup import exact_dedup
from .html_crf import MAX_PAGES, extract_main, fit_html
from .ids import id_digests
from .mixing import mix_sources
from .ngram_join import ngram_join
from .piece_bpe import load_pieces
from .store import shared_path
from .substring_dedup import substring_dedup
from .topk_search import top_k
from .toxicity import held_out, labelled_model, score_toxicity
from .training_order import materialise_order
from .url_filter import judge_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOXIC = 0.7  #: score from which a document counts as toxic
#: Host, path prefix and decision of the production rules.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = labelled_model(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages: those whose url names the document that they show; its text is the page's main text."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = F.regexp_extract("url", r"/(\d+)(?:[./?#]|$)", 1).try_cast("long")
    ranked = pages.select("page_id", "html", number.alias("doc_id")).filter("doc_id is not null and html is not null")
    some = ranked.orderBy(F.xxhash64("page_id", F.lit("html")), "page_id").limit(MAX_PAGES)  # a bounded sample, so it may be broadcast
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("main"))
    model = fit_html(docs.join(F.broadcast(some), "doc_id"))
    return extract_main(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards go to the shared folder; the result says where each sequence lies and in which document it starts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = materialise_order(docs, shared_path(spark, "training-order"))
    return out.select("slot", "shard", "offset", F.col("id").alias("doc_id"), F.col("at").alias("start_byte"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: encode, then decode the ids."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return id_digests(docs, lambda: load_coder(path, pattern))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with seeded damage, repaired."""
    rows = _table(spark, sf_dir, "conversations")
    return repair_all(damage(rows), rows)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    return id_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: load_pieces(path))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html": op3_html,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_topk": op6_topk,
    "op7_training_order": op7_training_order,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentencepiece": op13_sentencepiece,
}

_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM documents),
f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM pieces, range(1, 5) AS sizes(size) WHERE len(w) >= size)
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM f WHERE f >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, min({'score': (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT, 'k': k, 'l': l.f, 'r': r.f}) AS cut
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  GROUP BY ALL),
covers AS (
  SELECT lang, phrase, max(a) AS cover
  FROM (SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM candidates, range(2, 4) AS parts(m) WHERE m < size)
  GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, a DESC, encode(phrase)) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score
  FROM scored s LEFT JOIN covers USING (lang, phrase) JOIN n ON n.lang = s.lang WHERE cover IS NULL OR 100 * cover < 80 * a)
SELECT * FROM ranked WHERE rank <= 2000
"""

# CRC-32 bit by bit; then one step of the recursion per row of a conversation, a (cost, audit) per state.  No insertion is
# ever cheapest (deleting two rows costs less), so there is none.
_CONVERSATION_REPAIR = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
                         lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(2) AS copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS (
  SELECT *,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
         left(role, 1) AS initial
  FROM placed),
steps AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
         CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay
  FROM faults),
options AS (
  SELECT *, CASE WHEN initial = 's' THEN stay END AS cs, stay + (initial <> 'u')::INT AS cu, stay + (initial <> 'a')::INT AS ca,
         CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS lu, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS la FROM steps),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': NULL::BIGINT, 'a': ''} AS s1, {'c': NULL::BIGINT, 'a': ''} AS s2, {'c': NULL::BIGINT, 'a': ''} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, o.i, {'c': s0.c + 2, 'a': s0.a || 'D'},
         coalesce(list_min(list_filter([{'c': s1.c + 2, 'a': s1.a || 'D'}, {'c': s0.c + cs, 'a': s0.a || 'K'}], lambda x: x.c IS NOT NULL)), {'c': NULL::BIGINT, 'a': ''}),
         coalesce(list_min(list_filter([{'c': s2.c + 2, 'a': s2.a || 'D'}, {'c': s0.c + cu, 'a': s0.a || lu}, {'c': s1.c + cu, 'a': s1.a || lu}, {'c': s3.c + cu, 'a': s3.a || lu}], lambda x: x.c IS NOT NULL)), {'c': NULL::BIGINT, 'a': ''}),
         coalesce(list_min(list_filter([{'c': s3.c + 2, 'a': s3.a || 'D'}, {'c': s2.c + ca, 'a': s2.a || la}], lambda x: x.c IS NOT NULL)), {'c': NULL::BIGINT, 'a': ''})
  FROM paths p JOIN options o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i + 1),
best AS (
  SELECT conv_id, list_min(list_filter([s0, s3], lambda x: x.c IS NOT NULL)) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM paths) WHERE back = 1),
stays AS (
  SELECT f.*, substr(b.a, f.i, 1) AS edit, row_number() OVER w AS j, (first_value(substr(b.a, f.i, 1) = 'K' AND initial = 's') OVER w)::INT AS odd
  FROM faults f JOIN best ON f.conv_id IS NOT DISTINCT FROM best.conv_id WHERE substr(b.a, f.i, 1) <> 'D' WINDOW w AS (PARTITION BY f.conv_id ORDER BY f.i)),
repaired AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i)) AS digest FROM stays GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || '>' || initial NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM steps GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.c AS cost, b.a AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM best.conv_id
"""

ORACLE: dict[str, str] = {
    "op5_exact_dedup": _EXACT_DEDUP,
    "op11_collocations": _COLLOCATIONS,
    "op12_conversation_repair": _CONVERSATION_REPAIR,
}
