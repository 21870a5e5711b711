"""Queries of the training-data operators with their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from critica.llm import (bit_sliced, chat_examples, html_blocks, lexical, line_templates, nbest, near_dup, packing, phrases,
                         prefix_counts, quality_rules, token_files, url_trees)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 512

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_sum_of_squares_packing")
def q_packing(spark, sf_dir):
    return packing.packed_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, capacity=1024).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op2_simple8b_token_files")
def q_token_files(spark, sf_dir):
    return token_files.token_files(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op3_line_templates")
def q_line_templates(spark, sf_dir):
    return line_templates.drop_recurring(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"),
        F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))


@register("op4_url_trees")
def q_url_trees(spark, sf_dir):
    return url_trees.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "block_probability")


@register("op5_prefix_token_counts")
def q_prefix_counts(spark, sf_dir):
    counts = prefix_counts.prefix_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return prefix_counts.answer_budgets(counts, LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "chars_in_budget")


@register("op6_minhash_near_duplicates", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
         THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x
""")
def q_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@register("op7_nbest_pieces")
def q_nbest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("_text_crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    coded = nbest.encode_nbest(docs, PIECE_BPE, n=2, carry=("_text_crc",)).withColumn("ids_crc32", F.crc32("ids"))
    return nbest.decode(coded, PIECE_BPE).select(
        "doc_id", "rank", "score", "n_pieces", "ids_crc32",
        (F.crc32(F.encode("decoded", "utf-8")) == F.col("_text_crc")).alias("round_trip"))


_STOPS = ", ".join("'" + w + "'" for w in quality_rules.STOP_WORDS)


@register("op8_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE c >= 2)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, len(ls) AS n_lines,
         length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([STOPS], x))) AS stops,
         len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS lettered,
         len(list_filter(ls, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^[-*•‣▪◦]'))) AS bullets,
         len(list_filter(ls, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(\.\.\.|…)$'))) AS ellipses
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 3 AND 10 AND n_symbols::DOUBLE / n_words <= 0.1::DOUBLE
       AND lettered::DOUBLE / n_words >= 0.8::DOUBLE AND stops::DOUBLE / n_words >= 0.02::DOUBLE
       AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.5::DOUBLE, true)
       AND coalesce(bullets::DOUBLE / nullif(n_lines, 0) <= 0.9::DOUBLE, true)
       AND coalesce(ellipses::DOUBLE / nullif(n_lines, 0) <= 0.3::DOUBLE, true) AS kept
FROM f
""".replace("STOPS", _STOPS))
def q_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept")


@register("op9_bit_sliced_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def q_top_k(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(table.where(F.pmod("vec_id", F.lit(50)) == 0), table, k=5)


@register("op10_lstm_main_text")
def q_main_text(spark, sf_dir):
    return html_blocks.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register("op11_son_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n, (1000 * x.a * n.n) // (l.f * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1:x.k], ' ') JOIN n ON n.lang = x.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nr FROM scored),
lengths AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS length FROM c WHERE k > 2),
places AS (SELECT lang, a, ws, length, unnest(range(1, k - length + 2)) AS i FROM lengths),
longer AS (SELECT lang, array_to_string(ws[i:i + length - 1], ' ') AS phrase, max(a) AS most FROM places GROUP BY ALL),
alone AS (
  SELECT x.* FROM lowest x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE x.nr = 1 AND (y.most IS NULL OR y.most < x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
""")
def q_collocations(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def _escaped(column: str) -> str:
    """SQL of a text in the chat template."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for mark in chat_examples.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


@register("op12_prefix_target_chat", """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
             count(*) OVER (PARTITION BY conv_id) AS n, length(ROLE) + length(TEXT) + 22 AS chars FROM c),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("ROLE", _escaped("role")).replace("TEXT", _escaped("text")))
def q_chat(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], turns.schema)
    return chat_examples.read_back(chat_examples.prefix_examples(turns.unionByName(extra)))


@register("op13_shared_lexical_search", r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
c AS (SELECT count(*) AS big_n, sum(len(ts)) AS big_l FROM d WHERE len(ts) > 0),
tf AS (SELECT id, len(ts) AS n, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (
  SELECT q.item_id, tf.id AS doc_id, sum(q.times * df.w * ((1000000000 * tf.tf)
         // (1000 * tf.tf + 8 * (25 + (75 * tf.n * c.big_n) // c.big_l))))::BIGINT AS score
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
""")
def q_lexical(spark, sf_dir):
    return lexical.rank_documents(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
