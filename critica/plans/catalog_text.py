"""Registered text-feature, similarity and summary queries (§7.6 rows 6-7, 11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from critica.functions import prompts as P
from critica.functions import text as TX
from critica.functions import vectors as V
from critica.plans.sql_twins import chunk_by_budget_sql, detect_language_sql
from critica.operators import aggregates as AG
from critica.operators import features as FE
from critica.operators import ranking as R
from critica.operators import routing as RT
from critica.operators import similarity as SI
from critica.operators import summarize as SU
from critica.plans.registry import r6, register
from critica.sources import testdata as TD

STOP = FE.default_stop_words()
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + "]"
TOKENS_SQL = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
WORDS_SQL = "len(regexp_extract_all({t}, '[^\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+'))"
SENTS_SQL = ("list_filter(list_transform(string_split(regexp_replace({t}, '([.!?\\x{{2026}}])\\s+', "
             "'\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)")

# Shared SQL: term counts, document frequencies, vocabulary per app.
_TF_SQL = TD.REVIEWS_SQL + f""",
toks AS (SELECT app, review_id, unnest({TOKENS_SQL.format(t='data')}) AS term FROM reviews),
tf AS (SELECT app, review_id, term, count(*) AS tf FROM toks WHERE NOT list_contains({STOP_SQL}, term)
       GROUP BY app, review_id, term),
nd AS (SELECT app, count(*) AS n_docs FROM reviews GROUP BY app),
dfq AS (SELECT app, term, count(*) AS df FROM tf GROUP BY app, term),
voc AS (SELECT d.app, d.term, d.df, n.n_docs FROM dfq d JOIN nd n ON d.app = n.app
        WHERE d.df >= 3 AND d.df <= CAST(0.5 AS DOUBLE) * n.n_docs)"""


@register("tokens_df", TD.with_views(_TF_SQL, """
SELECT app, term, CAST(df AS BIGINT) AS df, CAST(n_docs AS BIGINT) AS n_docs FROM voc"""))
def q_tokens_df(spark, sf):
    r = TD.reviews(spark, sf)
    tf = FE.term_counts(r, ["app"], stop_words=STOP)
    nd = r.groupBy("app").agg(F.count(F.lit(1)).alias("n_docs"))
    return FE.document_frequency(tf, ["app"], min_df=3, max_df=0.5, n_docs=nd).select("app", "term", "df", "n_docs")


@register("bow", TD.with_views(_TF_SQL, """
SELECT tf.app, tf.review_id, tf.term, CAST(tf.tf AS BIGINT) AS tf FROM tf JOIN voc ON tf.app = voc.app AND tf.term = voc.term"""))
def q_bow(spark, sf):
    return FE.bow(TD.reviews(spark, sf), ["app"], stop_words=STOP).select("app", "review_id", "term", "tf")


@register("tfidf", TD.with_views(_TF_SQL + """,
w AS (SELECT tf.app, tf.review_id, tf.term, tf.tf, voc.df,
             tf.tf * (ln((voc.n_docs + 1.0) / (voc.df + 1.0)) + 1.0) AS w
      FROM tf JOIN voc ON tf.app = voc.app AND tf.term = voc.term)""", """
SELECT app, review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY app, review_id)), 6) AS weight FROM w"""))
def q_tfidf(spark, sf):
    t = FE.tfidf(TD.reviews(spark, sf), ["app"], stop_words=STOP)
    return t.select("app", "review_id", "term", r6("weight").alias("weight"))


@register("word_counts", TD.with_views(TD.REVIEWS_SQL, f"""
SELECT review_id, CAST({WORDS_SQL.format(t='data')} AS INTEGER) AS n_words,
       CAST(len({SENTS_SQL.format(t='data')}) AS INTEGER) AS n_sentences FROM reviews"""))
def q_word_counts(spark, sf):
    r = TD.reviews(spark, sf)
    return r.select("review_id", TX.word_count("data").alias("n_words"),
                    F.size(TX.split_sentences("data")).alias("n_sentences"))


_SENT_SQL = TD.CLUSTERED_SQL + f""",
s0 AS (SELECT ori_lang, clusters, review_id, {SENTS_SQL.format(t='data')} AS l FROM clustered),
s1 AS (SELECT ori_lang, clusters, review_id, unnest(l) AS sentence,
              unnest(generate_series(0, len(l) - 1)) AS sent_id FROM s0),
sents AS (SELECT * FROM s1 WHERE {WORDS_SQL.format(t='sentence')} >= 5),
stoks AS (SELECT ori_lang, clusters, review_id, sent_id, unnest({TOKENS_SQL.format(t='sentence')}) AS term FROM sents),
stf AS (SELECT ori_lang, clusters, review_id, sent_id, term, CAST(count(*) AS DOUBLE) AS tf FROM stoks
        GROUP BY ori_lang, clusters, review_id, sent_id, term),
su AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY ori_lang, clusters, review_id, sent_id)) AS u FROM stf),
tot AS (SELECT ori_lang, clusters, term, sum(u) AS s FROM su GROUP BY ori_lang, clusters, term),
cent AS (SELECT su.ori_lang, su.clusters, su.review_id, su.sent_id, sum(su.u * tot.s) AS centrality
         FROM su JOIN tot ON su.ori_lang = tot.ori_lang AND su.clusters = tot.clusters AND su.term = tot.term
         GROUP BY su.ori_lang, su.clusters, su.review_id, su.sent_id),
sc AS (SELECT s.*, coalesce(c.centrality, 0.0) AS centrality FROM sents s LEFT JOIN cent c
       ON s.ori_lang = c.ori_lang AND s.clusters = c.clusters AND s.review_id = c.review_id AND s.sent_id = c.sent_id)"""


@register("sentences", TD.with_views(TD.REVIEWS_SQL + f""",
s0 AS (SELECT review_id, {SENTS_SQL.format(t='data')} AS l FROM reviews),
s1 AS (SELECT review_id, unnest(l) AS sentence, unnest(generate_series(0, len(l) - 1)) AS sent_id FROM s0)""", f"""
SELECT review_id, CAST(sent_id AS INTEGER) AS sent_id, md5(sentence) AS sentence_md5 FROM s1
WHERE {WORDS_SQL.format(t='sentence')} >= 5"""))
def q_sentences(spark, sf):
    s = SI.sentences(TD.reviews(spark, sf), ["ori_lang"])
    return s.select("review_id", "sent_id", F.md5("sentence").alias("sentence_md5"))


@register("sentence_centrality", TD.with_views(_SENT_SQL, """
SELECT ori_lang, clusters, review_id, CAST(sent_id AS INTEGER) AS sent_id, round(centrality, 6) AS centrality FROM sc"""))
def q_sentence_centrality(spark, sf):
    keys = ["ori_lang", "clusters"]
    c = SI.sentence_centrality(SI.sentences(TD.clustered(spark, sf), keys), keys)
    return c.select(*keys, "review_id", "sent_id", r6("centrality").alias("centrality"))


@register("extractive_summary", TD.with_views(_SENT_SQL, f"""
SELECT ori_lang, clusters, md5(sentence) AS summary_md5, round(round(centrality, 9), 6) AS centrality
FROM (SELECT *, row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY
             CASE WHEN {detect_language_sql('sentence', ['en', 'fr'])} = 'en' THEN 1 ELSE 0 END DESC,
             round(centrality, 9) DESC, review_id, sent_id) AS rk FROM sc) ranked
WHERE rk = 1"""))
def q_extractive_summary(spark, sf):
    keys = ["ori_lang", "clusters"]
    s = SU.extractive_summary(TD.clustered(spark, sf), keys)
    return s.select(*keys, F.md5("summary").alias("summary_md5"), r6("centrality").alias("centrality"))


_CENTROID_SQL = TD.CLUSTERED_SQL + """,
el AS (SELECT ori_lang, clusters, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM clustered),
cen AS (SELECT ori_lang, clusters, list(x ORDER BY pos) AS centroid FROM
          (SELECT ori_lang, clusters, pos, avg(x) AS x FROM el GROUP BY ori_lang, clusters, pos) t
        GROUP BY ori_lang, clusters),
sim AS (SELECT c.review_id, c.ori_lang, c.clusters,
          list_dot_product(c.embedding, m.centroid) / (sqrt(list_dot_product(c.embedding, c.embedding)) *
                                                       sqrt(list_dot_product(m.centroid, m.centroid))) AS similarity
        FROM clustered c JOIN cen m ON c.ori_lang = m.ori_lang AND c.clusters = m.clusters)"""


@register("cosine_to_centroid", TD.with_views(_CENTROID_SQL, """
SELECT review_id, ori_lang, clusters, round(similarity, 6) AS similarity FROM sim"""))
def q_cosine_to_centroid(spark, sf):
    c = TD.clustered(spark, sf)
    keys = ["ori_lang", "clusters"]
    s = SI.similarity_to_reference(c, SI.centroids(c, keys), keys)
    return s.select("review_id", *keys, r6("similarity").alias("similarity"))


@register("rank_reviews", TD.with_views(_CENTROID_SQL, """
SELECT review_id, ori_lang, clusters,
  CAST(row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY round(similarity, 9) DESC, review_id) AS BIGINT) AS review_rank
FROM sim"""))
def q_rank_reviews(spark, sf):
    c = TD.clustered(spark, sf)
    keys = ["ori_lang", "clusters"]
    s = SI.similarity_to_reference(c, SI.centroids(c, keys), keys).withColumn(
        "similarity", F.round("similarity", 9))
    return R.rank_reviews(s, keys).select("review_id", *keys, "review_rank")


# --------------------------------------------------------------------------
# Prompts and chunks

@register("classify_prompts", TD.with_views(TD.REVIEWS_SQL, f"""
SELECT review_id, md5(replace('{P.CLASSIFY_INSTRUCTION}', '{{lang}}', lang_name) || chr(10) || '```' || chr(10)
                      || data || chr(10) || '```') AS prompt_md5
FROM (SELECT *, coalesce(CASE ori_lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' END,
   CASE {detect_language_sql('data')} WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
        WHEN 'es' THEN 'Spanish' ELSE 'English' END) AS lang_name FROM reviews) t"""))
def q_classify_prompts(spark, sf):
    r = RT.language_name(TD.reviews(spark, sf))
    return r.select("review_id", F.md5(P.classify_prompt(F.col("lang_name"), F.col("data"))).alias("prompt_md5"))


_CHUNK_SQL = TD.CLUSTERED_SQL + f""",
items AS (SELECT ori_lang, clusters, review_id, data, {WORDS_SQL.format(t='data')} AS n_tokens FROM clustered),
""" + chunk_by_budget_sql("items", ["ori_lang", "clusters"], 2000)


@register("chunk_by_budget", "WITH RECURSIVE " + _CHUNK_SQL + """
SELECT ori_lang, clusters, review_id, CAST(chunk AS INTEGER) AS chunk FROM chunks""")
def q_chunk_by_budget(spark, sf):
    c = TD.clustered(spark, sf).withColumn("n_tokens", TX.token_count("data"))
    return SU.chunk_by_budget(c, ["ori_lang", "clusters"], 2000).select("ori_lang", "clusters", "review_id", "chunk")


@register("summary_prompts", "WITH RECURSIVE " + _CHUNK_SQL + f"""
SELECT i.ori_lang, i.clusters, CAST(c.chunk AS INTEGER) AS chunk, CAST(count(*) AS BIGINT) AS n_items,
  md5('{P.SUMMARY_INSTRUCTION}' || chr(10) || '```' || chr(10) ||
      string_agg('- ' || i.data, chr(10) ORDER BY i.review_id) || chr(10) || '```') AS prompt_md5
FROM items i JOIN chunks c ON i.ori_lang = c.ori_lang AND i.clusters = c.clusters AND i.review_id = c.review_id
GROUP BY i.ori_lang, i.clusters, c.chunk""")
def q_summary_prompts(spark, sf):
    keys = ["ori_lang", "clusters"]
    c = TD.clustered(spark, sf).withColumn("n_tokens", TX.token_count("data"))
    ch = SU.chunk_by_budget(c, keys, 2000)
    j = c.join(ch, keys + ["review_id"])
    g = j.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n_items"),
                                      F.array_sort(F.collect_list(F.struct("review_id", "data"))).alias("items"))
    return g.select(*keys, "chunk", "n_items",
                    F.md5(P.summary_prompt(F.transform("items", lambda x: x["data"]))).alias("prompt_md5"))


@register("pad_truncate", TD.with_views(TD.REVIEWS_SQL + f""",
tk AS (SELECT review_id, unnest(l) AS term, unnest(generate_series(1, len(l))) AS pos
       FROM (SELECT review_id, {TOKENS_SQL.format(t='data')} AS l FROM reviews) t),
voc AS (SELECT term, row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT term FROM tk) v),
ids AS (SELECT tk.review_id, list(voc.id ORDER BY tk.pos) AS ids FROM tk JOIN voc ON tk.term = voc.term
        GROUP BY tk.review_id)""", """
SELECT r.review_id,
  array_to_string(list_concat(coalesce(ids[1:16], []), list_transform(range(greatest(16 - len(coalesce(ids[1:16], [])), 0)), lambda x: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(range(len(coalesce(ids[1:16], []))), lambda x: 1),
                              list_transform(range(greatest(16 - len(coalesce(ids[1:16], [])), 0)), lambda x: 0)), ' ') AS attention_mask
FROM reviews r LEFT JOIN ids ON r.review_id = ids.review_id"""))
def q_pad_truncate(spark, sf):
    r = TD.reviews(spark, sf)
    tk = r.select("review_id", F.posexplode(TX.tokenize("data")).alias("pos", "term"))
    voc = R.distributed_rank(tk.select("term").distinct().withColumn("_g", F.lit(0)), ["_g"], ["term"], "id")
    # All tokens make the vocabulary; the sequences need the first 16 of each review only.
    ids = (tk.where(F.col("pos") < 16).join(voc.select("term", "id"), "term").groupBy("review_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")))
    j = r.select("review_id").join(ids, "review_id", "left").withColumn(
        "ids", F.coalesce(F.col("ids"), F.array().cast("array<bigint>")))
    input_ids, mask = V.pad_truncate(F.col("ids"), 16)
    return j.select("review_id", F.array_join(input_ids.cast("array<string>"), " ").alias("input_ids"),
                    F.array_join(mask.cast("array<string>"), " ").alias("attention_mask"))
