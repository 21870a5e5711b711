"""Cluster summaries (§2.L1-L3, E4).

* Extractive: sentences → term vectors → centrality → the most central
  English sentence, for every cluster at once.
* Abstractive: rounds of budgeted chunks; each chunk is one call of an
  injected client; sub-summaries feed the next round until one summary is
  left per cluster.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions import prompts as P
from critica.functions import text as TX
from critica.functions.language import is_english
from critica.operators.ranking import top_sentence
from critica.operators.similarity import sentence_centrality, sentences
from critica.session import cut_lineage


def extractive_summary(df: DataFrame, keys, id_col: str = "review_id", text_col: str = "data",
                       min_words: int = 5, digits: int = 9) -> DataFrame:
    """Most central English sentence of each group, else the most central one (L1).

    Centrality is compared after rounding to ``digits`` places so that equal
    sentences tie exactly and the smaller (review id, sentence id) wins.
    Groups with no sentence of ``min_words`` words get no row (their
    summary is null once joined).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = sentences(df, keys, id_col, text_col, min_words)
    c = sentence_centrality(s, keys, (id_col, "sent_id"))
    c = c.withColumn("is_english", is_english(F.col("sentence"))).withColumn(
        "centrality", F.round("centrality", digits))
    return top_sentence(c, keys, "centrality", "is_english", (id_col, "sent_id"), "sentence")


# --------------------------------------------------------------------------
# Greedy budgeted chunks

def chunk_by_budget(items: DataFrame, keys, budget: int = 12000, id_col: str = "review_id",
                                tokens_col: str = "n_tokens", max_levels: int = 64) -> DataFrame:
    """Chunk id per item, items ordered by id inside each group (E4): exact greedy
    packing without holding a group in one task.

    1. Positions and inclusive prefix sums P per group (distributed).
    2. A chunk starting at item i ends before the first j > i with
       P_j > P_i - t_i + budget: an as-of search, done as a backward fill
       over items and queries sorted by value.
    3. The chunk starts are the chain 1 → next(1) → …, marked by pointer
       doubling (log rounds of joins).
    4. Chunk id = running count of starts - 1.
    """
    from critica.operators.ranking import distributed_ffill, distributed_rank, distributed_running_sum
    keys = [keys] if isinstance(keys, str) else list(keys)
    x = items.select(*keys, id_col, F.col(tokens_col).cast("long").alias("t"))
    x = distributed_rank(x, keys, [id_col], "pos")
    x = cut_lineage(distributed_running_sum(x, keys, ["pos"], "t", "p_incl"))
    n = x.groupBy(*keys).agg(F.max("pos").alias("n"))
    # As-of search: for each item i the smallest j with p_incl_j > p_incl_i - t_i + budget.
    qs = x.select(*keys, (F.col("p_incl") - F.col("t") + F.lit(budget)).alias("v"), F.lit(0).alias("k2"),
                  F.lit(None).cast("long").alias("j"), F.col("pos").alias("qpos"))
    its = x.select(*keys, F.col("p_incl").alias("v"), F.lit(1).alias("k2"), F.col("pos").alias("j"),
                   F.lit(None).cast("long").alias("qpos"))
    both = qs.unionByName(its).withColumn("_sv", -F.col("v")).withColumn(
        "_sj", F.coalesce(-F.col("j"), F.lit(0)))
    filled = distributed_ffill(both, keys, ["_sv", "k2", "_sj"], "j", "next_raw")
    nxt = (filled.where(F.col("k2") == 0).join(n, keys)
           .select(*keys, F.col("qpos").alias("node"),
                   F.greatest(F.col("qpos") + 1, F.coalesce(F.col("next_raw"), F.col("n") + 1)).alias("to"),
                   "n"))
    nxt = cut_lineage(nxt)
    # Pointer doubling: jumps[k](i) = next^(2^k)(i); terminal n+1 maps to itself.
    term = n.select(*keys, (F.col("n") + 1).alias("node"), (F.col("n") + 1).alias("to"), "n")
    jump = cut_lineage(nxt.unionByName(term))
    starts = n.select(*keys, F.lit(1).cast("long").alias("node"))
    for _ in range(max_levels):
        reached = (starts.join(jump, keys + ["node"]).select(*keys, F.col("to").alias("node"))
                   .join(n, keys).where(F.col("node") <= F.col("n")).select(*keys, "node"))
        grown = cut_lineage(starts.unionByName(reached).distinct())
        if grown.count() == starts.count():
            starts = grown
            break
        starts = grown
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] +
                                  [F.col("a.to") == F.col("b.node")])
                           .select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.node").alias("node"),
                                   F.col("b.to").alias("to"), F.col("a.n").alias("n")))
    else:
        raise RuntimeError("chunk_by_budget: no convergence")
    marked = (x.join(starts.withColumnRenamed("node", "pos").withColumn("is_start", F.lit(1)),
                     keys + ["pos"], "left")
              .withColumn("is_start", F.coalesce(F.col("is_start"), F.lit(0))))
    counted = distributed_running_sum(marked, keys, ["pos"], "is_start", "_starts")
    return counted.select(*keys, id_col, (F.col("_starts") - 1).cast("int").alias("chunk"))


# --------------------------------------------------------------------------
# Abstractive summaries with an injected client

RETRIES = 5


def call_client(prompts: DataFrame, client, prompt_col: str = "prompt", out_col: str = "summary",
                error_col: str | None = None, retries: int = RETRIES, wait: float = 1.0,
                max_per_second: float | None = None, system: str | None = None) -> DataFrame:
    """Run ``client(list[str]) -> list[str]`` over Arrow batches of prompts.

    The client is built once per Python worker by the factory passed in
    (``client`` may be a callable or a zero-argument factory marked with
    ``factory=True``).  ``system`` is put before each prompt.

    A batch that raises is asked again prompt by prompt, each up to
    ``retries`` times with a doubling ``wait``.  A prompt that still fails
    has a null answer and its error in ``error_col``; without ``error_col``
    it fails the job.  ``max_per_second`` bounds the prompts that one worker
    sends.
    """
    added = [T.StructField(out_col, T.StringType())] + ([T.StructField(error_col, T.StringType())] if error_col else [])
    schema = T.StructType([f for f in prompts.schema.fields] + added)

    def run(batches):
        fn = client() if getattr(client, "factory", False) else client

        def ask(texts):
            if max_per_second:
                time.sleep(len(texts) / max_per_second)
            answers = list(fn(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
            return answers

        def ask_one(text):
            for k in range(retries):
                try:
                    return ask([text])[0], None
                except Exception as e:  # whatever a client raises is its failure to answer
                    error = e
                    time.sleep(wait * 2 ** k if k + 1 < retries else 0)
            if error_col is None:
                raise error
            return None, f"{type(error).__name__}: {error}"

        for pdf in batches:
            texts = [t if system is None else f"{system}\n{t}" for t in pdf[prompt_col].tolist()]
            try:
                found = [(x, None) for x in ask(texts)] if texts else []
            except Exception:
                found = [ask_one(t) for t in texts]
            pdf[out_col] = pd.Series([x for x, _ in found], index=pdf.index, dtype="object")
            if error_col:
                pdf[error_col] = pd.Series([x for _, x in found], index=pdf.index, dtype="object")
            yield pdf

    return prompts.mapInPandas(run, schema)


def abstractive_summary(items: DataFrame, keys, client, budget: int = 12000, id_col: str = "review_id",
                        text_col: str = "data", max_rounds: int = 8, system: str | None = None) -> DataFrame:
    """One summary per group by rounds of budgeted chunks (L2, Q1, Q2).

    Each round: token counts → chunks → one prompt per chunk → client.
    Groups whose items fit one chunk are finished; the others continue with
    their chunk summaries as items.  A round that does not reduce the item
    count of a group raises (an unbounded recursion would never stop).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cur = items.select(*keys, F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    done = None
    for rnd in range(max_rounds):
        cur = cur.withColumn("n_tokens", TX.token_count("text"))
        ch = chunk_by_budget(cur, keys, budget, "item_id", "n_tokens")
        cur_c = cur.join(ch, keys + ["item_id"])
        prompts = (cur_c.groupBy(*keys, "chunk")
                   .agg(F.count(F.lit(1)).alias("n_items"),
                        F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("items"))
                   .select(*keys, "chunk", "n_items",
                           P.summary_prompt(F.transform("items", lambda x: x["text"])).alias("prompt")))
        answered = cut_lineage(call_client(prompts, client, system=system))
        # Per-group chunk counts by aggregate + join (a window would hold a
        # hot group's chunk list in one task).
        per_group = answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"),
                                                F.sum("n_items").alias("n_in"))
        answered = answered.join(per_group, keys)
        finished = answered.where(F.col("n_chunks") == 1).select(*keys, "summary", F.lit(rnd + 1).alias("rounds"))
        done = finished if done is None else done.unionByName(finished)
        rest = answered.where(F.col("n_chunks") > 1)
        stuck = rest.where(F.col("n_chunks") >= F.col("n_in")).limit(1).count()
        if stuck:
            raise RuntimeError("abstractive_summary: a round did not shrink a group (items over budget?)")
        if rest.limit(1).count() == 0:
            return done
        cur = rest.select(*keys, F.col("chunk").cast("long").alias("item_id"), F.col("summary").alias("text"))
    raise RuntimeError(f"abstractive_summary: not finished after {max_rounds} rounds")


class KeywordStubClient:
    """Deterministic offline stand-in for a model client (tests, benches).

    Summaries: the first ``n_words`` words of the first bullet, prefixed
    by the number of bullets.  Classifications: keyword rules.
    """

    def __init__(self, n_words: int = 8):
        self.n_words = n_words

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = [ln[2:] for ln in p.split("\n") if ln.startswith("- ")]
            if p.startswith(SUMMARY_PREFIX):
                words = lines[0].split()[: self.n_words]
                out.append(f"{len(lines)} reviews: " + " ".join(words))
            else:
                out.append(classify_by_keywords(p))
        return out


SUMMARY_PREFIX = P.SUMMARY_INSTRUCTION

# Keyword rules of the offline stub classifier.
PROBLEM_WORDS = ("crash", "bug", "error", "broken", "fail", "freeze", "problème", "plante")
FEATURE_WORDS = ("add", "please", "wish", "would like", "feature", "ajouter", "souhaite")


def classify_by_keywords(text: str) -> str:
    t = text.lower()
    labels = []
    if any(w in t for w in PROBLEM_WORDS):
        labels.append("problem report")
    if any(w in t for w in FEATURE_WORDS):
        labels.append("feature request")
    return ", ".join(labels) if labels else "irrelevant"


def summarise_corpus(df: DataFrame, keys, min_size: int = 5, summarizer=None, id_col: str = "review_id",
                     text_col: str = "data") -> DataFrame:
    """Per group of at least ``min_size`` reviews: the document and its summary (L3).

    Null group keys are ignored (B10); documents come in bounded parts
    (D13); the summary is extractive unless a ``summarizer(members, keys)``
    is given (e.g. ``lambda m, k: abstractive_summary(m, k, client)``).
    """
    from critica.operators.aggregates import cluster_documents
    from critica.operators.routing import drop_null_key, keep_large_groups
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = drop_null_key(df, keys[-1])
    big = keep_large_groups(d, keys, min_size)
    docs = cluster_documents(big, keys, text_col, id_col, min_size)
    if summarizer is None:
        summ = extractive_summary(big, keys, id_col, text_col).select(*keys, "summary")
    else:
        summ = summarizer(big.select(*keys, id_col, text_col), keys).select(*keys, "summary")
    return docs.join(summ, keys, "left")
