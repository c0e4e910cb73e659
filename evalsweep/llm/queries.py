"""One registered query for each operator of this subpackage."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from evalsweep.llm import (
    bpe,
    hard_negatives,
    inner_products,
    near_texts,
    near_vectors,
    packing,
    periodic,
    perplexity,
    pii,
    quality,
    repeats,
    toxicity,
    url_filter,
)
from evalsweep.llm.common import table

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op5_near_texts(spark, sf_dir):
    return near_texts.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN)


@query
def op7_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return inner_products.top_k(vectors, "vec_id", "embedding", lambda vec_id: vec_id % 50 == 0)


@query
def op8_repeats(spark, sf_dir):
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)
# Hosts with one of these words in a label make up the block list.
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


@query
def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    blocked = hosts.filter(F.col("key").rlike(r"(^|[.-])(%s)([.-]|$)" % "|".join(BLOCKED_WORDS)))
    return url_filter.judge_urls(pages, URL_RULES, blocked)


@query
def op10_near_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return near_vectors.near_duplicates(vectors, "vec_id", "embedding", "label")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth text, by the crc32 of its id, goes over into a period of its own words."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return index


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(table(spark, sf_dir, "documents"), planted_order)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(vectors, "vec_id", moved, "embedding", lambda vec_id: vec_id % 50 == 0)


@query
def op13_quality_rules(spark, sf_dir):
    judged = perplexity.judge_quality(table(spark, sf_dir, "documents"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*names, "base_failed", "kept", "lang", "log_perplexity")
