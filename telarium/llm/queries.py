"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.llm import bpe, decontaminate, html_text, id_store, near_dup, period_runs, personal_data, quality_lm, quality_rules, secret_scan, token_alignment, token_rollup, url_filter
from telarium.llm.common import cut, folder, table

#: The vocabulary of the production queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The sentencepiece model that it is aligned with.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokenizer versions of the roll-up.
OLD, NEW = "byte_bpe_50k", "byte_bpe_multi_50k"


def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all documents, a new tokenizer version for all, deletes of the
    toxic ones, and the second batch sent once more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = cut(token_rollup.token_counts(docs, {name: public_tokenizers.path(f"{name}.tiktoken") for name in (OLD, NEW)}))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup = token_rollup.Rollup.fresh(spark)
    rollup.commit("1-insert", token_rollup.inserts(counted, OLD))
    rollup.commit("2-revise", token_rollup.revisions(counted, OLD, NEW))
    rollup.commit("3-insert-again", token_rollup.inserts(counted, OLD))
    rollup.commit("2-revise", token_rollup.revisions(counted, OLD, NEW))
    rollup.commit("4-delete", token_rollup.deletes(counted.join(toxic, "doc_id"), NEW))
    return rollup.totals()


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, and the digest of the secrets in text order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan(docs)
    values = F.transform("findings", lambda p: F.sha2(p["value"], 256))
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.array_join(values, ",").alias("secrets_sha256"))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.production_list(spark)).select("page_id", "host", "path", "rule", "verdict")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def op11_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{folder(spark)}/ids-{uuid.uuid4().hex}"
    id_store.write(docs, VOCABULARY, at)
    return id_store.get(spark, at, docs, ids=False)


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.digests(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), VOCABULARY, PIECES, groups=False)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_lm, op2_bpe, op3_minhash, op4_token_rollup, op5_personal_data, op6_secrets, op7_url_cascade, op8_decontaminate, op9_html_text, op10_quality_rules, op11_id_store, op12_period_runs, op13_token_alignment)
}
