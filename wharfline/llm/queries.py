"""The queries opN_<name> of the operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wharfline.llm import conversation_repair, decontaminate, html_extract, jaccard_join, jpeg_media, langid, lexical_search, mixing, pii, secret_scan, simhash_dedup, suffix_dedup, warc
from wharfline.llm.common import table
from wharfline.llm.oracles import ORACLE_SQL


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.predict(docs, langid.fit_documents(docs))
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.digest(jpeg_media.features(jpeg_media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(*warc.archive(table(spark, sf_dir, "pages")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_overlaps(docs.select("doc_id", "text"), benchmark))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.join(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_jaccard, op3_langid, op4_mixing, op5_pii, op6_media, op7_suffix_dedup, op8_warc, op9_html, op10_decontaminate, op11_simhash, op12_repair, op13_search)}

__all__ = ["ORACLE_SQL", "QUERIES"]
