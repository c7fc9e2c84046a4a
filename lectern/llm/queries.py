"""The registered queries of the training-data operators: thin calls on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import (
    chat_repair, decontamination, html_text, lexical_search, line_crf, multi_index, ngram_join, packing, pii, repeats, token_counts, toxic_spans, whitening,
)


#: The key of the registered query only; in use, give a secret of your own.
PII_KEY = "registered query"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, folder, "documents"))


def op2_chat_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.repair(table(spark, folder, "conversations"))


def op3_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.neighbours(table(spark, folder, "embeddings"))


def op4_contaminated_documents(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op6_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op8_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = line_crf.train(docs, table(spark, folder, "labels"))
    return line_crf.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op10_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxic_spans.train(docs, table(spark, folder, "labels"))
    return toxic_spans.tag(docs, model).select("doc_id", "held_out", "score", "predicted", "spans")


def op13_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = (
    op1_ngram_jaccard_join, op2_chat_role_repair, op3_inverted_multi_index, op4_contaminated_documents, op5_html_main_text, op6_harmonic_packing, op7_surrogates, op8_line_quality, op9_token_counts,
    op10_repeated_strings, op11_lexical_search, op12_toxic_spans, op13_whitened_embeddings,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_contaminated_documents": decontamination.ORACLE, "op11_lexical_search": lexical_search.ORACLE}
