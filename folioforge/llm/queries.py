"""Each operator as a query over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import chat, debruijn, decontamination, fingerprints, importance, langid, licenses, pieces, runs, simhash, suffixes, url_filters, vector_codes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_importance_resampling(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_syncmer_fingerprints(spark, folder):
    return fingerprints.compare_edits(table(spark, folder, "documents"))


@query
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_repeated_bytes(spark, folder):
    return suffixes.repeated_bytes(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_simhash_groups(spark, folder):
    return simhash.fingerprint_digits(simhash.near_duplicates(table(spark, folder, "documents")))


@query
def op6_license_scan(spark, folder):
    return licenses.license_digest(licenses.scan_licenses(table(spark, folder, "documents")))


def piece_model() -> str:
    """Where this machine keeps the public model; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_piece_round_trip(spark, folder):
    model = piece_model()
    return pieces.piece_digest(pieces.decode(pieces.encode(table(spark, folder, "documents"), model), model))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op8_url_filters(spark, folder):
    return url_filters.filter_urls(table(spark, folder, "pages"), url_filters.rule_table(spark, URL_RULES))


@query
def op10_repeated_words(spark, folder):
    return debruijn.repeated_words(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op9_benchmark_leaks(spark, folder):
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_periodic_runs(spark, folder):
    return runs.run_digest(runs.find_runs(runs.with_planted_runs(table(spark, folder, "documents"))))


@query
def op12_vector_codes(spark, folder):
    return vector_codes.code_digest(*vector_codes.encode(table(spark, folder, "embeddings")))


@query
def op13_chat_format(spark, folder):
    return chat.chat_digest(chat.format_chats(chat.with_control_turns(spark, table(spark, folder, "conversations"))))
