"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrid.llm.shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.ngram_join import classes

    return classes(table(spark, sf_dir, "documents"))


def op4_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.language import predict, train
    from lumagrid.llm.shared import crc

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(crc("doc_id", 4) == 2, F.lit(False)))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.host_reputation import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).withColumns({c: F.round(c, 6) for c in ("bad_rate", "lower_bound")})


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.mixing import score

    return score(table(spark, sf_dir, "documents"), "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7, 0) != 2")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.shared import scratch_folder
    from lumagrid.llm.token_files import read_tokens, write_tokens

    folder = scratch_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_tokens(spark, folder, tokens=False)


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.disclosure import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op11_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumagrid.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_roundtrip, op2_kneser_ney_quality, op3_ngram_jaccard, op4_pivot_near_duplicates, op5_language_id, op6_benchmark_decontamination, op7_url_reputation, op8_context_mixing, op9_token_files, op10_disclosure, op11_exact_complement_packing, op12_tokenizer_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """The others (token ids, perplexities, learned models, coded files, disclosure) are beyond SQL."""
    from lumagrid.llm import oracle
    from lumagrid.llm.host_reputation import RULES

    return {"op3_ngram_jaccard": oracle.NGRAM_JACCARD, "op4_pivot_near_duplicates": oracle.PIVOT_NEAR_DUPLICATES, "op6_benchmark_decontamination": oracle.BENCHMARK_DECONTAMINATION, "op7_url_reputation": oracle.url_reputation(RULES), "op13_filter_audit": oracle.FILTER_AUDIT}
