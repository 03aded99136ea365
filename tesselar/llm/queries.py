"""One thin query per operator: it applies the operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselar.llm import quality_rules as rules
from tesselar.llm import sql
from tesselar.llm.common import table


def vocabulary() -> str:
    """The public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.pii import surrogates

    return surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.bpe_automaton import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), vocabulary())


def op8_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.site_style import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselar.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_language_id, op4_exact_dedup, op5_simhash, op6_bpe_automaton, op7_packing, op8_site_style, op9_quality_rules, op10_suffix_dedup)}
ORACLES: dict[str, str] = {
    "op2_warc": sql.WARC,
    "op4_exact_dedup": sql.EXACT,
    "op9_quality_rules": sql.quality(
        rules.COMMON_WORDS,
        {
            "chars": rules.MIN_CLASS_CHARS, "words": rules.MIN_COMMON_WORDS, "min_words": rules.MIN_WORDS, "repeat": rules.MAX_REPEAT_PERCENT,
            "class": rules.MAX_CLASS_DISTANCE, "common": rules.MAX_WORD_DISTANCE,
        },
    ),
}
