"""The registered queries of the subpackage: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import token_digests
from tidemark.llm.fuzzylines import dedup_lines
from tidemark.llm.language import fit_language, held_out, predict_language
from tidemark.llm.personal import fit_tagger, personal_data
from tidemark.llm.positional import contamination
from tidemark.llm.repair import damaged, repair_digests
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.substrings import repeat_digests
from tidemark.llm.tokenfiles import round_trip
from tidemark.llm.toxicity import fit_toxicity, toxicity_scores
from tidemark.llm.urlrules import judge_urls, literal_rules
from tidemark.llm.weighted import neighbour_likeness
from tidemark.queries.common import table


def op1_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return neighbour_likeness(table(spark, folder, "documents"))


def op2_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    return token_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids as read back from the token files."""
    import public_tokenizers

    return round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_column_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated 400-byte strings, as digests."""
    return repeat_digests(table(spark, folder, "documents"))


def op5_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op6_personal_tagger(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, folder, "documents")
    return personal_data(docs, fit_tagger(docs))


# The rules of the query: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return judge_urls(table(spark, folder, "pages"), literal_rules(spark, URL_RULES))


URL_SQL = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), fitted AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
            THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
            THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted
"""


def op8_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash_covering(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels that are not held out."""
    docs = table(spark, folder, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, folder, "labels")))


def op11_permuterm(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its form, its root and its near words."""
    return spelling_variants(table(spark, folder, "documents"))


def op12_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from documents that are not held out."""
    docs = table(spark, folder, "documents")
    net = fit_language(docs, ~held_out(F.col("doc_id")))
    return predict_language(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_interval_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Damages of every conversation, the cheapest edits and the repaired messages as a digest."""
    return repair_digests(damaged(table(spark, folder, "conversations")), "gone")


QUERIES = {
    "op1_weighted_sampling": (op1_weighted_sampling, None),
    "op2_bpe_tree": (op2_bpe_tree, None),
    "op3_token_files": (op3_token_files, None),
    "op4_column_suffixes": (op4_column_suffixes, None),
    "op5_positional_index": (op5_positional_index, None),
    "op6_personal_tagger": (op6_personal_tagger, None),
    "op7_url_rules": (op7_url_rules, URL_SQL),
    "op8_fuzzy_lines": (op8_fuzzy_lines, None),
    "op9_simhash_covering": (op9_simhash_covering, None),
    "op10_toxicity_trees": (op10_toxicity_trees, None),
    "op11_permuterm": (op11_permuterm, None),
    "op12_byte_network": (op12_byte_network, None),
    "op13_interval_parsing": (op13_interval_parsing, None),
}
