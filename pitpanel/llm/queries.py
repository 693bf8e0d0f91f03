"""The queries opN_<name> and pipeline, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import bpe, chat, decontam, lines, minhash, packing, pii, quality, search, token_count, toxicity, urls, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.format_conversations(rows.unionByName(own), path), path)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join("dropped", ",")).drop("sources", "sizes", "n_chars")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def _corpus_pipeline():
    """corpus_pipeline.py at the repository's top."""
    if "corpus_pipeline" in sys.modules:
        return sys.modules["corpus_pipeline"]
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules["corpus_pipeline"] = module
    spec.loader.exec_module(module)
    return module


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_pipeline().run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_chat_format,
        op2_minhash,
        op3_decontaminate,
        op4_bpe,
        op5_url_filter,
        op6_toxicity,
        op7_quality,
        op8_line_dedup,
        op9_pii,
        op10_token_count,
        op11_pack,
        op12_search,
        op13_spelling_variants,
        pipeline,
    ]
    return {f.__name__: f for f in own}


_LISTED = " OR ".join(f"list_contains(regexp_split_to_array(host, '[.-]'), '{w}')" for w in urls.WORDS)
_FITS = "({h} = host OR ends_with(host, '.{n}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_RULE = " ".join(f"WHEN {_FITS.format(h=repr(h), n=h, p=p)} THEN '{h + p}'" for _, h, p in _BY_LENGTH)
_VERDICT = " ".join(f"WHEN {_FITS.format(h=repr(h), n=h, p=p)} THEN '{v}'" for v, h, p in _BY_LENGTH)

URL_SQL = rf"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS tail
  FROM pages
), split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(tail, '^([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
)
SELECT page_id, host, path, CASE {_RULE} END AS rule,
       coalesce(CASE {_VERDICT} END, CASE WHEN {_LISTED} THEN 'block' ELSE 'allow' END) AS verdict,
       ({_LISTED}) AS listed
FROM split
"""


SEARCH_SQL = rf"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM said GROUP BY doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), size AS (
  SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id
), whole AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id,
         CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id) CROSS JOIN whole
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": URL_SQL, "op12_search": SEARCH_SQL}
