"""From documents to token ids: quality rules, near duplicates, benchmark decontamination, personal data, SentencePiece.

Each stage works on all that its predecessor kept. The first three drop rows, the fourth masks spans in the text, the last
returns ids and the text decoded from them. run() writes each stage's rows to the shared folder and reads them again, so a
lost executor costs one stage's tasks at most.

Defined results: null texts have no words and are rejected by the first stage; an empty table gives no rows; extra columns
are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, near_join, pieces, pii, quality
from tidewatch.llm.base import dropped, materialised, private, table
from tidewatch.llm.queries import PIECE_MODEL, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (hits,) = private(docs, "hits")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), out=hits)
    return found.filter(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' other columns, n_tokens, ids and decoded. A column of theirs with one of these names gets _ appended."""
    made = ("n_tokens", "ids", "decoded")
    rest = [c for c in docs.columns if c != "text"]
    names = private(docs.select(*[F.lit(0).alias(m) for m in made]), *[c for c in rest])
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)])
    out = pieces.encode_pieces(renamed, tokenizer_path(PIECE_MODEL), keep=tuple(names), decoded="decoded")
    return out.select(*[F.col(f"`{n}`") for n in names], F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialised(docs)
            dropped(before)
    return docs


#: SQL cannot express the forest, the alignment or the encoder; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None
