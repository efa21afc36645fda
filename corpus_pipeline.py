"""Corpus cleaning: quality, repeated lines, near copies, benchmark leaks, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_fm
from barloom.llm.common import remove, scratch, stored, table


#: Columns that the operators read; the others travel in one struct, so that no name can clash.
READ = ("doc_id", "text", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*[c for c in READ if c in docs.columns], (F.struct(*rest) if rest else F.lit(None)).alias("rest"))


def unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c) if c in READ else F.col(f"rest.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts (score 0.7 or more). Null and empty texts are
    scored by their zero statistics; without labelled rows all scores are 0.5 and nothing is kept.
    Repeated rows and null ids are scored like any other; an empty table stays empty."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality_fm.classify(packed(docs), model, threshold=0.7).where("predicted = 1"), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeats of passages out of the texts. A document of which nothing but white
    space is left is a repeat altogether and goes; one that was blank before stays. Null texts stay;
    repeated rows of one id are one document; null ids come first in the order of documents."""
    cleaned = line_dedup.remove_repeats(packed(docs))
    blank = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]")) == 0
    return unpacked(cleaned.where(~((F.col("n_removed") > 0) & blank)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8. The smallest
    id stays, of rows that repeat an id the smallest text; null ids and texts without words stay."""
    return near_dedup.keep_one(docs, size=5, similarity=0.8).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with a fifth of its words edited, go. Null and empty
    texts hold none; items without an id or words are in nothing; an empty benchmark keeps all."""
    found = decontaminate.find_items(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~F.col("contaminated")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of ids and of the text decoded from them. A null text is
    empty and has no ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, with_text=False)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; each stage's result is a table in the shared folder,
    removed when the next one is written. The last one's stays, for the caller to read."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
