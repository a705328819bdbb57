"""A training corpus from raw documents: five stages, each written and read again as Parquet.

quality (10), near-duplicates (1), decontamination (3), mixing (4), token output (9). The first four
return the columns of ``documents``. After the mix a document may stand twice; its copies follow
each other in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, quality, simhash_dedup, token_io
from tidemark.llm.entry import read_table, tokenizer_path
from tidemark.llm.storage import cut, new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score under 0.3).

    Rows of one doc_id go together, if any of them is rejected; rows without a doc_id stay. Null and
    empty texts are scored like others, texts of any length whole. An empty table stays empty, and
    without labels all stay. Columns are handed on as they are, whatever their names.
    """
    scores = quality.fit_score(docs, read_table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 5 <> 0")
    bad = scores.where("score < 0.3").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id in each near-duplicate group.

    Null and empty texts are one group. Rows that repeat the kept doc_id stay together, and rows
    without a doc_id stay; texts of any length are compared whole. An empty table stays empty.
    """
    return simhash_dedup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none; rows of one doc_id go together, and rows without one stay. An
    empty table stays empty, and an empty benchmark drops nothing.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, up to twice each, to the sources' target sizes.

    Null and empty texts have no words and are never taken; a null source is one source. Rows of one
    doc_id (null too) are taken alike, so a source may pass its target by what they repeat. An empty
    table stays empty.
    """
    return mixing.take_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return doc_id, start, n_tokens and ids_crc32 read back from them.

    Null and empty texts are the end id alone; null ids come first; repeated rows follow each other.
    An empty table gives no rows.
    """
    path = new_path(spark, "corpus_tokens")
    token_io.write_tokens(docs, path, tokenizer_path())
    return token_io.with_crc32(token_io.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]

#: No stage but the mix's counts can be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
