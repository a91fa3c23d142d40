"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; run()
writes each stage's rows as Parquet in the shared folder, reads them again, and removes the folder of the stage before.
All stages but the last return the columns of documents; the last one returns each document's token ids. Stages that
filter judge and keep rows in one pass, so no decision has to find its row again and no text is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsmith.llm import bpe, quality
from pointsmith.llm.decontaminate import keep_clean
from pointsmith.llm.line_dedup import apply_bitmaps, line_dedup
from pointsmith.llm.minhash import keep_one
from pointsmith.session import cut, cut_mark, drop_cuts, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality stay. The model is fitted on labelled rows of the documents given.

    Every row is judged, with or without an id; null, empty and wordless texts get the share of good labels; without
    labels all rows stay; repeated rows and rows that share an id are each judged by their text; very long texts are
    judged whole; an empty table stays empty; more columns pass through.
    """
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, in all documents but that of the largest id; n_chars, where there is one, follows the text.

    Rows without an id neither count as documents nor lose lines; rows that share an id count as one document; null
    texts stay null; a text that loses all its lines stays as an empty one; other columns pass through.
    """
    kept = apply_bitmaps(docs, line_dedup(docs))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (one without an id, if none has one).

    Different texts that share an id, or have none, are told apart; of rows that repeat id and text one stays; null
    and empty texts are copies of each other; an empty table stays empty; more columns pass through.
    """
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go.

    Every row is judged by its text, with or without an id; texts without words stay; an empty benchmark contaminates
    nothing; an empty table stays empty; more columns pass through.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes): the ids of each text, and how many bytes they decode to.

    One row for each row, null ids and repeated rows too; null and empty texts have no tokens.
    """
    return bpe.encode(docs, decoded_size=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express neighbour voting or order min-hash; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), cut_mark()
    for _, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir))
        # Its rows are written: what it has written on its way, and the stage before, are done with.
        drop_cuts(spark, mark, but=cut_mark() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
