"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next stage's docs.  All but the last return the columns of documents; further columns,
whatever their names, go along.  Null and empty texts, null ids, repeated rows, rows that share an id but not the text and
empty tables are taken by every stage; what becomes of them stands with each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontamination, near_duplicates, quality_classifier, secret_scan, sentencepiece_codec
from tabulon.llm.shared import stored, tidy


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, row by row: repeated rows meet one fate, and so do wordless texts,
    which score the labelled rows' share of good ones; without labels every row scores 0.5 and goes."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row with the smallest id stays; repeated rows become one.  Rows that share an
    id but not the text are judged apart; rows without words or without an id all stay."""
    return near_duplicates.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go, row by row; null and empty texts contain none and stay."""
    hit = decontamination.contaminated_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["tk"])
    return docs.join(hit, same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text.  Every row stays, one without secrets as it
    was, null texts and null n_chars included."""
    found = secret_scan.find_secrets(docs, keep_row=True)
    some, old = F.size("spans") > 0, F.coalesce(F.col("row.text"), F.lit(""))
    text = F.when(some, secret_scan.redacted(old, F.col("spans"))).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(some, F.length(text).cast("long")).otherwise(F.col("row")["n_chars"])}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids) of every row that is left; null and empty texts have no ids."""
    encoded = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode_pieces),
]

#: nearest neighbours, MinHash and pieces are not expressible in SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what lies between them goes when the last one's result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
