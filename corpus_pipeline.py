"""Training-corpus pipeline: five stages over ``documents``, each a Parquet table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last keep
the columns of ``documents`` and every row that they do not reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corposcope.llm import bpe, decontam, linetemplates, nearcopies, simhash, toxicity
from corposcope.llm.common import read, remainder, written
from corposcope.llm.queries import TOKENIZER

# Two of the stages cannot be written in SQL (a trained classifier, a tokenizer).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; empty texts are scored too."""
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return docs.where(toxicity.scored(docs, model) < 0.5)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from every document but the first, short ones with the passage
    they stand in; no document goes."""
    out = linetemplates.drop_recurring(docs, passages=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.  Texts
    are linked by their fingerprints (three words, 2 bits) and by a Jaccard similarity
    of 0.8 or more of their five-word shingles.  A row is named by its id and its text:
    rows with one id and different texts are different documents, of which the smallest
    hash counts as the smaller id; rows without an id come after all others.  Of rows
    that are equal in both one stays, the first by its other columns."""
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    name = F.concat(F.coalesce(F.concat(F.lit("0"), number), F.lit("1")), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.col("text").isNull().cast("string"))
    named = docs.withColumn("__row", name)
    kept = simhash.groups(named, key="__row", more=nearcopies.links(docs)).where("__row = component_id").select("__row").distinct()
    first = Window.partitionBy("__row").orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")))
    return named.join(kept, "__row", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontam.indexes(read(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontam.without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, token_ids, decoded_sha256) of every document left."""
    out = bpe.encode(docs, bpe.compile_file(TOKENIZER), decoded="decoded")
    return out.select("doc_id", "n_tokens", "ids_sha256", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
