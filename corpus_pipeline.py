"""A corpus pipeline of five stages. Each takes the documents that the stage before it kept, all of them.

A stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents; what a stage decides
takes effect: rejected documents go, repeated text is cut out. The last returns token counts and digests.

In every stage null and empty texts count as texts without a word and stay (of several, near copies leave one); null doc_ids pass by;
rows that repeat id and text are judged alike; ties go to the smaller doc_id, then the text's hash; texts are read whole, however
long; an empty table stays empty; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bpe, decontaminate, nearcopies, repeats, toxicity
from estatelens.llm.common import id_remainder, read, saved
from estatelens.llm.plans import tokenizer_path


def names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic score is below 0.3, the bound of op3. The field learns from the same labels."""
    labels = read(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels)).select(names(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id: links are a similarity of 0.8 of five-word shingles."""
    return nearcopies.deduplicated(docs, words=5, similarity=0.8).select(names(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 100 bytes and more that stand earlier in the corpus; n_chars follows."""
    cut = repeats.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(names(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")).select(names(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of encoding and decoding."""
    return bpe.round_trip_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("repeats", cut_repeats), ("decontaminate", drop_leaks), ("bpe", tokens)]

#: No stage but the last one's counts can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
