"""A training corpus in five stages, each an operator of ``millrace.llm`` applied to all that the one before kept.

1. ``language_id`` learns languages from the documents and drops those it rejects.
2. ``simhash`` keeps one document of each group of near-duplicates: five-word shingles with a Jaccard similarity of
   0.8 or more. Candidates come from Golay-code keys of SimHash fingerprints and are verified; an exact step adds the links that
   fingerprints leave out, so that none is missed (``simhash.keep_one`` with a similarity).
3. ``substring`` removes passages of 50 words that a document with a smaller id has.
4. ``mix`` takes documents from the sources by target weights, some more than once, some not at all.
5. ``sentencepiece`` encodes the texts.

Each stage's result is written as Parquet and read again as the next one's documents; what a stage puts into the shared folder
meanwhile is deleted when it ends, and its documents when the next one has. ``documents`` must have doc_id, text, lang and source.
What stages do with odd rows:

* Null and empty texts, and texts without letters, have no language and go with the first stage.
* Null ids and null sources are kept; a null lang is never learned from. Of near-duplicates the one with the smallest id stays, nulls last;
  ties of id go by a hash of the text. Rows that repeat id and text are near-duplicates, so one of them stays.
* Texts of any length are read whole.
* Columns beside those needed are carried along to the fourth stage under whatever name (``n_chars``, where there is one, is counted anew by the third).
* An empty table, or one in which no row has a language, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import apart, discard, fresh_path, prepare, scratch
from millrace.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import learn, predict

    prepare(spark)
    learned = learn(docs, allowed=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    (language,) = apart(docs, "_language")
    return predict(docs, learned, out=language).filter(F.col(language)["accepted"]).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import keep_one

    prepare(spark)
    return keep_one(docs, similarity=0.8)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from millrace.llm.substring import drop_repeats

    prepare(spark)
    left = drop_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mixed

    prepare(spark)
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from millrace.llm.pieces import encode, load_model

    prepare(spark)
    rows = encode(docs, load_model(public_tokenizers.path(TOKENIZER)))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("simhash", simhash), ("substring", substring), ("mix", mix), ("sentencepiece", sentencepiece)]

#: No stage but the mix can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. They are in the shared folder until ``millrace.llm.common.release``."""
    prepare(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            discard(spark, last)
        last = path
    return docs
