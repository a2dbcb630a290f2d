"""The corpus pipeline: quality, language, exact duplicates, near duplicates, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where docs has the columns of
documents, and all but the last return the rows of docs that they keep, unchanged. A stage judges the
rows that it is given: its counts, its models and its groups come from docs alone, apart from the
quality labels. Null and empty texts, null ids, repeated rows and more columns are taken as the
operators define; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import forget, scratch, stored, table
from quern.llm.exact_dedup import exact_dedup
from quern.llm.langid import identified_rows
from quern.llm.packing import pack_documents
from quern.llm.quality import good_rows
from quern.llm.simhash import near_duplicates


def _text_key() -> Column:
    """SHA-256 of a text's bytes (null: of a null text). Operators decide alike for rows of equal id and text."""
    return F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    """What a dedup operator reads: the id, the text and the text's key, which it carries along."""
    return docs.select("doc_id", "text", _text_key().alias("text_key"))


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs but for those not kept in decided (doc_id, text_key, kept), row by row.

    An id none of whose rows is kept names them all; of ids with kept rows too, and of null ids, the text's
    key says which rows go (null equals null). Of rows with one id and one text, of which one is kept,
    one stays. Few are dropped, so Spark can send these narrow tables to the rows; texts are shuffled
    only where it can't, and for rows that repeat an id and a text."""
    decided = stored(decided.select("doc_id", "text_key", "kept"), "decided")
    ids = decided.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("any"), F.bool_and("kept").alias("all"))
    ids = stored(ids.filter("not all"), "dropped")
    mixed = decided.join(ids.filter("any").select("doc_id"), "doc_id", "left_semi").union(decided.filter("doc_id is null"))
    rows = mixed.groupBy("doc_id", "text_key").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows.filter("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "stays"), "dropped-rows")
    whole = stored(ids.filter("not any").select(F.col("doc_id").alias("_id")), "dropped-ids")
    forget(decided, ids)

    def same(some: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(some["_id"]) & _text_key().eqNullSafe(some["_key"])

    gone, again = rows.filter("not stays").drop("stays"), rows.filter("stays").drop("stays")
    left = docs.join(whole, docs["doc_id"] == whole["_id"], "left_anti").join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(again, same(again), "left_semi").withColumn("__text_key", _text_key())
    return left.join(again, same(again), "left_anti").union(repeated.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good (score of 0.5 or more). A null text is scored as
    an empty one; repeated rows have one score; without labels, all stay. An empty table passes through."""
    return good_rows(docs, table(spark, sf_dir, "labels"))


#: Languages of documents that stay; None: each one that the documents' labels teach.
LANGUAGES: tuple[str, ...] | None = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier gives one of LANGUAGES without doubt: those without a letter go,
    those too short to tell, those between two languages and those in a language that was never
    learned. Null and empty texts go; repeated rows share their fate. Where no document has a
    language to learn from, all with a letter stay. An empty table passes through."""
    return identified_rows(docs, languages=LANGUAGES)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest (then the smallest id; of rows equal in
    these too, one). Null and blank texts are one group. An empty table passes through."""
    return _without(docs, exact_dedup(_keyed(docs), keep=("text_key",)))


#: Near duplicates: words of a shingle, and the similarity of the sets of shingles.
WORDS, SIMILARITY = 5, 0.8


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of WORDS-word shingles have a Jaccard similarity of SIMILARITY or more, as
    the operator's sketches estimate it, or which a chain of such joins, one row of the smallest id (null
    ids last). Null and blank texts are alike. An empty table passes through."""
    return _without(docs, near_duplicates(_keyed(docs), words=WORDS, similarity=SIMILARITY, keep=("text_key",)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences: a null or empty text is one id, repeated rows are
    packed as often as they occur, an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact_dedup", one_of_equals),
    ("near_dedup", one_of_similar),
    ("packing", packed),
]

#: The trained and hashed stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
