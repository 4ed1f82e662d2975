"""Terms of pages, from the stored postings and from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_pages(corpus: DataFrame) -> DataFrame:
    """(doc_id, text): each page once; of rows that differ in text, the largest text stands."""
    return corpus.select("doc_id", "text").filter("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))


def text_counts(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, n): occurrences of terms (runs of ASCII letters and digits, then lower case) in the texts.

    Pages are already partitioned by doc_id, so the count needs no further exchange."""
    terms = distinct_pages(corpus).select("doc_id", F.explode(F.expr("regexp_extract_all(text, '([A-Za-z0-9]+)', 1)")).alias("t"))
    return terms.select(F.lower("t").alias("term"), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n")).select("term", "doc_id", "n")


def term_rows(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, doc_id, stored, counted): one row for each posting and each term of a text, not yet merged."""
    stored = postings.select(F.lower(F.trim("term")).alias("term"), "doc_id", F.col("tf").cast("long").alias("stored"), F.lit(0).cast("long").alias("counted"))
    stored = stored.filter("term is not null and term <> '' and doc_id is not null")
    found = text_counts(corpus).select("term", "doc_id", F.lit(None).cast("long").alias("stored"), F.col("n").alias("counted"))
    return stored.unionByName(found)


def merged_tf():
    """The tf of a (term, doc_id): the largest stored tf if above 0, else what the text has."""
    return F.when(F.max("stored") > 0, F.max("stored")).otherwise(F.max("counted")).alias("tf")


def page_terms(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf): each term of each page once, with tf above 0."""
    return term_rows(postings, corpus).groupBy("term", "doc_id").agg(merged_tf()).filter("tf > 0")
