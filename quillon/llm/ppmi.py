"""How distinctive a term is of a page: positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .page_terms import page_terms


def _scored(postings: DataFrame, corpus: DataFrame, smoothing: float) -> DataFrame:
    """``ppmi``'s columns with the page's smoothed share ``q`` and the largest ``tf`` of all, ``most``."""
    tf = written(page_terms(postings, corpus), "ppmi-terms")
    terms = tf.groupBy("term").agg(F.count("*").alias("pages"), F.sum("tf").alias("total"))
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("len"), F.max("tf").alias("most"))
    whole = lengths.agg(F.sum("len").alias("all"), F.sum(F.pow("len", F.lit(smoothing))).alias("smooth"), F.max("most").alias("most"))
    lengths = lengths.drop("most").crossJoin(F.broadcast(whole)).select("doc_id", "all", "most", (F.pow("len", F.lit(smoothing)) / F.col("smooth")).alias("q"))  # one row
    score = F.log((F.col("tf") / F.col("all")) / ((F.col("total") / F.col("all")) * F.col("q")))
    return tf.join(terms, "term").join(lengths, "doc_id").select("doc_id", "term", "tf", "pages", "total", F.greatest(F.lit(0.0), score).alias("ppmi"), "q", "most")


def ppmi(postings: DataFrame, corpus: DataFrame, smoothing: float = 0.75) -> DataFrame:
    """(doc_id, term, tf, pages, total, ppmi) of every term of every page.

    ``ppmi = max(0, ln(p(term, page) / (p(term) * q(page))))`` where ``q`` is the page's share of the
    summed page lengths raised to ``smoothing``, so short pages are not overrated. ``pages`` and ``total``
    are the pages and occurrences of the term in the whole collection.

    A term is lower case without outer blanks; repeated rows and pages count once; a stored tf that is
    null, 0 or negative is replaced by the text's count; a term with neither is left out. Null terms,
    doc_ids and texts are ignored, empty tables give no rows.
    """
    return _scored(postings, corpus, smoothing).drop("q", "most")


def marking_terms(postings: DataFrame, corpus: DataFrame, least_tf: int = 4, least_pages: int = 2, most_pages: int = 12, smoothing: float = 0.75) -> DataFrame:
    """(doc_id, term): terms frequent in their page and in few pages, by their score.

    A term with ``least_tf`` occurrences in a page and in at most ``most_pages`` pages occurs at most
    ``least_tf + (most_pages - 1) * most`` times for each ``least_tf`` of the page's, ``most`` being the largest tf of all, so
    its score there is at least ``ln(least_tf / ((least_tf + (most_pages - 1) * most) * q))``. Terms that
    reach this bound of their page are candidates, counts decide among them.
    """
    scored = _scored(postings, corpus, smoothing)
    bound = F.log(F.lit(float(least_tf)) / ((least_tf + (most_pages - 1) * F.col("most")) * F.col("q")))
    found = scored.filter(F.col("ppmi") >= bound - 1e-9)
    return found.filter((F.col("tf") >= least_tf) & F.col("pages").between(least_pages, most_pages)).select("doc_id", "term")
