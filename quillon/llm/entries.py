"""Queries of this folder for ``__spark_entry__`` and their SQL where DuckDB can run it over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import grid_clusters, merge_replay, mixture, posting_knn, ppmi, radix_counts, rank_walk, repetition, scan_repair


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return rank_walk.rank_walk(table(spark, d, "ranked"), table(spark, d, "text_queries"), table(spark, d, "score_lists"))


def p1_found(spark, d):
    return rank_walk.agreed_heads(_walked(spark, d))


def p1_ranking(spark, d):
    return _walked(spark, d)


def p2_found(spark, d):
    return ppmi.marking_terms(table(spark, d, "postings"), table(spark, d, "corpus"))


def p2_ppmi(spark, d):
    return ppmi.ppmi(table(spark, d, "postings"), table(spark, d, "corpus")).withColumn("ppmi", F.round("ppmi", 6))


def p3_found(spark, d):
    return scan_repair.marked_lines(scan_repair.scan_repair(table(spark, d, "corpus")))


def p3_text(spark, d):
    return scan_repair.scan_repair(table(spark, d, "corpus")).select("doc_id", "text")


def _frequencies(spark, d):
    return radix_counts.term_frequencies(table(spark, d, "postings"), table(spark, d, "corpus"))


def p4_found(spark, d):
    return _frequencies(spark, d).filter("mark is not null").select("term", "mark")


def p4_frequencies(spark, d):
    return _frequencies(spark, d)


def _clusters(spark, d):
    return grid_clusters.written(grid_clusters.grid_clusters(table(spark, d, "image_vectors")), "grid-clusters")


def p5_found(spark, d):
    return grid_clusters.large_clusters(_clusters(spark, d)).select("id", "head_id")


def p5_clusters(spark, d):
    """Every cluster, lone vectors too."""
    sizes = grid_clusters.cluster_sizes(table(spark, d, "image_vectors"), _clusters(spark, d))
    return sizes.withColumn("inertia", F.round("inertia", 1))


def p5_typical(spark, d):
    return grid_clusters.describe_clusters(table(spark, d, "image_vectors"), _clusters(spark, d))


def p5_compared(spark, d):
    return grid_clusters.compared(table(spark, d, "image_vectors"), _clusters(spark, d), table(spark, d, "kmeans_result"))


def p6_found(spark, d):
    return posting_knn.close_pairs(posting_knn.similar_vectors(table(spark, d, "image_vectors"), k=5, limit=8_000.0))


def p6_neighbors(spark, d):
    near = posting_knn.similar_vectors(table(spark, d, "image_vectors"), k=10, every=100)
    return near.select("id", F.transform("near", lambda n: n["id"]).alias("neighbors"))


def p7_ids(spark, d):
    return merge_replay.encode(table(spark, d, "documents"))


def p8_found(spark, d):
    return mixture.short_sources(table(spark, d, "documents"), table(spark, d, "mix_plan"))


def p8_selection(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_plan"))[0]


def p8_report(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_plan"))[1]


def p9_found(spark, d):
    return repetition.repetition(table(spark, d, "documents")).filter("anomalous and share >= 0.3").select("doc_id")


def p9_repetition(spark, d):
    return repetition.repetition(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_ppmi, p3_found, p3_text, p4_found, p4_frequencies, p5_found, p5_clusters, p5_typical, p5_compared, p6_found, p6_neighbors, p7_ids, p8_found, p8_selection, p8_report, p9_found, p9_repetition)}

_TF = """
text_of AS (SELECT doc_id, max(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
raw AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM text_of WHERE text IS NOT NULL),
counted AS (SELECT doc_id, term, count(*) AS n FROM raw GROUP BY doc_id, term),
stored AS (SELECT doc_id, lower(trim(term)) AS term, max(tf) AS tf FROM postings WHERE doc_id IS NOT NULL AND trim(term) <> '' GROUP BY 1, 2),
tf AS (SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(s.term, c.term) AS term,
              CAST(CASE WHEN s.tf > 0 THEN s.tf ELSE coalesce(c.n, 0) END AS BIGINT) AS tf
       FROM stored s FULL JOIN counted c ON s.doc_id = c.doc_id AND s.term = c.term),
used AS (SELECT * FROM tf WHERE tf > 0),
terms AS (SELECT term, count(*) AS pages, CAST(sum(tf) AS BIGINT) AS total FROM used GROUP BY term)
"""
_VECTORS = """
usable AS (SELECT id, min(CAST(embedding AS FLOAT[64])) AS v FROM image_vectors
           WHERE id IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x)), true)
             AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, round(array_distance(a.v, b.v) * array_distance(a.v, b.v)) AS d FROM usable a JOIN usable b ON a.id <> b.id),
near AS (SELECT a, b, d FROM pairs WHERE d <= 8000)
"""
SQL = {
    "p1_found": """
WITH best AS (SELECT r.query_no, r.list_id, r.id, min(r.dist) AS dist FROM ranked r
              LEFT JOIN (SELECT DISTINCT list_id FROM score_lists WHERE is_image) i ON r.list_id = i.list_id
              LEFT JOIN (SELECT DISTINCT query_no FROM text_queries WHERE alpha > 0 AND NOT isnan(alpha)) g ON r.query_no = g.query_no
              WHERE r.dist IS NOT NULL AND NOT isnan(r.dist) AND (i.list_id IS NULL OR g.query_no IS NOT NULL)
              GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_no, list_id ORDER BY dist, id) AS r FROM best),
n AS (SELECT query_no, count(DISTINCT list_id) AS lists FROM best GROUP BY query_no)
SELECT query_no, id FROM ranks JOIN n USING (query_no) WHERE r <= 5 AND lists >= 2
GROUP BY query_no, id, lists HAVING count(*) = lists""",
    "p2_found": f"WITH {_TF} SELECT doc_id, term FROM used JOIN terms USING (term) WHERE tf >= 4 AND pages BETWEEN 2 AND 12",
    "p2_ppmi": f"""
WITH {_TF}, lens AS (SELECT doc_id, sum(tf) AS len FROM used GROUP BY doc_id),
whole AS (SELECT sum(len) AS n, sum(pow(len, 0.75)) AS smooth FROM lens)
SELECT doc_id, term, tf, pages, total, round(greatest(0, ln((tf / n) / ((total / n) * (pow(len, 0.75) / smooth)))), 6) AS ppmi
FROM used JOIN terms USING (term) JOIN lens USING (doc_id), whole""",
    "p4_frequencies": f"""
WITH {_TF}, n AS (SELECT count(DISTINCT doc_id) AS n FROM used)
SELECT term, total AS occurrences, pages, CASE WHEN pages < 3 OR total < 5 THEN 'rare' WHEN pages > 0.3 * n THEN 'common' END AS mark FROM terms, n""",
    "p4_found": f"""
WITH {_TF}, n AS (SELECT count(DISTINCT doc_id) AS n FROM used)
SELECT term, CASE WHEN pages < 3 OR total < 5 THEN 'rare' ELSE 'common' END AS mark FROM terms, n WHERE pages < 3 OR total < 5 OR pages > 0.3 * n""",
    "p5_found": f"""
WITH {_VECTORS}, heads AS (SELECT id, least(id, coalesce(min(b), id)) AS head_id FROM usable LEFT JOIN near ON id = a GROUP BY id)
SELECT id, head_id FROM heads WHERE head_id IN (SELECT head_id FROM heads GROUP BY head_id HAVING count(*) >= 5)""",
    "p5_clusters": f"""
WITH {_VECTORS}, heads AS (SELECT id, least(id, coalesce(min(b), id)) AS head_id FROM usable LEFT JOIN near ON id = a GROUP BY id),
x AS (SELECT head_id, i, CAST(v[i] AS DOUBLE) AS x FROM heads JOIN usable USING (id), range(1, 65) r(i)),
s AS (SELECT head_id, sum(x * x) - sum(x) * sum(x) / count(*) AS e FROM x GROUP BY head_id, i),
e AS (SELECT head_id, sum(e) AS inertia FROM s GROUP BY head_id)
SELECT head_id, n AS size, round(inertia, 1) AS inertia FROM e JOIN (SELECT head_id, count(*) AS n FROM heads GROUP BY head_id) USING (head_id)""",
    "p6_found": f"""
WITH {_VECTORS}, best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM near)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best WHERE r <= 5""",
    "p9_found": """
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
f AS (SELECT *, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g),
m AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM f WHERE i > first) GROUP BY doc_id)
SELECT doc_id FROM w JOIN m USING (doc_id) WHERE c / len(w) >= 0.3""",
}
