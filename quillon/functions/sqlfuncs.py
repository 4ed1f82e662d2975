"""SQL functions of a session: scalar ones are inlined by the optimizer, ``knn`` is a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCALARS = {
    "l2_sq": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)"),
    "neg_ip": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "-aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"),
    "ascii_tokens": ("t STRING", "ARRAY<STRING>", "transform(regexp_extract_all(coalesce(t, ''), '([A-Za-z0-9]+)', 1), x -> lower(x))"),
    "bm25_idf": ("n DOUBLE, df DOUBLE", "DOUBLE", "ln(1 + (n - df + 0.5) / (df + 0.5))"),
    "rrf": ("k DOUBLE, rank DOUBLE", "DOUBLE", "1.0D / (k + rank)"),
}


def register(spark: SparkSession, vectors: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding", k: int = 10) -> None:
    """Defines SCALARS and, with ``vectors``, ``knn_at(qv)``: the k nearest (id, dist), for LATERAL joins."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    if vectors is not None:
        vectors.selectExpr(f"{id_col} AS id", f"{vector_col} AS embedding").createOrReplaceTempView("quillon_vectors")
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION knn_at(qv ARRAY<FLOAT>) RETURNS TABLE(id BIGINT, dist DOUBLE) RETURN "
            f"SELECT id, round(l2_sq(qv, embedding), 6) AS dist FROM quillon_vectors WHERE embedding IS NOT NULL ORDER BY dist, id LIMIT {int(k)}"
        )
