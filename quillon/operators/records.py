"""Queries over stored benchmark records: gates, latest records, pairing, speedups, crossover, tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The field names of stored benchmark records.
_INDEX = "kind string, M long, ef_construction long, ef_search long, seed long, m long, rerank long, train_size long, kmeans_n_init long, lock_mode string, threads long, readers long"
_ENV = (
    "timestamp_utc string, hostname string, kernel string, cpu_model string, hw_threads long, free_disk_gb double, git_sha string, git_dirty boolean, git_note string, "
    "build_type string, compiler string, cxx_flags string, sanitizers string, trusted boolean, untrusted_reason string"
)
_MEASURED = (
    "recall_at_k double, qps_mean double, qps_stddev double, total_ms double, latency_mean_ms double, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double, latency_max_ms double, "
    "build_ms double, train_ms double, encode_ms double, save_ms double, load_ms double, rebuild_over_load double, index_bytes long, graph_bytes long, vector_bytes long, code_bytes long, codebook_bytes long, file_bytes long, "
    "bytes_per_vector double, compression_ratio double, reconstruction_mse double, centroids long, kmeans_iters long, empty_cluster_reseeds long, max_level long, mean_degree_layer0 double, distance_calls_per_query double, "
    "speedup double, efficiency double, inserts_attempted long, inserts_completed long, insert_p50_ms double, insert_p99_ms double, insert_max_ms double, starved boolean, results_compared long, results_mismatched long, "
    "ab_flat_bytes long, ab_naive_bytes long, ab_flat_seq_qps double, ab_naive_seq_qps double, ab_flat_rand_qps double, ab_naive_rand_qps double"
)
RECORD = (
    "tag string, index string, dataset_base string, dataset_query string, dataset_truth string, n_base long, n_queries long, dim long, k long, trials long, warmup long, load_ms double, peak_rss_mib double, "
    f"index_params struct<{_INDEX.replace(' ', ':').replace(',:', ',')}>, env struct<{_ENV.replace(' ', ':').replace(',:', ',')}>, measurements struct<{_MEASURED.replace(' ', ':').replace(',:', ',')}>"
)


@contextmanager
def _exact_names(spark):
    """Tells ``M`` (links of a graph node) from ``m`` (subspaces) while a plan is made."""
    was = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", was)


def read_records(spark, path: str) -> DataFrame:
    """Records of a JSON lines file; a malformed line is an error. The file's ``index_params.M`` is called ``graph_m`` here, since
    column names are not told apart by case."""
    with _exact_names(spark):
        rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
        names = [x.split()[0] for x in _INDEX.split(", ")]
        held = F.struct(*[F.col("index_params").getField(n).alias("graph_m" if n == "M" else n) for n in names])
        return rows.withColumn("index_params", F.when(F.col("index_params").isNotNull(), held))


def append_records(records: DataFrame, path: str) -> None:
    """Adds records as JSON lines, ``index_params.graph_m`` as ``M``."""
    with _exact_names(records.sparkSession):
        kind = records.schema["index_params"].dataType if "index_params" in records.columns else None
        if kind is not None and "graph_m" in kind.names:
            held = F.struct(*[F.col("index_params").getField(n).alias("M" if n == "graph_m" else n) for n in kind.names])
            records = records.withColumn("index_params", F.when(F.col("index_params").isNotNull(), held))
        records.write.mode("append").json(path)


#: Without these fields a record is of an older form and can't be reported.
REQUIRED = ("index", "index_params", "measurements", "n_base", "env")


def publishable(rows: DataFrame, *, trusted_only: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """Records that may be reported: trusted, with every required field, of none of the kinds in ``without``."""
    if trusted_only:
        rows = rows.filter(F.coalesce(F.col("env.trusted"), F.lit(False)))
    for field in REQUIRED:
        rows = rows.filter(F.col(field).isNotNull())
    return rows.filter(~F.coalesce(F.col("index_params.kind"), F.lit("")).isin(list(without))) if without else rows


def largest_base(rows: DataFrame, size: str = "n_base") -> DataFrame:
    """The rows of the largest ``size``."""
    return rows.join(F.broadcast(rows.agg(F.max(size).alias("_most"))), F.col(size) == F.col("_most")).drop("_most")  # one row


def curves(rows: DataFrame, keys: list[str], x: str, *ys: str) -> DataFrame:
    """One row a group with its points (x, *ys) as an array in numeric order of x: the points of a curve are few."""
    points = F.struct(F.col(x).alias("x"), *[F.col(y).alias(f"y{i}") for i, y in enumerate(ys)])
    return rows.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(points)).alias("points"))


def trial_rates(trials: DataFrame, keys: list[str], count: str, ms: str) -> DataFrame:
    """Queries a second over trials: mean, sample deviation (0 for one trial), best time."""
    qps = F.col(count) / F.col(ms) * 1000
    return trials.filter(F.col(ms) > 0).groupBy(*keys).agg(F.count("*").alias("trials"), F.round(F.avg(qps), 6).alias("qps_mean"), F.round(F.coalesce(F.stddev_samp(qps), F.lit(0.0)), 6).alias("qps_stddev"), F.min(ms).alias("best_ms"))


def environment(spark, path: str = ".") -> DataFrame:
    """One row about where a run took place, with the fields of a record's ``env`` that can be known here and the peak
    memory; what can't be found is null, "unknown" for the commit, with ``git_note`` saying why. Files below
    ``results`` are output and make no tree dirty."""
    import os
    import platform
    import resource
    import shutil
    import subprocess
    from datetime import datetime, timezone

    note, sha, dirty = None, "unknown", False
    try:
        git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, timeout=10, check=True, cwd=path).stdout.strip()
        sha, dirty = git("rev-parse", "--short", "HEAD"), bool(git("status", "--porcelain", "--", ":!results"))
    except (OSError, subprocess.SubprocessError) as e:
        note = str(e)[:200]
    try:
        with open("/proc/cpuinfo") as f:
            cpu = next((x.split(":", 1)[1].strip() for x in f if x.startswith("model name")), None)
    except OSError:
        cpu = None
    row = (datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), platform.node(), platform.release(), cpu, os.cpu_count(), round(shutil.disk_usage(path).free / 2**30, 3), sha, dirty, note, "Release", f"python {platform.python_version()}, spark {spark.version}", "none", round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 3))
    kinds = "timestamp_utc string, hostname string, kernel string, cpu_model string, hw_threads long, free_disk_gb double, git_sha string, git_dirty boolean, git_note string, build_type string, compiler string, sanitizers string, peak_rss_mib double"
    found = spark.createDataFrame([row], kinds)
    reason = untrusted_reason(*(F.col(c) for c in ("git_sha", "git_dirty", "build_type", "sanitizers", "git_note")))
    return found.withColumn("untrusted_reason", F.coalesce(reason, F.lit(""))).withColumn("trusted", F.col("untrusted_reason") == "")


def untrusted_reason(sha: Column, dirty: Column, build: Column, sanitizers: Column, note: Column | None = None) -> Column:
    """Why a record can't be published; null if it can. The commit is "unknown" where none was found, sanitizers are
    "none" in an ordinary build; a null is not taken for good."""
    note = F.coalesce(note, F.lit("")) if note is not None else F.lit("")
    build, sanitizers, sha = (F.coalesce(c, F.lit("unknown")) for c in (build, sanitizers, sha))
    no_commit = F.when(note == "", F.lit("git SHA could not be resolved")).otherwise(F.concat(F.lit("git SHA could not be resolved: "), note))
    return (
        F.when(build != "Release", F.concat(F.lit("build type is "), build, F.lit(", not Release")))
        .when(sanitizers != "none", F.concat(F.lit("built with sanitizers ("), sanitizers, F.lit(")")))
        .when(sha.isin("unknown", ""), no_commit)
        .when(F.coalesce(dirty, F.lit(True)), "working tree is dirty")
    )


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_nth = 1").drop("_nth")


def paired(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, a, b, ratio) of the last rows of both sides with the same key."""
    left = latest_per_key(a, [key], order).select(key, F.col(value).alias("a"))
    right = latest_per_key(b, [key], order).select(key, F.col(value).alias("b"))
    return left.join(right, key).select(key, "a", "b", F.round(F.when(F.col("b") != 0, F.col("a") / F.col("b")), 6).alias("ratio"))


def scaling(rows: DataFrame, group: str, threads: str = "threads", qps: str = "qps") -> DataFrame:
    """Adds speedup over the group's first row by threads, and efficiency."""
    first = F.first(qps).over(Window.partitionBy(group).orderBy(threads).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("speedup", F.round(F.col(qps) / first, 6)).withColumn("efficiency", F.round(F.col(qps) / first / F.col(threads), 6))


def crossover(points: DataFrame) -> DataFrame:
    """(n_low, n_high, n_cross): where speedup (n, speedup) first passes 1, interpolated on a logarithmic scale. The
    sizes of a sweep are few, so one task may order them."""
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    pairs = points.select("n", "speedup", F.lead("n").over(w).alias("n2"), F.lead("speedup").over(w).alias("s2")).filter("speedup < 1 and s2 >= 1")
    cross = F.exp(F.log("n") + (1 - F.col("speedup")) / (F.col("s2") - F.col("speedup")) * (F.log("n2") - F.log("n")))
    return pairs.orderBy("n").limit(1).select(F.col("n").alias("n_low"), F.col("n2").alias("n_high"), F.round(cross, 6).alias("n_cross"))


def markdown(rows: DataFrame, columns: list[str], most: int = 10_000) -> str:
    """The rows as a markdown table, in their order. More than ``most`` rows are an error: a table is for reading."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a table of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)])


def summary_json(rows: DataFrame) -> str:
    """One row as a JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).first()[0]


def measure(search, queries: DataFrame, k: int, trials: int = 5, warmup: int = 1) -> DataFrame:
    """(trial, queries, ms) of ``search(queries, k)``, run whole ``warmup`` times uncounted and ``trials`` times counted."""
    import time

    n, took = queries.count(), []
    for t in range(warmup + trials):
        began = time.perf_counter()
        search(queries, k).write.format("noop").mode("overwrite").save()
        took.append((t - warmup, n, (time.perf_counter() - began) * 1000))
    return queries.sparkSession.createDataFrame(took[warmup:], "trial int, queries long, ms double")


def sweep(vectors: DataFrame, queries: DataFrame, sizes: list[int], first, second, k: int = 10, trials: int = 3) -> DataFrame:
    """(n, speedup) for ``crossover``: the best time of ``first(vectors)`` over that of ``second(vectors)`` on the ``n``
    smallest ids; both make a search of (queries, k)."""
    out = []
    for n in sizes:
        part = vectors.orderBy("id").limit(n)
        a, b = (measure(make(part), queries, k, trials).agg(F.min("ms")).first()[0] for make in (first, second))
        out.append((n, a / b))
    return vectors.sparkSession.createDataFrame(out, "n long, speedup double")
