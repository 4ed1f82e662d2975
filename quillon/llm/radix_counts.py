"""Frequencies of every distinct term by recursive radix spilling.

Rows go to disk in partitions named by hash bits of the term. A partition above the row bound is split by the
next bits and, when the term's bits no longer part it (one hot term), by bits of (term, doc_id). Each final
partition is aggregated out of core by DuckDB in one task; a term split over several partitions is summed at
the end, which is exact since a (term, doc_id) lies in one partition only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import scratch, shared_dir
from .page_terms import term_rows

AGGREGATE = """
SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS pages FROM (
  SELECT term, doc_id, CASE WHEN max(stored) > 0 THEN max(stored) ELSE max(counted) END AS tf
  FROM spilled GROUP BY term, doc_id
) WHERE tf > 0 GROUP BY term
"""


def _bits(level: int, width: int) -> Column:
    """Bits of a partition's name at a level: of the term at the first two, then of (term, doc_id)."""
    h = F.xxhash64("term", F.lit(97)) if level < 2 else F.xxhash64("term", "doc_id", F.lit(level))
    return F.pmod(F.shiftright(h, width * level if level < 2 else 0), F.lit(1 << width)).cast("int")


def spill(rows: DataFrame, most_rows: int, width: int, files: int | None = None) -> tuple[list[str], DataFrame]:
    """Writes ``rows`` by recursive radix partitioning; the folders of the final partitions, and all their rows.

    A partition is written by ``files`` tasks, by default so many that each shuffle partition writes."""
    spark = rows.sparkSession
    files = files or max(8, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) >> width))
    leaves: list[str] = []
    final = spark.createDataFrame([], rows.schema)
    todo, level = rows, 0
    while todo is not None and level < 12:
        path = scratch(spark, f"radix-{level}")
        named = todo.withColumn("radix", _bits(level, width) if level == 0 else F.concat_ws("_", F.col("radix").cast("string"), _bits(level, width).cast("string")))
        salt = F.pmod(F.xxhash64("doc_id", "term"), F.lit(files))  # a hot partition is written by several tasks
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        named.repartition(max(parts, 1), "radix", salt).write.partitionBy("radix").parquet(path)
        held = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, radix string").parquet(path)
        counts = held.groupBy("radix").count().collect()  # one row for each partition
        over = [r["radix"] for r in counts if r["count"] > most_rows and level < 11]
        leaves += [f"{path}/radix={r['radix']}" for r in counts if r["radix"] not in set(over)]
        final = final.unionByName((held.filter(~F.col("radix").isin(over)) if over else held).drop("radix"))  # prunes folders
        todo = held.filter(F.col("radix").isin(over)) if over else None
        level += 1
    return leaves, final


def aggregate(spark, leaves: list[str], memory: str) -> DataFrame:
    """(term, occurrences, pages) of each final partition, by DuckDB."""
    spilling = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    spilling = "" if "://" in spilling else f"{spilling}/duckdb"  # an object store has no place to spill to: partitions are bounded

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for leaf in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(leaf) if "://" in leaf or leaf.startswith("file:") else (fs.LocalFileSystem(), leaf)
                source = ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=False)
                con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spilling})
                spilled = source.scanner(columns=["term", "doc_id", "stored", "counted"]).to_reader()
                con.register("spilled", spilled)
                yield from con.sql(AGGREGATE).to_arrow_table().to_batches(max_chunksize=20_000)
                con.close()

    schema = "term string, occurrences long, pages long"
    if not leaves:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(x,) for x in leaves], "leaf string").repartitionByRange(len(leaves), "leaf")
    return listed.mapInArrow(of, schema)


def term_frequencies(postings: DataFrame, corpus: DataFrame, rare_pages: int = 3, rare_occurrences: int = 5, common_share: float = 0.3, most_rows: int = 2_000_000, width: int | None = None, memory: str = "400MB") -> DataFrame:
    """(term, occurrences, pages, mark) of every term of the postings and of the texts.

    ``mark`` is 'rare' (in fewer than ``rare_pages`` pages or with fewer than ``rare_occurrences``
    occurrences), 'common' (not rare and in more than ``common_share`` of the pages that have any term) or
    null. A term is lower case without outer blanks; a (term, doc_id) counts once; a stored tf that is null, 0
    or negative is replaced by the text's count, and without one the term does not occur there. Null keys
    are ignored, empty tables give no rows.

    A final partition has at most ``most_rows`` rows, the first split about as many parts as that takes.
    """
    spark = postings.sparkSession
    rows = term_rows(postings, corpus)
    if width is None:
        guess = max(1, postings.count()) * 2  # the text has about as many (term, page) again
        width = min(8, max(3, ceil(log2(guess / most_rows * 2)) if guess > most_rows else 3))
    leaves, held = spill(rows, most_rows, width)
    terms = aggregate(spark, leaves, memory).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages"))
    pages = held.filter("stored > 0 or counted > 0").select("doc_id").distinct().agg(F.count("*").alias("all"))
    rare = (F.col("pages") < rare_pages) | (F.col("occurrences") < rare_occurrences)
    mark = F.when(rare, "rare").when(F.col("pages") > common_share * F.col("all"), "common")
    return terms.crossJoin(F.broadcast(pages)).select("term", "occurrences", "pages", mark.alias("mark"))  # one row
