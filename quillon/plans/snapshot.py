"""Versioned snapshots of an index: parquet tables and a manifest that is written last.

A reader sees one whole version. Loading checks format, version, kind, and each table's rows and content hash.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "quillon-index", 1


class SnapshotError(ValueError):
    pass


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free hash) of a table; the xor of an array column's hash is that of its text."""
    cols = [F.to_json(F.struct(c)) for c in sorted(df.columns)]
    row = df.select(F.xxhash64(*cols).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod("h", F.lit(1_000_003))), F.lit(0)).alias("s")).first()
    return row["n"], row["x"] ^ row["s"]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, whole or not at all: written beside and renamed. One that is there stays and is an error."""
    fs, p, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(part, p):
        raise SnapshotError(f"can't publish {path}")


def versions(spark: SparkSession, root: str) -> int:
    """The newest published version, that is the highest with a manifest; 0 for none. There is no pointer to replace, so a
    reader always finds a version and a crash loses none."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return 0
    names = (s.getPath().getName() for s in fs.listStatus(p))
    known = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
    return next((v for v in known if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/v{v}/manifest.json"))), 0)


def save(tables: dict[str, DataFrame], root: str, kind: str, dim: int, params: dict | None = None, carry: dict | None = None) -> int:
    """Writes a new version and publishes it; returns its number. One writer at a time.

    ``carry`` has tables of an earlier version's manifest that stand unchanged: they are named again, not copied."""
    spark = next(iter(tables.values())).sparkSession
    version = versions(spark, root) + 1
    at = f"{root}/v{version}"
    held = dict(carry or {})
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        rows, mark = fingerprint(spark.read.schema(df.schema).parquet(f"{at}/{name}"))
        held[name] = {"at": f"v{version}/{name}", "rows": rows, "hash": mark, "schema": df.schema.json()}
    manifest = {"format": FORMAT, "version": VERSION, "kind": kind, "dim": dim, "params": params or {}, "tables": held}
    _write_text(spark, f"{at}/manifest.json", json.dumps(manifest))
    return version


def load(spark: SparkSession, root: str, kind: str, version: int | None = None, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) of a version, the newest by default. Anything missing, of another kind or changed is refused."""
    from pyspark.sql.types import StructType

    version = version or versions(spark, root)
    text = _read_text(spark, f"{root}/v{version}/manifest.json") if version else None
    if text is None:
        raise SnapshotError(f"{root} has no published version {version or ''}")
    try:
        manifest = json.loads(text)
    except ValueError as e:
        raise SnapshotError(f"the manifest of {root}/v{version} is damaged") from e
    for key, want in (("format", FORMAT), ("version", VERSION), ("kind", kind)):
        if manifest.get(key) != want:
            raise SnapshotError(f"{key} is {manifest.get(key)!r}, not {want!r}")
    tables = {}
    for name, held in manifest["tables"].items():
        df = spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(f"{root}/{held['at']}")
        if verify and fingerprint(df) != (held["rows"], held["hash"]):
            raise SnapshotError(f"table {name} of {root}/v{version} is not as it was written")
        tables[name] = df
    return tables, manifest
