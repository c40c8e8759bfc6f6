"""Versioned snapshots: the tables of a version in a folder of their own, and a pointer that is moved in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _pointer(spark: SparkSession, root: str) -> dict:
    fs, _, jvm = _fs(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not fs.exists(at):
        return {"tables": {}, "meta": {}}
    stream = fs.open(at)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict, added: dict[str, DataFrame] | None = None, by: dict[str, str] | None = None) -> str:
    """Writes a new version, then moves the pointer. Readers see the old version or the new one; a version that failed half-way is never pointed
    at.

    ``tables`` are written whole; of ``added`` only the new rows are, beside those of the version before, and tables that aren't named stay. ``by``
    names the column whose values are a table's folders.
    """
    version, current = uuid.uuid4().hex, _pointer(spark, root)
    folders = {name: list(places) for name, places in current["tables"].items()}
    for name, df in (tables | (added or {})).items():
        place, column = f"{version}/{name}", (by or {}).get(name)
        (df.write.partitionBy(column) if column else df.write).parquet(f"{root}/{place}")
        folders[name] = [*(folders.get(name, []) if added and name in added else []), place]
    fs, _, jvm = _fs(spark, root)
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{root}/{x}") for x in (f".{version}", POINTER))
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version, "tables": folders, "meta": current["meta"] | meta}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, pointer, options)
    return version


def load(spark: SparkSession, root: str, dim: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, meta) of the current version; nothing published gives ({}, {}). Vectors made with another dimension than ``dim`` are refused."""
    current = _pointer(spark, root)
    meta = current["meta"]
    if dim is not None and meta.get("embedding_dim", dim) != dim:
        raise ValueError(f"the snapshot holds vectors of {meta['embedding_dim']} values, not {dim}")

    def read(places: list[str]) -> DataFrame:
        frames = [spark.read.parquet(f"{root}/{x}") for x in places]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    return {name: read(places) for name, places in current["tables"].items()}, meta


def clean(spark: SparkSession, root: str) -> list[str]:
    """Deletes the folders that the current version doesn't refer to: versions that failed half-way, and replaced tables. Returns their names."""
    used = {x for places in _pointer(spark, root)["tables"].values() for x in places}
    fs, at, _ = _fs(spark, root)
    gone = []
    for version in fs.listStatus(at):
        name = version.getPath().getName()
        if name == POINTER:
            continue
        inner = [x.getPath().getName() for x in fs.listStatus(version.getPath())] if version.isDirectory() else []
        if not any(f"{name}/{x}" in used for x in inner):
            fs.delete(version.getPath(), True)
            gone.append(name)
            continue
        for x in inner:
            if f"{name}/{x}" not in used:
                fs.delete(_fs(spark, f"{root}/{name}/{x}")[1], True)
                gone.append(f"{name}/{x}")
    return sorted(gone)
