"""A state of several tables that is replaced as a whole: a version is there when its marker is, and a broken one is refused.

Writers put the tables of version n + 1 beside those of version n and name their rows in a marker last, so a lost driver or executor leaves the version before. Readers take the
latest version with a marker and compare its files with what the marker says.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MARKER = "complete.json"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of complete versions in a folder."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(_files(spark, f"{folder}/{n}/{MARKER}")[0]))


def write_version(folder: str, tables: dict[str, DataFrame], keep: int = 2) -> int:
    """Write the tables as the next version and give its number; all but the last `keep` complete versions are deleted."""
    spark = next(iter(tables.values())).sparkSession
    done = versions(spark, folder)
    number = (done[-1] if done else 0) + 1
    rows = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/v{number}/{name}")  # what a lost writer left is replaced
        rows[name] = spark.read.parquet(f"{folder}/v{number}/{name}").count()
    path, files = _files(spark, f"{folder}/v{number}/{MARKER}")
    half = _files(spark, f"{folder}/v{number}/{MARKER}.part")[0]
    out = files.create(half, True)
    out.write(bytearray(json.dumps({"version": number, "rows": rows}, sort_keys=True).encode()))
    out.close()
    if not files.rename(half, path):
        raise OSError(f"version {number} of {folder} could not be completed")
    for old in versions(spark, folder)[:-keep]:
        files.delete(_files(spark, f"{folder}/v{old}")[0], True)
    return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame] | None:
    """The tables of a version, by default the latest; None where there is none. A version whose tables are not those of its marker raises."""
    done = versions(spark, folder)
    if number is None and not done:
        return None
    number = done[-1] if number is None else number
    if number not in done:
        raise ValueError(f"{folder} has no version {number}")
    marker = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/v{number}/{MARKER}").collect()))  # a line
    tables = {name: spark.read.parquet(f"{folder}/v{number}/{name}") for name in marker["rows"]}
    for name, table in tables.items():
        if table.count() != marker["rows"][name]:
            raise ValueError(f"version {number} of {folder} is broken: {name}")
    return tables
