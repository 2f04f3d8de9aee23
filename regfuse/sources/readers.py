"""Readers of the raw formats and writers of results."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",", quote: str = '"', comment: str | None = None, null: str | None = None, encoding: str = "UTF-8", drop_malformed: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Delimited text, plain or gzipped. Without a schema all columns are text: types are never guessed from data."""
    options = {"header": "true", "sep": sep, "quote": quote, "escape": quote, "encoding": encoding, "mode": "DROPMALFORMED" if drop_malformed else "PERMISSIVE", "enforceSchema": "false"}
    if comment:
        options["comment"] = comment
    if null is not None:
        options["nullValue"] = null
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def read_json_nested(spark: SparkSession, path: str, root: str, sep: str = "_") -> DataFrame:
    """The records of the array ``root`` of JSON documents, nested fields joined by ``sep``; arrays stay."""
    df = spark.read.option("multiLine", "true").json(path).select(F.explode(root).alias("_r"))
    return flatten(df.select("_r.*"), sep)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """``df`` with the fields of its structs as columns, at any depth."""
    def walk(kind, prefix, path):
        for f in kind.fields:
            name, at = prefix + f.name, f"{path}`{f.name}`"
            if f.dataType.typeName() == "struct":
                yield from walk(f.dataType, name + sep, at + ".")
            else:
                yield F.col(at).alias(name)

    return df.select(*walk(df.schema, "", ""))


def zip_members(path: str, suffixes: list[str] | None = None, to: str | None = None) -> dict[str, str]:
    """The CSV members of an archive, unpacked beside it (or into ``to``), by name; only those ending in a suffix."""
    out = {}
    to = to or path + ".members"
    os.makedirs(to, exist_ok=True)
    with zipfile.ZipFile(path) as z:
        for m in z.namelist():
            if m.endswith("/") or suffixes and not any(os.path.splitext(m)[0].endswith(s) for s in suffixes):
                continue
            target = os.path.join(to, os.path.basename(m))
            with z.open(m) as src, io.open(target, "wb") as dst:
                while chunk := src.read(1 << 20):
                    dst.write(chunk)
            out[os.path.basename(m)] = target
    return out


def read_zip(spark: SparkSession, path: str, suffixes: list[str], columns: list[str], tag: str = "Filesuffix", where: str | None = None, **options) -> DataFrame:
    """The members of an archive one below the other, each with the wanted columns it has and its suffix as ``tag``.

    ``where`` filters every member before the union. Column pruning and pushdown are left to the optimizer."""
    out = None
    for name, file in sorted(zip_members(path, suffixes).items()):
        df = read_csv(spark, file, **options)
        df = df.select(*[c for c in columns if c in df.columns])
        if where:
            df = df.filter(where)
        stem = os.path.splitext(name)[0]
        df = df.withColumn(tag, F.lit(next(s for s in suffixes if stem.endswith(s))))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no member of {path} ends in {suffixes}")
    return out


def read_sheets(frames: list[DataFrame]) -> DataFrame:
    """Sheets with differing columns as one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, **options) -> DataFrame:
    """A worksheet over pandas; needs one of its Excel engines, which this package does not require."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str, **options))
    except ImportError as e:
        raise ImportError("reading worksheets needs an Excel engine for pandas; convert the file to CSV instead") from e


def or_archive(primary: Callable[[], DataFrame], archive: Callable[[], DataFrame]) -> DataFrame:
    """What ``primary`` gives, or ``archive`` if it fails (a service that is down, a file that is gone)."""
    try:
        df = primary()
        df.schema  # noqa: B018
        return df
    except Exception:
        return archive()


def cached(spark: SparkSession, folder: str, name: str, config: dict, make: Callable[[], DataFrame], update: bool = False) -> DataFrame:
    """``make()`` written as Parquet under its name and a digest of ``config``; read again if it is there already."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]
    path = f"{folder}/{name}-{digest}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if update or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("map", "array", "struct"))}
    (df.withColumns(nested) if nested else df).write.mode("overwrite").csv(path, header=True)


def append_locations(df: DataFrame, path: str) -> None:
    """Names with found positions appended to the stored ones."""
    df.select("Name", "Country", "lat", "lon").dropna().write.mode("append").parquet(path)


def parse_literal(c: str, kind: str = "map<string,array<string>>"):
    """A map or list written as text with single quotes and ``nan`` read back."""
    return F.from_json(F.regexp_replace(F.replace(F.replace(F.replace(F.col(c), F.lit("'"), F.lit('"')), F.lit("{\"nan\"}"), F.lit("[]")), F.lit("set()"), F.lit("[]")), r"\bnan\b", "null"), kind)
