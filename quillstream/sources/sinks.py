"""Sinks: write-once tables, manifests, content-addressed files, event exports."""

from __future__ import annotations

import hashlib
import html
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.selection import set_digest


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a table where nothing stands yet; an existing path is an error."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_several(parts: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Several named outputs of one run, each write-once."""
    for name, df in parts.items():
        write_once(df, f"{path.rstrip('/')}/{name}", fmt)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a table that only grows; readers see whole appends, as files appear when they are complete."""
    df.write.mode("append").format(fmt).save(path)


def snapshot_inputs(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """(path, copy, sha256): input files copied beside a run, each copy read back and told by the same digest or an error."""
    files = spark.read.format("binaryFile").load(paths)
    return content_store(files.select("path", "content"), target)


def content_store(files: DataFrame, target: str) -> DataFrame:
    """(path, copy, sha256) of the files (path, content) stored by content: <sha256><extension> in the target folder, once each.

    The executors write the copies, one per content, and read them back; a copy that differs is an error. Existing copies of
    the same content are left as they are.
    """
    named = files.withColumn("sha256", F.sha2("content", 256))
    one = named.groupBy("sha256").agg(F.min("path").alias("first"))
    name = F.concat("sha256", F.lower(F.regexp_extract("first", r"(\.[A-Za-z0-9]+)$", 1)))
    listed = named.select("path", "sha256").join(one.select("sha256", name.alias("name")), "sha256")
    folder = Path(target.removeprefix("file://"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder.mkdir(parents=True, exist_ok=True)
        for pdf in batches:
            for name_, sha, content in zip(pdf["name"], pdf["sha256"], pdf["content"]):
                copy = folder / name_
                if not copy.exists():
                    part = copy.with_name(f"{name_}.{uuid.uuid4().hex}.part")
                    part.write_bytes(content)
                    os.replace(part, copy)
                if hashlib.sha256(copy.read_bytes()).hexdigest() != sha:
                    raise ValueError(f"{copy} differs from its name")
            yield pdf[["sha256", "name"]]

    firsts = named.join(one.select("sha256", F.col("first").alias("path"), name.alias("name")), ["sha256", "path"]).dropDuplicates(["sha256"])
    stored = firsts.select("name", "sha256", "content").mapInPandas(put, "sha256 string, name string")
    return listed.join(stored, ["sha256", "name"]).select("path", F.concat(F.lit(f"{target.rstrip('/')}/"), "name").alias("copy"), "sha256")


def export_events(events: DataFrame, order: str, path: str) -> None:
    """Write-once JSON lines of an event log, sorted by its sequence within and across the files."""
    write_once(events.repartitionByRange(F.col(order)).sortWithinPartitions(order), path)


def markdown_table(rows: DataFrame, columns: list[str], most: int) -> str:
    """A Markdown table of a small result, cells escaped; more rows than `most` are an error."""
    found = rows.select(*[F.col(c).cast("string") for c in columns]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows in a report")
    cell = lambda v: "" if v is None else html.escape(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in found)]) + "\n"


def manifest(df: DataFrame) -> DataFrame:
    """(file, rows, content_sha256) per input file of a table read from files: order-free digest of its rows."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    per_row = df.select(F.input_file_name().alias("file"), row.alias("row"))
    return per_row.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), set_digest(F.col("row")).alias("content_sha256"))


def content_addressed(files: DataFrame) -> DataFrame:
    """(sha256, name, paths): one entry per distinct content, named <sha256>.<extension of its first path>."""
    one = files.groupBy("sha256").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("paths"))
    return one.select("sha256", F.concat("sha256", F.lower(F.regexp_extract("first", r"(\.[A-Za-z0-9]+)$", 1))).alias("name"), "paths")


def report_link(url):
    """The URL if it is an https link to a video host, else null; for reports."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(url.startswith("https://") & host.isin("www.youtube.com", "youtube.com", "youtu.be", "m.youtube.com"), url)
