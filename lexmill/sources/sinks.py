"""Sinks: CSV, JSON Lines, append logs, wide tables, content-addressed files, rating packets. No input is ever overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str], quote_all: bool = False) -> None:
    """Columns in the given order, others left out; nested columns as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    df.select(*[(F.to_json(c) if c in nested else F.col(c)).alias(c) for c in columns]).write.csv(path, header=True, quoteAll=quote_all, escape='"')


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds rows to a log; it is put in order when read."""
    df.write.mode("append").format(kind).save(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def wide(df: DataFrame, key: str, name: str, value: str, most: int = 1000) -> DataFrame:
    """A column for each name, commonest first (ties by name), holding the key's first value of it; names are counted first."""
    names = [r[0] for r in df.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError("more names than a wide table has columns for")
    return df.groupBy(key).pivot(name, names).agg(F.min(value))


def content_addressed(df: DataFrame, content: str) -> DataFrame:
    """Adds sha256, bytes and extension of each content: what a store keeps a file under."""
    from lexmill.functions.text import file_kind, soft_404

    c = F.col(content)
    kind = file_kind(c.cast("string"))
    return df.withColumn("sha256", F.sha2(c.cast("binary"), 256)).withColumn("bytes", F.octet_length(c)).withColumn("kind", kind).withColumn("soft_404", soft_404(c.cast("string")))


def versioned(df: DataFrame, root: str, version: str) -> str:
    """Writes a new version beside the old ones and returns its path."""
    path = f"{root}/version={version}"
    df.write.parquet(path)
    return path


def packet(df: DataFrame, path: str, title: str, fields: Sequence[str]) -> None:
    """A Markdown section for each row."""
    parts = [F.concat(F.lit(f"**{f}**\n\n> "), F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n")) for f in fields]
    df.select(F.concat(F.lit("## "), F.col(title).cast("string"), F.lit("\n\n"), *parts).alias("value")).write.text(path)


def citations(df: DataFrame, path: str, keys: Sequence[str], column: str) -> None:
    """A row for each element of an array, tab-separated."""
    df.select(*keys, F.explode(column).alias("citation")).write.csv(path, sep="\t", header=True)


def rating_sheet(manifest: DataFrame, questions: DataFrame, references: DataFrame, answers: DataFrame, scores: DataFrame, key: str, judges: Sequence[str]) -> DataFrame:
    """The manifest with question, reference, answer and a column for each judge's score, all by key; what is missing is null."""
    out = manifest.join(questions, key, "left").join(references, key, "left").join(answers, key, "left")
    return out.join(scores.groupBy(key).pivot("judge", list(judges)).agg(F.avg("score")), key, "left")


#: Files that the driver writes one by one, at most.
MOST_FILES = 10_000


def named_files(spark, folder: str, files: dict[str, str]) -> None:
    """Small files under names of their own, by the session's file system; for reports and single documents, not for tables."""
    if len(files) > MOST_FILES:
        raise ValueError("more files than the driver writes one by one")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, content in files.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()


def save_json(spark, folder: str, name: str, value) -> None:
    """A value as one JSON document."""
    import json

    named_files(spark, folder, {name: json.dumps(value, ensure_ascii=False, sort_keys=True)})


def write_once(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """JSON Lines beside what is there: a log that only grows."""
    df.select(*columns).write.mode("append").json(path)
