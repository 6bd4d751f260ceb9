"""Scans: CSV, JSON, JSON Lines, whole texts, nested manifests, binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources.schemas import SCHEMAS


def csv_rows(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; cells may hold line breaks. All columns are strings, blanks null; with a schema of SCHEMAS (or DDL) cells
    become its types, what doesn't parse null, and columns the file lacks null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    raw = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])
    return typed(raw, schema) if schema else raw


def typed(df: DataFrame, schema: str) -> DataFrame:
    """String columns in the types of a schema; absent ones null."""
    want = T._parse_datatype_string(SCHEMAS.get(schema, schema))
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])


def csv_by_model(spark: SparkSession, glob: str, pattern: str = r"([^/]+?)\.csv$", schema: str | None = None) -> DataFrame:
    """Many CSV files; adds model, taken from each file's name."""
    raw = spark.read.csv(glob, header=True, multiLine=True, escape='"', quote='"')
    cols = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns if c != "model"]
    slug = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("model")
    out = raw.select(*cols, slug)
    return typed(out, schema) if schema else out


def json_records(spark: SparkSession, paths: str | list[str], schema: str, key: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON arrays of records; with a key, the last record of equal keys wins and limit takes the first keys in order."""
    df = spark.read.schema(SCHEMAS.get(schema, schema)).json(paths, multiLine=True)
    if key:
        from lexmill.operators.relational import latest

        df = df.withColumn("__o", F.struct(F.col("_metadata.file_path").alias("p"), F.monotonically_increasing_id().alias("i")))
        df = latest(df, [key], [F.desc("__o")]).drop("__o")
    return df.orderBy(key).limit(limit) if key and limit else df


def content_type(path: Column, kinds: dict[str, str]) -> Column:
    """The kind whose suffix a file's name has, whatever the case; raises on others."""
    out = F.raise_error(F.concat(F.lit("unknown kind of file: "), path)).cast("string")
    for suffix, kind in kinds.items():
        out = F.when(F.lower(path).endswith(suffix.lower()), kind).otherwise(out)
    return out


def typed_tree(spark: SparkSession, root: str, kinds: dict[str, str], schema: str = "suitability_record") -> DataFrame:
    """All JSON files below root, with content_type by suffix and _file."""
    df = spark.read.schema(SCHEMAS.get(schema, schema)).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    return df.select("*", content_type(path, kinds).alias("content_type"), F.col("_metadata.file_name").alias("_file"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """JSON Lines; broken lines raise, or with tolerant are left out."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def json_any(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """JSON array or JSON Lines, told apart by the first character; fields: name in the file -> name wanted."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    df = spark.read.json(path, multiLine=bool(head) and head[0][0].lstrip().startswith("["))
    return df.withColumnsRenamed({k: v for k, v in fields.items() if k in df.columns})


def selections(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """A map of cases to chosen features, in long form: (key, dataset, case_id, fid, model, model_family, feature, importance, superset_index).

    mapping (feature, concept) renames features; a feature that it maps to null is dropped, one that it lacks stays.
    """
    chosen = "map<string,struct<model:string,model_family:string,feature:string,importance:int,superset_index:int>>"
    value = f"map<string,struct<dataset:string,case_id:bigint,superset:array<string>,features:{chosen}>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", value).alias("m"))
    cases = doc.select(F.explode("m").alias("key", "v"))
    out = cases.select("key", "v.dataset", "v.case_id", F.explode("v.features").alias("fid", "f")).select("key", "dataset", "case_id", "fid", "f.*")
    if mapping is None:
        return out
    m = mapping.select(F.col("feature").alias("__f"), "concept", F.lit(True).alias("__there"))
    out = out.join(m, F.col("feature") == F.col("__f"), "left").where("__there is null or concept is not null")
    return out.withColumn("feature", F.coalesce("concept", "feature")).drop("__f", "__there", "concept")


def manifest(spark: SparkSession, path: str, category: str) -> DataFrame:
    """A category's cases of a manifest, in either layout: cases, or pre_cutoff and post_cutoff_control with the arm that says so."""
    fields = T._parse_datatype_string(SCHEMAS["manifest_case"]).simpleString()
    doc = spark.read.text(path, wholetext=True)
    get = lambda k: F.from_json(F.get_json_object("value", f"$.{category}.{k}"), f"array<{fields}>")
    flat = doc.select(F.explode(get("cases")).alias("c")).select("c.*")
    pre = doc.select(F.explode(get("pre_cutoff")).alias("c")).select("c.*").withColumn("arm", F.lit("pre_cutoff"))
    post = doc.select(F.explode(get("post_cutoff_control")).alias("c")).select("c.*").withColumn("arm", F.lit("post_cutoff_control"))
    return flat.unionByName(pre).unionByName(post)


def whole_texts(spark: SparkSession, folders: Sequence[tuple[str, str]], least: int = 200) -> DataFrame:
    """(case_id, text, text_source): the first source, in the given order, whose file of a case has over `least` characters."""
    out = None
    for rank, (name, folder) in enumerate(folders):
        raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("case_id"), F.col("value").alias("text"))
        raw = raw.where(F.length("text") > least).select("case_id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("text_source"), "text").alias("x"))
        out = raw if out is None else out.unionByName(raw)
    best = out.groupBy("case_id").agg(F.min_by("x", "x.rank").alias("x"))
    return best.select("case_id", "x.text", "x.text_source")


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of binary documents by an extractor that gives a document's pages; e.g. one for PDF, where it is installed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, t) for p, c in zip(f["path"], f["content"], strict=True) for i, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def file_index(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(name, path): where a file of each name is, in the first folder that has it."""
    from lexmill.operators.relational import latest

    out = None
    for rank, folder in enumerate(folders):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.lit(rank).alias("rank"))
        out = f if out is None else out.union(f)
    named = out.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return latest(named, ["name"], [F.col("rank"), F.col("path")]).select("name", "path")


def hypotheticals(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario files: header fields and sections underlined with dashes."""
    raw = spark.read.text(folder, wholetext=True)
    head = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    part = lambda k: F.nullif(strip(F.regexp_extract("value", rf"(?s)(?:^|\n){k}[ \t]*\n-+[ \t]*\n(.*?)(?=\n[A-Z][A-Z ]+[ \t]*\n-+[ \t]*(?:\n|$)|$)", 1)), F.lit(""))
    cols = [head(k).alias(k.lower().replace(" ", "_")) for k in ("ID", "Source Folder", "Topic", "Difficulty", "Verdict")]
    cols += [part(k).alias(k.lower().replace(" ", "_")) for k in ("FACTS", "QUESTION", "ANSWER", "APPLICABLE STANDARD", "KEY FACTOR")]
    return raw.select(F.col("_metadata.file_name").alias("_file"), *cols)


def judgments(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON Lines of several judges; adds judge, the name of each file's folder."""
    df = spark.read.schema(schema).json(glob)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("judge"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; a section that the schema names and the document lacks is an error."""
    doc = spark.read.text(path, wholetext=True)
    want = T._parse_datatype_string(schema)
    out = doc.select(F.from_json("value", want).alias("v"))
    there = [F.when(F.get_json_object(doc["value"], f"$.{f.name}").isNull(), F.raise_error(F.lit(f"{f.name} is missing"))).otherwise(F.lit(True)) for f in want.fields]
    ok = doc.select(F.from_json("value", want).alias("v"), *[x.alias(f"__{i}") for i, x in enumerate(there)])
    return ok.where(F.expr(" and ".join(f"__{i}" for i in range(len(there))))).select("v.*") if there else out.select("v.*")


#: Files that the driver lists by name, at most.
MOST_FILES = 100_000


def files_with(spark: SparkSession, folder: str, part: str) -> list[str]:
    """Paths of a folder's files whose names hold a text; an error if there are none."""
    names = spark.read.format("binaryFile").load(folder).select("path").where(F.regexp_extract("path", r"([^/]+)$", 1).contains(part))
    found = sorted(r[0] for r in names.limit(MOST_FILES + 1).collect())
    if len(found) > MOST_FILES:
        raise ValueError("more files than the driver lists")
    if not found:
        raise FileNotFoundError(f"no file of {folder} holds {part!r}")
    return found


def refused(url: Column, hosts: Sequence[str]) -> Column:
    """Whether an address is on a host that asks not to be read, or below one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out
