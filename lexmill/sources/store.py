"""A content-addressed store, written in two phases: tasks stage packs of objects, the driver publishes them by one commit file.

root/objects has the packs (Parquet: digest, kind, bytes, content), root/commits a file for each run that says which packs
count, root/audit a row for each content that was offered, with what was decided. Packs that no commit names are no part of
the store: a job that fails leaves none, and one whose driver dies is cleared away by the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexmill.functions.text import file_kind, soft_404
from lexmill.sources.crawl import _file_system

OBJECTS = "digest string, kind string, bytes bigint, content binary"
_ARROW = pa.schema([("digest", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
#: Bytes of content that a task holds before it writes them to its pack.
GROUP = 32 << 20


class Staged(WriterCommitMessage):
    """What a task says to the driver: its pack's name and how many objects are in it, whatever their number."""

    def __init__(self, pack: str | None, objects: int):
        self.pack, self.objects = pack, objects


class PackWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """A pack with a name of its own in the job's staging folder; a task without rows writes none."""
        fs, root = _file_system(self.root)
        pack, held, size, n = f"{uuid.uuid4().hex}.parquet", [], 0, 0
        writer, out = None, None
        try:
            for batch in iterator:
                held.append(batch)
                size, n = size + batch.nbytes, n + batch.num_rows
                if n and (writer is None or size >= GROUP):
                    if writer is None:
                        fs.create_dir(f"{root}/_staging/{self.job}", recursive=True)
                        out = fs.open_output_stream(f"{root}/_staging/{self.job}/{pack}")
                        writer = pq.ParquetWriter(out, _ARROW, compression="zstd")
                    writer.write_table(pa.Table.from_batches(held).cast(_ARROW))
                    held, size = [], 0
            if held and n:
                writer.write_table(pa.Table.from_batches(held).cast(_ARROW))
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return Staged(pack if n else None, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves the packs to the objects and names them in a new commit file, which makes them count all at once."""
        fs, root = _file_system(self.root)
        packs = [m for m in messages if m is not None and m.pack]
        if packs:
            fs.create_dir(f"{root}/objects", recursive=True)
            fs.create_dir(f"{root}/commits", recursive=True)
            for m in packs:
                fs.move(f"{root}/_staging/{self.job}/{m.pack}", f"{root}/objects/{m.pack}")
            with fs.open_output_stream(f"{root}/commits/.{self.job}") as f:
                f.write(json.dumps({"packs": [m.pack for m in packs], "objects": sum(m.objects for m in packs)}).encode())
            fs.move(f"{root}/commits/.{self.job}", f"{root}/commits/{self.job}.json")
        self._clear(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = _file_system(self.root)
        self._clear(fs, root)

    def _clear(self, fs, root: str) -> None:
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{root}/_staging/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staging/{self.job}")


class ContentStore(DataSource):
    """format("content_store") of rows (digest, kind, bytes, content), each digest once, into `path`."""

    @classmethod
    def name(cls) -> str:
        return "content_store"

    def schema(self) -> str:
        return OBJECTS

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("a content store only grows")
        return PackWriter(self.options)


def committed(root: str) -> list[str]:
    """Names of the packs that count."""
    from pyarrow import fs as pafs

    fs, folder = _file_system(root)
    out = []
    for x in fs.get_file_info(pafs.FileSelector(f"{folder}/commits", allow_not_found=True)):
        if x.base_name.endswith(".json"):
            with fs.open_input_stream(x.path) as f:
                out += json.loads(f.read())["packs"]
    return sorted(out)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """(digest, kind, bytes, content) of all that the store has."""
    packs = [f"{root}/objects/{p}" for p in committed(root)]
    return spark.read.schema(OBJECTS).parquet(*packs) if packs else spark.createDataFrame([], OBJECTS)


def audit(spark: SparkSession, root: str) -> DataFrame:
    """(run, key, digest, kind, bytes, decision) of all that was ever offered."""
    return spark.read.schema("run string, key string, digest string, kind string, bytes bigint, decision string").json(f"{root}/audit")


def save(df: DataFrame, root: str, key: str, content: str, kind: str | None = None, refuse: Column | None = None) -> DataFrame:
    """Saves the contents of df that aren't in the store, and returns its audit rows of this run.

    A content is known by its SHA-256. What is decided for a row: `empty` (null or no bytes), `refused` (a page that says it
    isn't there, another kind than `kind` if one is asked for, or `refuse`), `exists` (in the store before), `duplicate` (a
    row with a smaller key has the same content), else `saved`. Null keys come first; of rows that share key and content one
    is saved. Nothing is written for what isn't saved but the audit row, and an empty df writes nothing.

    Copies are counted by digest before contents are shuffled: only the first row of a new digest goes to the writer.
    """
    from lexmill.session import Workspace

    spark, ws, run = df.sparkSession, Workspace(df.sparkSession, "store"), uuid.uuid4().hex
    c = F.col(content)
    text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) if dict(df.dtypes)[content] == "binary" else c
    bad = F.lit(False) if refuse is None else F.coalesce(refuse, F.lit(False))
    looked = df.select(F.col(key).alias("key"), c.cast("binary").alias("content"), file_kind(text).alias("kind"), soft_404(text).alias("gone"), bad.alias("bad"))
    decided = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty")
    wrong = F.coalesce("gone", F.lit(False)) | F.col("bad") | (F.lit(False) if kind is None else ~F.col("kind").eqNullSafe(F.lit(kind)))
    looked = looked.select("key", F.sha2("content", 256).alias("digest"), F.coalesce("kind", F.lit("other")).alias("kind"),
                           F.octet_length("content").cast("bigint").alias("bytes"), decided.when(wrong, "refused").alias("decision"), "content").withColumn("id", F.monotonically_increasing_id())
    looked = ws.write(looked, "looked")
    fresh = looked.where("decision is null")
    first = fresh.groupBy("digest").agg(F.min(F.struct(F.col("key").isNotNull().alias("named"), "key", "id")).alias("m"))
    there = objects(spark, root).select("digest", F.lit(True).alias("there"))
    first = ws.write(first.join(there, "digest", "left").select("digest", F.col("m.id").alias("first"), F.coalesce("there", F.lit(False)).alias("there")), "first")
    new = first.where("not there").select("digest", "first")
    wanted = fresh.join(new, (fresh["id"] == new["first"]) & (fresh["digest"] == new["digest"]), "left_semi")
    if not new.isEmpty():
        spark.dataSource.register(ContentStore)
        wanted.select("digest", "kind", "bytes", "content").write.format("content_store").mode("append").option("path", root).save()
    decision = F.coalesce("decision", F.when(F.col("there"), "exists").when(F.col("id") == F.col("first"), "saved").otherwise("duplicate"))
    # a digest with very many copies: adaptive execution splits it, as both sides are written tables
    out = looked.drop("content").join(first, "digest", "left").select(F.lit(run).alias("run"), F.col("key").cast("string").alias("key"), "digest", "kind", "bytes", decision.alias("decision"))
    out = ws.write(out, "audit")
    out.write.mode("append").json(f"{root}/audit")
    return out
