"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder (tests, a laptop).
DEFAULT_SHARED = "file:///tmp/checkpoints"


def get_spark(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session has one below /tmp;
    a cluster's has none, which is an error, as executors wouldn't see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


class Workspace:
    """Tables written below the shared folder, so that lost executors never cost a recomputation from the source.

    What is left of them is deleted when the driver's JVM ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
        p, fs = self._at(self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def _at(self, path: str):
        """A path, and the file system that it is on."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Writes df as Parquet and reads it back; the schema is given, so that no job infers it."""
        df.write.option("compression", compression).parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for n in names:
            p, fs = self._at(self.at(n))
            fs.delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on executors unless their PYTHONPATH already has it."""
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or os.path.realpath(os.getcwd()) == root:
        return
    if getattr(sc, "_lexmill_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp())
    target = os.path.join(folder, "lexmill_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "lexmill")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    sc.addPyFile(target)
    sc._lexmill_shipped = True
