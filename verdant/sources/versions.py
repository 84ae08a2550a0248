"""Tables kept as versions of parts.

A table is a folder ``v=<version>/part=<part>/…``. A batch writes the parts it
changed as a new version; the newest committed version of each part is the
table. A part that no batch changed is neither read nor written, a replayed
batch overwrites its own version and still reads what was there before it, and
``prune`` drops what newer versions replaced. Part names are letters, digits
and underscores, so that folder names need no escapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PART = "part"


class VersionedParts:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        """``schema``: the columns without the part, as DDL."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), T.StructType.fromDDL(schema)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, path: str, prefix: str) -> list[str]:
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return [n[len(prefix):] for n in names if n.startswith(prefix)]

    def _newest(self, before: int | None) -> dict[str, int]:
        """Part → newest committed version below ``before`` (folder names only)."""
        out: dict[str, int] = {}
        for v in sorted(int(x) for x in self._children(self.root, "v=")):
            folder = f"{self.root}/v={v}"
            if (before is None or v < before) and self._fs.exists(self._path(f"{folder}/_SUCCESS")):
                out.update(dict.fromkeys(self._children(folder, f"{PART}="), v))
        return out

    def read(self, parts: list[str] | None = None, before: int | None = None) -> DataFrame:
        """The newest rows of the parts named (all without), with column ``part``."""
        newest = self._newest(before)
        paths = [f"{self.root}/v={v}/{PART}={p}" for p, v in sorted(newest.items()) if parts is None or p in parts]
        typed = T.StructType([*self.schema.fields, T.StructField(PART, T.StringType()), T.StructField("v", T.IntegerType())])
        rows = (self.spark.read.schema(typed).option("basePath", self.root).parquet(*paths) if paths
                else self.spark.createDataFrame([], typed))
        return rows.drop("v")

    def write(self, rows: DataFrame, version: int) -> None:
        """Commit ``rows`` (with column ``part``) as ``version`` of their parts."""
        rows.select(*self.schema.names, PART).write.mode("overwrite").partitionBy(PART).parquet(f"{self.root}/v={version}")

    def prune(self, version: int) -> None:
        """Drop parts that a version below ``version`` has replaced; what a
        replay of ``version`` would read stays."""
        newest = self._newest(version)
        for v in sorted(int(x) for x in self._children(self.root, "v=")):
            for p in self._children(f"{self.root}/v={v}", f"{PART}="):
                if v < newest.get(p, -1):
                    self._fs.delete(self._path(f"{self.root}/v={v}/{PART}={p}"), True)
