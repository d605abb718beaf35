"""A store of the graph's tables: batches of rows, and a list of those that count.

Each table is a folder partitioned by batch (edges also by kind), written by
Spark alone. A commit is one small file that names the batches of each table; it
appears at once, so all tables of a version do, or none. An append writes its own
rows and a new list; what was there before isn't read or written again. Commits
are numbered, and the file of a number is made by a rename that never replaces
one (atomic on HDFS; object stores need a committer of their own): of two writers
that follow the same version one fails. An interrupted write leaves folders that
no commit names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from sagekeep.schemas import TABLES, conform

PARTITIONS = {"edges": ["edge_type"]}
COMMITS = "_commits"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The number of the last commit; None before the first."""
        path, system = self._path(COMMITS)
        if not system.exists(path):
            return None
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return max((n for n in names if not n.startswith((".", "_"))), default=None)

    def _batches(self, version: str | None) -> dict[str, list[str]]:
        if version is None:
            return {}
        rows = self.spark.read.text(f"{self.root}/{COMMITS}/{version}").collect()  # one line
        return json.loads("".join(r[0] for r in rows))

    def read(self, table: str) -> DataFrame:
        """A table of the current version; empty before the first commit."""
        batches = self._batches(self.version()).get(table)
        if not batches:
            return self.spark.createDataFrame([], TABLES[table])
        folder = f"{self.root}/{table}"
        reader = self.spark.read.schema(f"{TABLES[table]}, batch string").option("basePath", folder)
        return conform(reader.parquet(*(f"{folder}/batch={b}" for b in batches)), table)

    def append(self, since: str | None = None, **tables: DataFrame) -> str:
        """Add rows to the given tables. With ``since`` it fails if that isn't the current version any more."""
        return self.change({}, tables, since)

    def publish(self, since: str | None = None, **tables: DataFrame) -> str:
        """Replace the given tables; the others stay as they are."""
        return self.change(tables, {}, since)

    def change(self, replaced: dict[str, DataFrame], added: dict[str, DataFrame], since: str | None = None) -> str:
        """Replace some tables and add rows to others, in one commit."""
        old = self.version() if since is None else since
        batches, new = self._batches(old), uuid.uuid4().hex
        for name, rows in {**replaced, **added}.items():
            writer = conform(rows, name).write
            if name in PARTITIONS:
                writer = writer.partitionBy(*PARTITIONS[name])
            writer.parquet(f"{self.root}/{name}/batch={new}")
            batches[name] = [*(batches.get(name, []) if name in added else []), new]
        version = f"{int(old or 0) + 1:012d}"
        draft, system = self._path(f"{COMMITS}/.{version}-{new}")
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(batches).encode()))
        stream.close()
        target, _ = self._path(f"{COMMITS}/{version}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        flags = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        flags[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, flags)
        except Exception as error:
            system.delete(draft, False)
            raise RuntimeError("another version was published in the meantime") from error
        return version
