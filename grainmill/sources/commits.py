"""Tables written in named writes, each of which takes effect once.

A write puts the rows of one or several tables into new folders and then makes one small file,
``_log/<write id>.json``, that names them. Readers take the folders that log files name and no
others, so a write that did not come to its end is never seen, and one that is made again after
its log file is there does nothing. All tables of a write become visible together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LOG = "_log"


class WriteLog:
    """The writes below one folder, on whatever file system it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._folder = self._hadoop.fs.Path(f"{self.root}/{LOG}")
        self._fs = self._folder.getFileSystem(self._conf)

    def _path(self, write_id: str):
        if not write_id or "/" in write_id or write_id.startswith((".", "_")):
            raise ValueError(f"not a name for a write: {write_id!r}")
        return self._hadoop.fs.Path(self._folder, f"{write_id}.json")

    def has(self, write_id: str) -> bool:
        return self._fs.exists(self._path(write_id))

    def ids(self) -> list[str]:
        """All finished writes, by name."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(n[: -len(".json")] for n in names if n.endswith(".json") and n[0] not in "._")

    def last_before(self, write_id: str) -> str | None:
        """The last finished write whose name comes before."""
        earlier = [i for i in self.ids() if i < write_id]
        return earlier[-1] if earlier else None

    def folders(self, write_id: str) -> dict[str, str]:
        """Folder of each table of a write."""
        stream = self._fs.open(self._path(write_id))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {name: f"{self.root}/{folder}" for name, folder in json.loads(text).items()}

    def commit(self, write_id: str, folders: Mapping[str, str]) -> bool:
        """Name the folders of a write; False if another attempt was faster."""
        target = self._path(write_id)
        staged = self._hadoop.fs.Path(self._folder, f".{write_id}-{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(dict(folders)).encode()))
        out.close()
        # Renaming without replacing: of two attempts at once only one gets the name.
        names = self._hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
        rename = self._hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            names.rename(staged, target, options)
        except Exception as e:
            if not self._fs.exists(target):
                raise e
            self._fs.delete(staged, False)
            return False
        return True


def write_once(
    tables: Mapping[str, DataFrame],
    root: str,
    write_id: str,
    *,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> bool:
    """Write all tables as one write; False, and nothing done, if it has been made before."""
    spark = next(iter(tables.values())).sparkSession
    log = WriteLog(spark, root)
    if log.has(write_id):
        return False
    folders = {}
    for name, df in tables.items():
        folders[name] = f"{name}/{write_id}-{uuid.uuid4().hex}"
        keys = (partition_by or {}).get(name, ())
        df.write.partitionBy(*keys).parquet(f"{log.root}/{folders[name]}")
    return log.commit(write_id, folders)


def read_writes(
    spark: SparkSession,
    root: str,
    name: str,
    schema: str | StructType,
    *,
    only: Sequence[str] | None = None,
    inside: str = "",
) -> DataFrame:
    """The rows of one table over all finished writes, or over ``only`` some of them.

    ``inside`` names a partition folder (``column=value``); an absent one has no rows.
    """
    log = WriteLog(spark, root)
    if only is None:
        ids = log.ids()
    else:
        ids = [i for i in only if log.has(i)]
    found = [f for f in (log.folders(i).get(name) for i in ids) if f]
    if inside:
        found = [f"{f}/{inside}" for f in found]
        found = [f for f in found if log._fs.exists(log._hadoop.fs.Path(f))]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found)
