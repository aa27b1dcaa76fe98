"""Output tables that are replaced together, or not at all.

Every write of a set goes to fresh folders, ``<root>/<table>/<version>``. When all
tables are written, one small manifest that names them is renamed into place, and only
then do readers see the new version; a run that fails before leaves the
tables of the last one whole. The version before stays for readers that have
planned on it, older folders and those of failed runs are removed by the next write.
One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class Files:
    """The file system of a path, through Spark's own configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, file: str, text: str) -> None:
        """Write a small file that appears whole."""
        draft = f"{file.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(draft, file)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class TableSet:
    """Named tables under ``root`` with one current version of all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{MANIFESTS}") if not n.startswith(".")]

    def _tables(self, manifest: str) -> dict[str, str]:
        return json.loads(self.files.read(f"{self.root}/{MANIFESTS}/{manifest}"))

    def paths(self) -> dict[str, str]:
        """Folder of each current table; none before the first write."""
        newest = self._manifests()[-1:]
        return {k: f"{self.root}/{v}" for k, v in self._tables(newest[0]).items()} if newest else {}

    def read(self, fmt: str = "parquet") -> dict[str, DataFrame]:
        return {name: self.spark.read.format(fmt).load(path) for name, path in self.paths().items()}

    def write(self, tables: dict[str, DataFrame], fmt: str = "parquet") -> dict[str, str]:
        """Write all tables and make them current; the folder of each."""
        before = self._manifests()
        number = int(before[-1].partition("-")[0]) + 1 if before else 1
        version = f"{number:08d}-{uuid.uuid4().hex}"
        made = {name: f"{name}/{version}" for name in tables}
        for name, df in tables.items():
            df.write.format(fmt).save(f"{self.root}/{made[name]}")
        self.files.put(f"{self.root}/{MANIFESTS}/{version}", json.dumps(made))
        self._sweep()
        return self.paths()

    def _sweep(self) -> None:
        """Remove what neither the current version nor the one before names."""
        manifests = self._manifests()
        kept = {folder for m in manifests[-2:] for folder in self._tables(m).values()}
        for name in self.files.names(self.root):
            if name != MANIFESTS and not name.startswith("."):
                for version in self.files.names(f"{self.root}/{name}"):
                    if f"{name}/{version}" not in kept:
                        self.files.delete(f"{self.root}/{name}/{version}")
        for old in manifests[:-2]:
            self.files.delete(f"{self.root}/{MANIFESTS}/{old}")
