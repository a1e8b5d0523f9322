"""Sets of dependent tables that change together.

Tables are written aside, each into a folder of its own, and put in place by one small file that names the folders of
all of them. Readers look that file up once, so they see all tables of one version or of another, never half of each,
whatever fails between two writes. A version's file is made by a rename that does not overwrite, so of two writers from
the same version the second one fails and loses nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class TableSet:
    """Named tables under path, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _java_path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._java_path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, folder = self._files(), self._java_path("_versions")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Each table's folder in a version, the last one by default."""
        if version is None:
            known = self.versions()
            if not known:
                return {}
            version = known[-1]
        row = self.spark.read.text(f"{self.path}/_versions/{version:012d}.json", wholetext=True).first()
        return json.loads(row[0])

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self.folders(version).items()}

    def write(self, tables: dict[str, DataFrame], since: int | None = None) -> int:
        """Puts the given tables in place at once; the others stay as they are. since: the version that the caller read."""
        known = self.versions()
        last = known[-1] if known else 0
        if since is not None and since != last:
            raise ValueError(f"version {last} has been written since version {since} was read")
        folders = self.folders(last) if known else {}
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            folders[name] = folder
        return self._publish(last + 1, folders)

    def _publish(self, version: int, folders: dict[str, str]) -> int:
        files, aside = self._files(), self._java_path("_versions", f"_{uuid.uuid4().hex}")
        out = files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._java_path("_versions", f"{version:012d}.json"), plain)
        except Exception:
            files.delete(aside, False)
            raise
        return version

    def reset(self, *names: str) -> int:
        """Empties the named tables, all of them by default, and those only, at once."""
        now = self.read()
        return self.write({n: df.limit(0) for n, df in now.items() if not names or n in names})

    def forget(self, keep: int = 2) -> None:
        """Deletes versions but the last ones, and folders that no version names any more."""
        known, files = self.versions(), self._files()
        kept = known[-keep:]
        named = {f for v in kept for f in self.folders(v).values()}
        for version in known:
            if version not in kept:
                files.delete(self._java_path("_versions", f"{version:012d}.json"), False)
        for table in files.listStatus(self._java_path()):
            name = table.getPath().getName()
            if not name.startswith("_"):
                for folder in files.listStatus(table.getPath()):
                    if f"{name}/{folder.getPath().getName()}" not in named:
                        files.delete(folder.getPath(), True)


