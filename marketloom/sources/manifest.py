"""Which files a table consists of: numbered lists, of which the last one counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """Versions of a table's list of folders, in ``<path>/_versions``.

    A change writes new folders first, then one small file with the next number; that
    file is renamed into place, so a reader sees the old list or the new one.  Work that
    breaks off before leaves folders that no list names, which ``unnamed`` finds.  A
    second writer that started from the same version fails instead of undoing the first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.at = path, f"{path}/_versions"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self._hadoop.Path(path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._of(self.at)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(self.at))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        """The last version and its content; 0 and an empty one before the first."""
        every = self.versions()
        if not every:
            return 0, {}
        stream = self._fs.open(self._of(f"{self.at}/{every[-1]:08d}.json"))
        try:
            return every[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Make ``content`` the version after ``version``, which must still be the last."""
        new, final = self._of(f"{self.at}/{version + 1:08d}.new"), self._of(f"{self.at}/{version + 1:08d}.json")
        self._fs.mkdirs(self._of(self.at))
        if self._fs.exists(final):
            raise RuntimeError(f"{self.path} was changed since version {version}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self._fs.rename(new, final):
            raise RuntimeError(f"{self.path} was changed since version {version}")

    def unnamed(self, folder: str, named: set[str]) -> list[str]:
        """Paths below ``folder``, two levels deep, that are not in ``named``."""
        if not self._fs.exists(self._of(folder)):
            return []
        parts = [s.getPath() for s in self._fs.listStatus(self._of(folder))]
        leaves = [f"{folder}/{p.getName()}/{s.getPath().getName()}" for p in parts for s in self._fs.listStatus(p) if s.isDirectory()]
        return [x for x in leaves if x not in named]

    def delete(self, path: str) -> None:
        self._fs.delete(self._of(path), True)
