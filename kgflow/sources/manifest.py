"""Numbered entries that drivers put in place one after another, and counters made of them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Manifest:
    """Entries 1, 2, ... in a folder of any file system; each is put in place whole, by whichever driver is first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def append(self, number: int, content: dict) -> bool:
        """Makes content the entry of that number; False if there is one."""
        fs, draft, place = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"entries/{number:020d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.mkdirs(place.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, place, options)  # never over another file
        except Exception:
            fs.delete(draft, False)
            if fs.exists(place):
                return False
            raise
        return True

    def _read(self, path) -> dict:
        stream = self._fs().open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """The highest number and its content; 0 and None before the first."""
        fs, folder = self._fs(), self._path("entries")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return number, self._read(self._path(f"entries/{number:020d}")) if number else None

    def changed(self, change: Callable[[dict | None], dict | None]) -> dict | None:
        """Appends change(last content) after the last entry, again from the new last one if another driver was first.

        change may give None, for nothing to do.  The result has the entry that was appended, if one was.
        """
        while True:
            number, content = self.last()
            new = change(content)
            if new is None:
                return None
            if self.append(number + 1, new):
                return new

    def prune(self) -> None:
        """Deletes all entries but the last; no other driver may be about to append one."""
        number, fs = self.last()[0], self._fs()
        for status in fs.listStatus(self._path("entries")) if number else []:
            if status.getPath().getName() != f"{number:020d}":
                fs.delete(status.getPath(), False)


def claim_numbers(spark: SparkSession, ledger: str, n: int) -> int:
    """The first of n numbers in a row that no other call for this ledger was or will be given; the first of all is 1."""
    entry = Manifest(spark, ledger).changed(lambda held: {"first": held["first"] + held["n"] if held else 1, "n": n})
    return entry["first"]
