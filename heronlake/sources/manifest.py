"""Tables that change together: written apart, published at once by one small file.

A version of a set of tables is a manifest that names the folders of their files. The manifest is written under another
name and renamed, and a rename onto a name that is there fails; so readers see a whole version or the one before, two
writers cannot publish the same version, and what a failed job has left is never read. A version lists the batches that
made it and those before it: a batch that is published already is not published again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"v(\d{12})\.json")
BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Tables:
    """Versions of a set of tables below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        there = self._path("manifest")
        if not self.fs.exists(there):
            return []
        names = (NAME.fullmatch(x.getPath().getName()) for x in self.fs.listStatus(there))
        return sorted(int(m[1]) for m in names if m)

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds, the newest by default: version, batches so far, tables (name to folders) and what the writer adds."""
        known = self.versions()
        if not known:
            return {"version": 0, "batches": [], "tables": {}}
        text = self.fs.open(self._path(f"manifest/v{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8"))
        finally:
            text.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folders = self.manifest(version)["tables"][name]
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def publish(self, batch: str, write: Callable[[str, dict], dict]) -> dict:
        """Run write(folder, manifest before) -> what the new version holds, unless the batch is published already.

        The folder is this attempt's own, relative to the root. `tables` of the result names folders relative to the root.
        """
        if not BATCH.fullmatch(batch):
            raise ValueError(f"not a batch id: {batch!r}")
        before = self.manifest()
        if batch in before["batches"]:
            return before
        held = write(f"data/{batch}-{uuid.uuid4().hex}", before)
        number = before["version"] + 1
        made = {**held, "version": number, "batches": [*before["batches"], batch]}
        part, to = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/v{number:012d}.json")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(part, to):
            self.fs.delete(part, False)
            raise Conflict(f"version {number} of {self.root} is there already")
        return made
