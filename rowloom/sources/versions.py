"""Tables with versions: committed whole or not at all, restored by round, cleaned of what nothing names.

A version is a folder of Parquet files and a manifest entry that names it. The
entry is written last, under a number that only one writer can take; a write
that fails before leaves a folder that no entry names, and readers never see
it. Restoring names an old folder anew and copies nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A table below ``path``, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self._conf), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[dict]:
        """Entries (version, round_id, folder), oldest first."""
        out = []
        for name in self._names("versions"):
            if name.endswith(".json") and not name.startswith((".", "_")):
                fs, where = self._at(f"versions/{name}")
                stream = fs.open(where)
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return out

    def _enter(self, folder: str, round_id: int) -> dict:
        """Name a folder as the next version; another writer's entry of the same number is not replaced."""
        have = self.versions()
        entry = {"version": have[-1]["version"] + 1 if have else 1, "round_id": round_id, "folder": folder}
        fs, target = self._at(f"versions/{entry['version']:012d}.json")
        _, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has made version {entry['version']} of {self.path}")
        return entry

    def commit(self, rows: DataFrame, round_id: int) -> dict:
        """Write ``rows`` as the state after a round."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._enter(folder, round_id)

    def _of(self, round_id: int | None) -> dict:
        have = [v for v in self.versions() if round_id is None or v["round_id"] <= round_id]
        if not have:
            raise LookupError(f"{self.path} has no version" + ("" if round_id is None else f" up to round {round_id}"))
        return have[-1] if round_id is None else max(have, key=lambda v: (v["round_id"], v["version"]))

    def read(self, round_id: int | None = None) -> DataFrame:
        """The current state, or that after a round: the last version of the latest round up to it."""
        return self.spark.read.parquet(f"{self.path}/{self._of(round_id)['folder']}")

    def restore(self, round_id: int) -> dict:
        """Make the state after a round the current one again."""
        old = self._of(round_id)
        return self._enter(old["folder"], old["round_id"])

    def clean(self, keep: int = 10) -> list[str]:
        """Drop all but the last ``keep`` versions, and folders that none names; their names. Not while others write."""
        have = self.versions()
        for v in have[: max(0, len(have) - max(1, keep))]:
            fs, where = self._at(f"versions/{v['version']:012d}.json")
            fs.delete(where, False)
        named = {v["folder"] for v in self.versions()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named]
        for name in gone:
            fs, where = self._at(name)
            fs.delete(where, True)
        return gone
