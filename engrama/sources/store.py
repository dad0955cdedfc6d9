"""Stores on disk: an immutable base, segments of fresh rows beside it, and numbered commits that say which are current.

Every append is a Parquet folder of its own. A commit names the base and the segments that this base has taken in; readers
take the newest commit, its base, and all segments that it doesn't name. So a row appended while a compaction runs is in no
commit and stays in view. A commit is a file created under the next number, which fails if the number is taken: of two
compactions from one snapshot the second raises Conflict, and nothing is lost.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engrama.operators import tree

#: Versions that can be read; what was written under the first has these measures.
VERSIONS = (1, 2)
FIRST_DIM, FIRST_METADATA = 768, 256


class Conflict(RuntimeError):
    """Another writer has published since the snapshot was taken."""


@dataclass(frozen=True)
class Snapshot:
    """generation, the folder of its base (none at first), the segments it has taken in, and the fresh ones in view."""

    generation: int
    base: str | None
    taken: tuple[str, ...]
    fresh: tuple[str, ...]


class Store:
    """A table with generations under a path; meta holds dim, metadata_size, quantization and version."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, meta: dict | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        names = self._list("meta")
        if not names:
            self.meta = {"version": VERSIONS[-1], **(meta or {})}
            self._create("meta/0.json", self.meta)
        else:
            held = self._load("meta/0.json")
            if held.get("version") not in VERSIONS:
                raise ValueError(f"version {held.get('version')} can't be read")
            if held["version"] == VERSIONS[0] or not held.get("dim", True):
                held = held | {"version": VERSIONS[-1], "dim": held.get("dim") or FIRST_DIM, "metadata_size": held.get("metadata_size") or FIRST_METADATA}
            self.meta = held  # what is on disk wins over what was asked for

    def _hadoop(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path, fs = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _create(self, name: str, content: dict) -> None:
        """A small file that must not exist; it is the file system that lets one of two writers win."""
        path, fs = self._hadoop(name)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _load(self, name: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()))

    def snapshot(self) -> Snapshot:
        commits = [int(n.partition(".")[0]) for n in self._list("commits") if n.endswith(".json")]
        done = self._load(f"commits/{max(commits):010}.json") if commits else {"base": None, "taken": []}
        whole = [n for n in self._list("segments") if self._hadoop(f"segments/{n}/_SUCCESS")[1].exists(self._hadoop(f"segments/{n}/_SUCCESS")[0])]
        taken = tuple(done["taken"])
        return Snapshot(max(commits, default=0), done["base"], taken, tuple(n for n in whole if n not in set(taken)))

    @property
    def generation(self) -> int:
        return self.snapshot().generation

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def base(self, at: Snapshot | None = None) -> DataFrame:
        at = at or self.snapshot()
        return self._rows([at.base] if at.base else [])

    def delta(self, at: Snapshot | None = None) -> DataFrame:
        return self._rows([f"segments/{n}" for n in (at or self.snapshot()).fresh])

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """Base and fresh segments, now or at a snapshot."""
        at = at or self.snapshot()
        return self._rows([*([at.base] if at.base else []), *(f"segments/{n}" for n in at.fresh)])

    def get(self, id_: int) -> DataFrame:
        """The row of one id; the filter reaches the Parquet scan."""
        return self.read().where(F.col("id") == id_)

    def append(self, rows: DataFrame) -> None:
        """Add rows as a segment; Spark commits them as a whole or not at all."""
        names = [f.name for f in self._rows([]).schema]
        rows.select(*names).write.option("compression", "zstd").parquet(f"{self.path}/segments/{uuid.uuid4().hex}")

    def publish(self, rows: DataFrame, at: Snapshot) -> int:
        """Make rows the base in place of what the snapshot has; segments that came later stay in view."""
        base = f"bases/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{base}")
        number = at.generation + 1
        try:
            self._create(f"commits/{number:010}.json", {"base": base, "taken": [*at.taken, *at.fresh]})
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"generation {number} is there already") from error
            raise
        return number

    def compact(self) -> int:
        """Drop tombstones and take the fresh segments into the base, ids as they are; without either nothing happens."""
        at = self.snapshot()
        if not at.fresh and self.base(at).where(tree.is_dead()).isEmpty():
            return at.generation
        return self.publish(self.read(at).where(~tree.is_dead()), at)
