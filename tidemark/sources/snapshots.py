"""Result tables in versions: each change writes new files, and one rename publishes it.

Below a table's folder lie ``data``, a folder for every write with one below it for each scope
(organisation, dataset, metric), and ``versions``, numbered manifests that list the folders that count
for each scope. A change writes the rows of the scopes it touches, then its manifest under a name of its
own, and renames that to the next number. A rename to a number that is taken is refused, so of two
writers who began with one version the later loses and is told so. Readers take the highest number and see what was before a
change or what is after it, never a part of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCOPE = ("org_id", "dataset_id", "metric")
Scope = tuple[str, str, str]


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to."""


@dataclass
class Manifest:
    """Version number, and for each scope the folders of its rows, relative to the table's."""

    number: int
    live: dict[Scope, list[str]]

    def text(self) -> str:
        return json.dumps([[*scope, folders] for scope, folders in sorted(self.live.items())])

    @staticmethod
    def of(number: int, text: str) -> Manifest:
        return Manifest(number, {tuple(row[:3]): row[3] for row in json.loads(text)})


class ResultTable:
    """A versioned table of the columns of ``schema`` (which has the scope's three and ``when``)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, when: str = "bucket") -> None:
        self.spark, self.path, self.when = spark, path.rstrip("/"), when
        self.empty = spark.createDataFrame([], schema)
        missing = {*SCOPE, when} - set(self.empty.columns)
        if missing:
            raise ValueError(f"the schema lacks {sorted(missing)}")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # --- versions
    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        at = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the newest; before the first change, version 0 without scopes."""
        there = self.versions()
        if version is None:
            version = there[-1] if there else 0
        if version == 0:
            return Manifest(0, {})
        if version not in there:
            raise ValueError(f"{self.path} has no version {version}")
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/versions/{version:012d}.json"))
        try:
            return Manifest.of(version, bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, base: Manifest, live: dict[Scope, list[str]]) -> int:
        made = Manifest(base.number + 1, live)
        own = self._hadoop.Path(f"{self.path}/versions/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray(made.text().encode()))
        finally:
            out.close()
        to = self._hadoop.Path(f"{self.path}/versions/{made.number:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(own.toUri(), self._conf).rename(own, to, none)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(to):
                raise Conflict(f"version {made.number} of {self.path} is there already") from e
            raise
        return made.number

    # --- reading
    def read(self, org: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version; with an organisation, its rows alone, of which no other's folder is opened."""
        live = self.manifest(version).live
        return self._rows([f for scope, folders in live.items() if org in (None, scope[0]) for f in folders])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.empty
        rows = self.spark.read.schema(self.empty.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.select(*self.empty.columns)

    # --- changes
    def _written(self, rows: DataFrame) -> dict[Scope, str]:
        """Write rows, a folder for each scope; which these are."""
        folder = f"data/{uuid.uuid4().hex}"
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SCOPE]
        named = rows.select(*self.empty.columns, F.sha2(F.concat_ws("\u0001", *keys), 256).alias("_scope"))
        named.write.partitionBy("_scope").parquet(f"{self.path}/{folder}")
        back = self.spark.read.parquet(f"{self.path}/{folder}").select("_scope", *SCOPE).distinct().collect() if self._any(folder) else []
        return {(r[1], r[2], r[3]): f"{folder}/_scope={r[0]}" for r in back}  # a row for each scope that the change touches

    def _any(self, folder: str) -> bool:
        return any(f.isDirectory() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}")))

    def _changed(self, new: DataFrame, scopes: list[Scope] | None, kept: Callable[[Scope], Column] | None, before_publish: Callable[[], None] | None) -> int:
        base = self.manifest()
        live = dict(base.live)
        rows = new.select(*[F.col(c).cast(self.empty.schema[c].dataType).alias(c) for c in self.empty.columns])
        if scopes is not None:
            for scope in scopes:
                old = live.pop(scope, None)
                if kept is not None and old:
                    rows = rows.unionByName(self._rows(old).filter(kept(scope)))
        made = self._written(rows)
        if scopes is not None and (other := set(made) - set(scopes)):
            raise ValueError(f"rows of other scopes: {sorted(other)[:3]}")
        if scopes is None:
            for scope in made:
                live.pop(scope, None)
        for scope, folder in made.items():
            live.setdefault(scope, []).append(folder)
        if before_publish:
            before_publish()
        return self._publish(base, live)

    def replace_all(self, new: DataFrame, scopes: list[Scope] | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Scopes get the rows of new and lose all others, also where new has none; without scopes, those that new has. The version published."""
        return self._changed(new, scopes, None, before_publish)

    def replace_range(self, new: DataFrame, scope: Scope, low: date | None = None, high: date | None = None, before_publish: Callable[[], None] | None = None) -> int | None:
        """A scope loses its rows from low to high (by default the dates that new spans) and gets those of new. Without rows and without bounds nothing changes. Rows without a date stay."""
        if low is None or high is None:
            low, high = new.agg(F.min(self.when), F.max(self.when)).first()
            if low is None:
                return None
        outside = ~F.coalesce(F.col(self.when).between(F.lit(low), F.lit(high)), F.lit(False))
        return self._changed(new, [scope], lambda _: outside, before_publish)

    def append(self, new: DataFrame, before_publish: Callable[[], None] | None = None) -> int:
        """new is added to what is there."""
        base = self.manifest()
        live = {scope: list(folders) for scope, folders in base.live.items()}
        for scope, folder in self._written(new.select(*[F.col(c).cast(self.empty.schema[c].dataType).alias(c) for c in self.empty.columns])).items():
            live.setdefault(scope, []).append(folder)
        if before_publish:
            before_publish()
        return self._publish(base, live)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the ``keep`` newest versions lists, and the manifests of older ones. Folders deleted. Not while a writer is at work: what it has not published yet counts as unused."""
        there = self.versions()
        used = {f for v in there[-keep:] for folders in self.manifest(v).live.values() for f in folders}
        gone = 0
        data = self._hadoop.Path(f"{self.path}/data")
        for write in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for part in self._fs.listStatus(write.getPath()):
                if part.isDirectory() and f"data/{write.getPath().getName()}/{part.getPath().getName()}" not in used:
                    gone += self._fs.delete(part.getPath(), True)
        for v in there[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{v:012d}.json"), False)
        return gone
