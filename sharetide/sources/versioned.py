"""Tables of immutable folders that numbered manifests list: copy-on-write by week, and exactly-once deliveries.

A manifest is a small JSON file with the folders that make up the table.  A change writes new folders, then publishes the next
manifest by renaming a finished file to its number; that name must be free, so of two writers one fails.  Readers
take the newest manifest and see all of a change or nothing of it.  Folders that no kept manifest lists
can be dropped.  A manifest grows with the number of weeks or deliveries, never with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharetide.session import setting
from sharetide.sources.sinks import by_week

LISTED = "512"  # folders that the driver lists by itself; for more, tasks do it
NO_WEEK = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for the folder of rows without a week


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Manifest:
    """``folders``: by name (a week, a delivery) its folder below the root, or None if it has no rows; ``marks``: by source the last
    token that was taken in; ``facts``: by name what else is known of it."""

    number: int = 0
    schema: str | None = None
    folders: Mapping[str, str | None] = field(default_factory=dict)
    marks: Mapping[str, int] = field(default_factory=dict)
    facts: Mapping[str, Mapping[str, object]] = field(default_factory=dict)


class Folders:
    """Manifests of one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest of a version, the newest by default; an empty one before the first."""
        there = self.numbers()
        if number is None:
            number = there[-1] if there else 0
        if number == 0:
            return Manifest()
        if number not in there:
            raise ValueError(f"{self.root} has no version {number}, only {there}")
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{number}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def publish(self, following: Manifest) -> Manifest:
        """Make ``following`` the version after the one that it was made from."""
        folder = f"{self.root}/_manifests"
        draft, final = self._path(f"{folder}/.draft-{uuid.uuid4().hex}"), self._path(f"{folder}/{following.number}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(vars(following)).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {following.number} of {self.root} is there already: read it and try again")
        return following

    def new_folder(self, number: int) -> str:
        # Named like a partition, as all folders are read together below one base path.
        return f"data/store_version={number}-{uuid.uuid4().hex[:12]}"

    def size(self, folder: str) -> int:
        """Bytes below a folder."""
        where = self._path(f"{self.root}/{folder}")
        return int(self._fs.getContentSummary(where).getLength()) if self._fs.exists(where) else 0

    def drop_old(self, keep: int = 1) -> list[str]:
        """Remove all but the newest ``keep`` versions, and the folders that none of those lists; returns these.

        Also removes what failed writers left behind, so no writer may be at work.
        """
        there = self.numbers()
        for n in there[: max(0, len(there) - keep)]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{n}.json"), False)
        used = {f for n in self.numbers() for f in self.manifest(n).folders.values() if f}
        roots, gone = {"/".join(f.split("/")[:2]) for f in used}, []
        for name in self.names("data"):
            folder = f"data/{name}"
            if folder not in roots:
                gone.append(folder)
            elif folder not in used:  # a version's folder has one below it for each of its weeks
                gone += [f"{folder}/{w}" for w in self.names(folder) if "=" in w and f"{folder}/{w}" not in used]
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return gone

    def rows(self, of: Manifest, names: list[str] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its folders; None before the first version."""
        if of.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(of.schema))
        chosen = of.folders if names is None else {n: of.folders[n] for n in names if n in of.folders}
        paths = [f"{self.root}/{f}" for f in chosen.values() if f]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Below the base path, folders named like week=2024-W01 give the column of that name its values.
        with setting(self.spark, "spark.sql.sources.parallelPartitionDiscovery.threshold", LISTED):
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*schema.fieldNames())


class WeekStore(Folders):
    """A table by week in which a change writes the weeks that it touches, and nothing else."""

    def __init__(self, spark: SparkSession, root: str, week: str = "year_week") -> None:
        super().__init__(spark, root)
        self.week = week

    def read(self, number: int | None = None, weeks: list[str] | None = None) -> DataFrame | None:
        """The table as a version has it (the newest by default), or some of its weeks; None if there is no version yet."""
        return self.rows(self.manifest(number), weeks)

    def taken(self, source: str, token: int) -> bool:
        """Whether this source's change with this number, or a later one, is in the newest version."""
        return self.manifest().marks.get(source, -1) >= token

    def before(self, source: str, token: int) -> Manifest:
        """The version that this source's change with this number starts from: the newest, or the one before it if that has the change.

        Changes are numbered from 0 without a gap; a store that lacks the one before, or has later ones, is an error, as going on
        would lose rows.
        """
        now = self.manifest()
        last = now.marks.get(source, -1)
        if last == token:
            return self.manifest(now.number - 1)
        if last != token - 1:
            raise RuntimeError(f"{self.root} has change {last} of {source or 'its source'} where {token} comes: the store and the stream's checkpoint do not belong together")
        return now

    def replace(self, rows: DataFrame, weeks: list[str] | None = None, source: str = "", token: int | None = None, facts: Mapping[str, Mapping] | None = None) -> Manifest:
        """Replace the weeks that ``rows`` hold, and empty those of ``weeks`` that they do not hold.

        With a ``token``, numbers that rise by source, a change that was taken in before is left out.  Rows without a week are kept
        under a week of their own.  ``facts`` is noted by week.
        """
        now = self.manifest()
        if token is not None and now.marks.get(source, -1) >= token:
            return now
        folder = self.new_folder(now.number + 1)
        by_week(rows, self.week).write.partitionBy(self.week).parquet(f"{self.root}/{folder}")
        written = {n.partition("=")[2]: f"{folder}/{n}" for n in self.names(folder) if n.startswith(f"{self.week}=")}
        folders = {k: v for k, v in now.folders.items() if k not in (weeks or [])} | written
        marks = {**now.marks, source: token} if token is not None else dict(now.marks)
        return self.publish(replace(now, number=now.number + 1, schema=now.schema or rows.schema.json(), folders=folders, marks=marks, facts={**now.facts, **(facts or {})}))

class DeliveryStore(Folders):
    """Deliveries appended exactly once each."""

    def read(self, number: int | None = None) -> DataFrame | None:
        """All rows of the deliveries that were committed; None if there are none."""
        return self.rows(self.manifest(number))

    def deliveries(self) -> Mapping[str, Mapping[str, object]]:
        """The ledger: rows and fingerprint by delivery."""
        return self.manifest().facts

    def append(self, rows: DataFrame, delivery: str) -> bool:
        """Add ``rows`` as ``delivery``; False if it is there already.

        The same delivery with other rows is refused, and so are the same rows under another name.  Rows count as the same if their
        number and the sum of their hashes agree, in any order.  A write that failed half-way is in no manifest, so nobody reads it
        and the next try starts afresh.
        """
        now = self.manifest()
        if now.schema is not None and T.StructType.fromJson(json.loads(now.schema)) != rows.schema:
            raise ValueError(f"delivery {delivery} has other columns than the store")
        known = now.facts.get(delivery)
        if known is not None:  # nothing is written for a delivery that comes again
            if fingerprint(rows) == dict(known):
                return False
            raise ValueError(f"delivery {delivery} was committed with other rows")
        folder = self.new_folder(now.number + 1)
        rows.write.parquet(f"{self.root}/{folder}")
        seen = fingerprint(self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}"))
        twin = next((d for d, f in now.facts.items() if dict(f) == seen and seen["rows"]), None)
        if twin is not None:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise ValueError(f"delivery {delivery} has the rows of delivery {twin}")
        self.publish(
            replace(now, number=now.number + 1, schema=now.schema or rows.schema.json(), folders={**now.folders, delivery: folder}, facts={**now.facts, delivery: seen})
        )
        return True


def fingerprint(rows: DataFrame) -> dict[str, object]:
    """Number of rows and the sum of their hashes; neither depends on their order."""
    hashed = F.xxhash64(*rows.columns, F.lit(0)).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return {"rows": n, "hash": str(total)}
