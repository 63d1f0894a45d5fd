"""Results that are kept as tables in the shared folder, and read again while their inputs stay as they are."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
import warnings
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .commits import Commits, Conflict, Files

#: A kept result is built anew after so many seconds.
MAX_AGE = 24 * 3600


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where it is unset, a temporary one, on a single machine only."""
    conf = spark.sparkContext.getConf()
    if not (found := conf.get("spark.checkpoint.dir") or spark.conf.get("stockflow.shared.dir", None)):
        if not (conf.get("spark.master") or "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stockflow-')}"
        spark.conf.set("stockflow.shared.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, lengths and times of the files under paths, also of nested ones, by which a change of inputs shows. Spark lists and sums them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}-{total}"


def place_of(spark: SparkSession, kind: str, name: str, inputs: list[str]) -> str:
    """The folder for what is made of inputs under a name: the same for every driver."""
    return f"{shared_dir(spark)}/stockflow-{kind}/{name}-{hashlib.sha256(json.dumps(sorted(inputs)).encode()).hexdigest()[:20]}"


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], max_age: float = MAX_AGE, partition_by: str | None = None) -> DataFrame:
    """build()'s rows as a table, with a folder for each value of a column if one is given: written if there is none yet, if a file of inputs has changed, or if it is older than max_age seconds.

    What is kept is told by a version file in the shared folder (commits.Commits), so that every driver sees it; of two that build at once the second takes the first one's table. The
    table before the newest stays for those who read it, older ones go. If building fails, a table that is too old, but of the same inputs, is read with a warning.
    """
    place, state = place_of(spark, "kept", name, inputs), state_of(spark, inputs)
    commits = Commits(spark, place)
    version, record = commits.newest()
    if record.get("state") != state or time.time() - record["at"] > max_age:
        try:
            rows, path = build(), f"{place}/{uuid.uuid4().hex}"
            rows.write.partitionBy(*([partition_by] if partition_by else [])).parquet(path)
        except Exception:
            if record.get("state") != state:
                raise
            warnings.warn(f"{name} could not be built anew; an older table is read", stacklevel=2)
        else:
            new = {"state": state, "at": time.time(), "path": path, "schema": rows.schema.json()}
            try:
                commits.claim(version, new)
                record = new
                for old in commits.records(3)[:-2]:
                    commits.files.fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old["path"]), True)
            except Conflict:
                other = commits.newest()[1]
                record = other if other["state"] == state else new
    return spark.read.schema(T.StructType.fromJson(json.loads(record["schema"]))).parquet(record["path"])


def newest_snapshot(table: DataFrame, day: str) -> DataFrame:
    """The rows of the last day of a table with a folder for each: the day is told by the folders' names, and no other folder is read."""
    paths = {f.rsplit(f"/{day}=", 1)[1].split("/")[0] for f in table.inputFiles()}
    days = sorted(d for d in paths if d != "__HIVE_DEFAULT_PARTITION__")
    return table.where(F.col(day) == F.lit(days[-1]).cast("date")) if days else table.where("false")


class Days:
    """A table in the shared folder with a folder for each day, so that a day that is there is not made again.

    state: of what days are made of. If it changes, all days are made anew; an append-only source gives a state that stays, and asks for its last days to be made again
    (late) as long as rows may still come for them.
    """

    def __init__(self, spark: SparkSession, place: str, state: str):
        self.spark, self.place, self.state, self.commits = spark, place, state, Commits(spark, place)

    def read(self, first: date, last: date, build: Callable[[date, date], DataFrame], late: int = 0) -> DataFrame:
        """build(first, last)'s rows, of which a column is `day`. Only the days that are missing, and the last `late` of those that were there, are built, in one go if they follow each other."""
        days = [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]
        while True:
            version, record = self.commits.newest()
            parts = dict(record.get("parts", {})) if record.get("state") == self.state else {}
            again = sorted(parts)[-late:] if late else []
            missing = [d for d in days if d not in parts or d in again]
            if not missing:
                break
            for start, end in stretches(missing):
                path = f"{self.place}/{uuid.uuid4().hex}"
                rows = build(date.fromisoformat(start), date.fromisoformat(end))
                rows.repartition("day").write.partitionBy("day").parquet(path)
                there = {n[4:] for n in Files(self.spark, path).names() if n.startswith("day=")}
                parts |= {d: f"{path}/day={d}" if d in there else None for d in missing if start <= d <= end}
                schema = T.StructType([f for f in rows.schema if f.name != "day"]).json()
            try:
                record = {"state": self.state, "parts": parts, "schema": schema}
                self.commits.claim(version, record)
                self._clean()
                break
            except Conflict:
                continue  # another driver has added days: what is still missing then is built
        found = [parts[d] for d in days if parts[d]]
        schema = T.StructType.fromJson(json.loads(record["schema"])).add("day", T.DateType())
        if not found:
            return self.spark.createDataFrame([], schema)
        roots = sorted({p.rsplit("/", 1)[0] for p in found})
        tables = [self.spark.read.schema(schema).option("basePath", r).parquet(*[p for p in found if p.startswith(r)]) for r in roots]
        return reduce(DataFrame.unionByName, tables)

    def _clean(self) -> None:
        """Deletes the folders that the two newest versions don't name; the one before the newest stays for those who read it."""
        *old, before, now = [{p.rsplit("/", 1)[0] for p in r["parts"].values() if p} for r in [{"parts": {}}, *self.commits.records(3)]]
        for path in set().union(*old) - before - now:
            self.commits.files.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def stretches(days: list[str]) -> list[tuple[str, str]]:
    """First and last of each run of days that follow each other."""
    out: list[list[date]] = []
    for d in map(date.fromisoformat, sorted(days)):
        if out and out[-1][1] + timedelta(days=1) == d:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [(a.isoformat(), b.isoformat()) for a, b in out]
