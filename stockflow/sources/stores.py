"""Tables that the library keeps: logs that grow, and rows that are replaced by key, as Parquet folders."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.versions import latest_version, upsert
from .commits import Commits, Conflict, Files

SCHEMAS = {
    "runs": "run_id string, run_at timestamp, items long, needs_order long, triggered_by string",
    "velocity_snapshots": "run_id string, run_at timestamp, item_id long, location_id long, raw_daily_sales double",
    "writeback_log": "log_id string, logged_at timestamp, sku string, location_id long, old_reorder_point long, new_reorder_point long, old_desired_level long, new_desired_level long, status string, error_message string",
    "po_push_log": "draft_id string, logged_at timestamp, item_id long, action string, quantity long, target_order_id long, status string",
    "eta_log": "order_id long, logged_at timestamp, old_eta date, new_eta date",
    "managed_skus": "sku string, item_id string, product string, brand string, vendor string, category string, added_by string, updated_at timestamp",
    "overrides": "sku string, location_id long, manual_reorder_point long, manual_desired_level long, locked boolean, updated_at timestamp",
    "brand_rules": "brand_name string, preferred_vendor_id string, preferred_vendor_name string, active boolean, created_at timestamp",
    "po_drafts": "draft_id string, vendor_id long, shop_id long, status string, target_order_id long, updated_at timestamp",
    "po_draft_lines": "draft_id string, item_id long, quantity long, tag string",
    "latest_stock": "item_id long, shop_id long, qoh long, updated_time timestamp, event_id long",
}
#: What stays of an old row when another of its key comes.
KEYS = {"managed_skus": (["sku"], ["item_id", "added_by"]), "overrides": (["sku", "location_id"], []), "brand_rules": (["brand_name"], ["created_at"])}
EXPORTED = ["logged_at", "sku", "location_id", "old_reorder_point", "new_reorder_point", "old_desired_level", "new_desired_level", "status"]


#: Tables of which rows are replaced or taken away by key, and the buckets that they are dealt into by its hash.
BUCKETED = {name: keys for name, (keys, _) in KEYS.items()} | {"po_drafts": ["draft_id"], "po_draft_lines": ["draft_id"], "latest_stock": ["item_id", "shop_id"]}
BUCKETS = 64
#: Of these a row only takes the place of an older one: what tells, newest first.
NEWEST = {"latest_stock": ["updated_time", "event_id", "qoh"]}
#: An appended row meets no other, so that an append that comes second is tried again so often.
TRIES = 100


class Store:
    """A folder of tables. Rows are written into new folders, and then a version that names them is claimed.

    A version's record lists its parts, (bucket, folder): tables with keys stand in buckets, so that a change writes those buckets anew that it falls in and takes over the
    rest. A writer claims the version after the one that it has read. If another writer was first, an append is added to what is there now, and all else
    raises Conflict and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(SCHEMAS[name])

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _commits(self, name: str) -> Commits:
        return Commits(self.spark, f"{self.folder}/{name}.versions")

    def _rows(self, name: str, parts: list) -> DataFrame:
        paths = [f"{self.folder}/{path}" for _, path in parts]
        return self.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.empty(name)

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*BUCKETED[name]), F.lit(buckets))

    def _write(self, name: str, rows: DataFrame, buckets: int) -> list:
        """Writes rows into a folder of their own; its parts."""
        folder, rows = f"{name}/{uuid.uuid4().hex}", rows.select(*self.schema(name).names)
        if name not in BUCKETED:
            rows.write.parquet(f"{self.folder}/{folder}")
            return [[None, folder]]
        rows = rows.withColumn("bucket", self._bucket(name, buckets)).repartition("bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
        found = [n for n in Files(self.spark, f"{self.folder}/{folder}").names() if n.startswith("bucket=")]
        return [[int(n[7:]), f"{folder}/{n}"] for n in found]

    def version(self, name: str) -> int:
        return self._commits(name).newest()[0]

    def read(self, name: str) -> DataFrame:
        """A table as it is; empty if nothing has been written."""
        return self._rows(name, self._commits(name).newest()[1].get("parts", []))

    def append(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows to the table as it is. batch: a stream's name and number; one that has been written is not written again."""
        commits, parts = self._commits(name), None
        for _ in range(TRIES):
            version, record = commits.newest()
            if batch and record.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return
            parts = self._write(name, rows, record.get("buckets", self.buckets)) if parts is None else parts
            try:
                return commits.claim(version, self._record(record, record.get("parts", []) + parts, batch))
            except Conflict:
                continue
        raise Conflict(f"{name}: other writers were first {TRIES} times")

    def _record(self, old: dict, parts: list, batch: tuple[str, int] | None = None) -> dict:
        batches = old.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
        return {"buckets": old.get("buckets", self.buckets), "parts": parts, "batches": batches}

    def replace(self, name: str, rows: DataFrame, read: int | None = None) -> None:
        """Puts rows in the place of the table's. Raises Conflict if it is no longer at version `read`, that of now unless given."""
        version, record = self._commits(name).newest()
        if read not in (None, version):
            raise Conflict(f"{name} is at version {version}, not {read}")
        self._commits(name).claim(version, self._record(record, self._write(name, rows, record.get("buckets", self.buckets))))

    def _change(self, name: str, read: tuple[int, dict], buckets: Iterable[int], change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Writes change(rows) of these buckets, of the version that was read, anew. The others' folders stay as they are."""
        version, record = read
        touched, parts = set(buckets), record.get("parts", [])
        new = self._write(name, change(self._rows(name, [p for p in parts if p[0] in touched])), record.get("buckets", self.buckets))
        self._commits(name).claim(version, self._record(record, [p for p in parts if p[0] not in touched] + new, batch))

    def merge(self, name: str, changes: DataFrame, at=None, batch: tuple[str, int] | None = None) -> None:
        """Replaces rows by key, and adds those whose key is new; updated_at of tables that have it becomes `at`. A brand rule without a vendor is never active.

        A table of NEWEST keeps the newest of all rows of a key, also of those in changes; the others take one row for each key. batch: as in append.
        """
        read = self._commits(name).newest()
        if batch and read[1].get("batches", {}).get(batch[0], -1) >= batch[1]:
            return
        if "updated_at" in self.schema(name).names:
            changes = changes.withColumn("updated_at", F.lit(at).cast("timestamp"))
        if name == "brand_rules":
            changes = checked_rules(changes)
        changes = changes.select(*self.schema(name).names)
        keys = BUCKETED[name]
        buckets = [r[0] for r in changes.select(self._bucket(name, read[1].get("buckets", self.buckets))).distinct().collect()]  # as many as there are
        if name in NEWEST:
            change = lambda rows: latest_version(rows.unionByName(changes), keys, [F.desc(c) for c in NEWEST[name]])
        else:
            change = lambda rows: upsert(rows, changes, keys, KEYS[name][1])
        self._change(name, read, buckets, change, batch)

    def _change_draft(self, name: str, draft_id: str, change: Callable[[DataFrame], DataFrame], read: tuple[int, dict] | None = None) -> None:
        read = read or self._commits(name).newest()
        draft = self.spark.range(1).select(F.lit(draft_id).alias("draft_id"))
        self._change(name, read, [draft.select(self._bucket(name, read[1].get("buckets", self.buckets))).first()[0]], change)

    def replace_lines(self, draft_id: str, lines: DataFrame, at) -> None:
        """Puts lines in the place of a draft's old ones, and marks the draft as changed."""
        own = F.col("draft_id") == draft_id
        new = lines.select(*self.schema("po_draft_lines").names).where(own)
        self._change_draft("po_draft_lines", draft_id, lambda rows: rows.where(~own).unionByName(new))
        self._change_draft("po_drafts", draft_id, lambda rows: rows.withColumn("updated_at", F.when(own, F.lit(at)).otherwise(F.col("updated_at"))))

    def set_status(self, draft_id: str, status: str, target_order_id: int | None, at, read: tuple[int, dict] | None = None) -> None:
        """An order id that isn't given leaves the old one."""
        own = F.col("draft_id") == draft_id
        order = F.coalesce(F.lit(target_order_id).cast("long"), F.col("target_order_id"))
        changed = {"status": F.lit(status), "target_order_id": order, "updated_at": F.lit(at).cast("timestamp")}
        self._change_draft("po_drafts", draft_id, lambda rows: rows.withColumns({c: F.when(own, x).otherwise(F.col(c)) for c, x in changed.items()}), read)

    def delete_draft(self, draft_id: str) -> None:
        for name in ("po_draft_lines", "po_drafts"):
            self._change_draft(name, draft_id, lambda rows: rows.where(F.col("draft_id") != draft_id))

    def compact(self, name: str) -> None:
        """Many small appends as one part for each bucket."""
        version, record = self._commits(name).newest()
        self.replace(name, self._rows(name, record.get("parts", [])), version)

    def clean(self, name: str, keep: int = 2, older_than: float = 86_400) -> int:
        """Deletes folders that none of the last `keep` versions names, and that are older than so many seconds, so that no writer is still at them; how many."""
        used = {path.split("/")[1] for record in self._commits(name).records(keep) for _, path in record["parts"]}
        files, gone = Files(self.spark, f"{self.folder}/{name}"), 0
        for folder in files.names():
            if folder not in used and files.fs.getFileStatus(files.path(folder)).getModificationTime() / 1000 < time.time() - older_than:
                gone += files.fs.delete(files.path(folder), True)
        return gone

    def drafts(self, status: str | None = None) -> DataFrame:
        """Drafts, newest first; of one status if it is given."""
        rows = self.read("po_drafts")
        return (rows.where(F.col("status") == status) if status else rows).orderBy(F.desc("updated_at"), "draft_id")

    def draft(self, draft_id: str) -> DataFrame:
        """A draft and its lines, as an array by item."""
        own = F.col("draft_id") == draft_id
        return with_lines(self.read("po_drafts").where(own), self.read("po_draft_lines").where(own))

    def start_push(self, draft_id: str, at) -> None:
        """Marks a draft as being pushed. Raises ValueError if there is none, or if it was pushed before or is being pushed; of several callers one gets through."""
        for _ in range(TRIES):
            read = self._commits("po_drafts").newest()
            row = self._rows("po_drafts", read[1].get("parts", [])).where(F.col("draft_id") == draft_id).first()
            if row is None or row["status"] in ("pushing", "pushed"):
                raise ValueError(f"draft {draft_id} {'is not there' if row is None else 'is ' + row['status']}")
            try:
                return self.set_status(draft_id, "pushing", None, at, read)
            except Conflict:
                continue  # perhaps for another draft's sake
        raise Conflict(f"draft {draft_id}: other writers were first {TRIES} times")

    def newest(self, name: str, n: int, by: str = "logged_at") -> DataFrame:
        return self.read(name).orderBy(F.desc(by), *self.schema(name).names[:1]).limit(n)

    def export_log(self, path: str) -> None:
        """The write-back log as CSV files, with a header."""
        self.read("writeback_log").select(*EXPORTED).write.mode("overwrite").csv(path, header=True)


def with_lines(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """drafts with `lines`, an array of (item_id, quantity, tag) by item: a draft goes to one vendor and shop, and its lines are as few as the items on it."""
    found = lines.groupBy("draft_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "quantity", "tag"))).alias("lines"))
    empty = F.array().cast(found.schema["lines"].dataType)
    return drafts.join(found, "draft_id", "left").withColumn("lines", F.coalesce("lines", empty))


def checked_rules(rules: DataFrame) -> DataFrame:
    none = F.coalesce(F.trim("preferred_vendor_id"), F.lit("")) == ""
    return rules.withColumns({"active": F.col("active") & ~none, "preferred_vendor_id": F.when(~none, F.col("preferred_vendor_id")), "preferred_vendor_name": F.when(~none, F.col("preferred_vendor_name"))})


def by_location(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """The rows of each known location, one by one; a location without any has one row of nulls, and `found` false."""
    return locations.select("location_id").join(rows.withColumn("found", F.lit(True)), "location_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def location_summary(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """(location_id, n, first_sku) of each known location: partial counts and minima, so that no task holds a location's rows."""
    sizes = rows.groupBy("location_id").agg(F.count("*").alias("n"), F.min("sku").alias("first_sku"))
    return locations.select("location_id").join(sizes, "location_id", "left").fillna({"n": 0, "first_sku": ""})


def write_by_location(rows: DataFrame, locations: DataFrame, path: str) -> None:
    """by_location's rows as Parquet, in a folder for each location. Tasks write what they have; no location goes to one of them."""
    by_location(rows, locations).write.mode("overwrite").partitionBy("location_id").parquet(path)


def newest_versions(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    return latest_version(log, keys, [F.desc(at), *(F.desc(c) for c in sorted(log.columns) if c not in (*keys, at))])
