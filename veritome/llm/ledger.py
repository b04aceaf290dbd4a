"""Duplicates hidden by formatting: canonical keys and an incremental, bucketed ledger."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, scratch

__all__ = ["BUCKET_ROWS", "DedupLedger", "canonical_key", "keyed_records", "letters_and_digits", "meta_form"]

#: A new ledger has buckets for ROOM times the rows of its first batch, of about BUCKET_ROWS rows each.
BUCKET_ROWS, ROOM = 1 << 18, 4
_LEDGER = "key binary, copies long, keep_id long, first_at timestamp, last_at timestamp, bucket int"
_FIELDS = "map<string,string>"


def letters_and_digits(c: Column) -> Column:
    """Only the letters and digits of a text, in order, with letter case folded."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{Nd}]+", "")


def meta_form(c: Column) -> Column:
    """A JSON object as its fields in name order, each value reduced to letters and digits.

    Null stays null. What is no JSON object is reduced as one plain value, so it can only
    equal the like. A field whose value is null differs from a field that is absent.
    """
    fields = F.from_json(c, _FIELDS)
    pairs = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(letters_and_digits(e["key"]), F.lit("\u0001"), F.coalesce(F.concat(F.lit("="), letters_and_digits(e["value"])), F.lit("!")))))
    return F.when(fields.isNull() & c.isNotNull(), F.concat(F.lit("?"), letters_and_digits(c))).otherwise(F.array_join(pairs, "\u0002"))


def canonical_key(text: Column, meta: Column) -> Column:
    """128 bits that two records share exactly when they differ in formatting only.

    A null text or meta equals a null one only; an empty text equals every text without
    letters and digits.
    """
    part = lambda x: F.coalesce(F.concat(F.lit("v"), x), F.lit("n"))
    return F.unhex(F.md5(F.concat(part(letters_and_digits(text)), F.lit("\u0003"), part(meta_form(meta)))))


def keyed_records(df: DataFrame, id_col: str, text: str, meta: str, at: str) -> DataFrame:
    """``record_id, key, at`` of every record; other columns are not read."""
    return df.select(F.col(id_col).alias("record_id"), canonical_key(F.col(text), F.col(meta)).alias("key"), F.col(at).alias("at"))


class _Folder:
    """The few file operations that the ledger needs, on whatever file system its folder is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file whole under another name, then rename it; fails where the name is taken."""
        if self.fs.exists(self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer was faster")
        draft = f"draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._at(name).getParent())
        if not self.fs.rename(self._at(draft), self._at(name)):
            raise OSError(f"could not publish {self.path}/{name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class DedupLedger:
    """Counts and earliest representative of every canonical key, kept batch by batch in a folder.

    The ledger is laid out by bucket of the key. A batch is first aggregated to one row per key (a
    group of copies shrinks on the map side, however large it is), then full-outer-joined with the
    buckets it touches: counts add up and the smallest record_id stays the representative. Other
    buckets keep their files. What is current is named by a manifest (the version of each bucket
    and the ids of the batches applied) that is written whole and then renamed. A job that dies
    before that leaves the ledger as it was, and what it wrote is removed by the next update. The
    same folder can be opened again at any time; a batch id that was applied changes nothing. One
    writer at a time. Files that an update replaces stay until the next one, for who reads them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "ledger")
        self.folder = _Folder(spark, self.path)
        known = self.folder.names("manifest")
        self.state = json.loads(self.folder.read(f"manifest/{known[-1]}")) if known else {"version": 0, "buckets": buckets, "at": {}, "batches": [], "replaced": []}

    @property
    def batches(self) -> list[str]:
        """The ids of the batches applied, in order."""
        return list(self.state["batches"])

    def _known(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The current rows of some or all buckets: one scan per version that still holds one of them."""
        held: dict[int, list[str]] = {}
        for b, v in self.state["at"].items():
            if buckets is None or int(b) in buckets:
                held.setdefault(v, []).append(f"{self.path}/v{v}/bucket={b}")
        out = None
        for v, files in sorted(held.items()):
            part = self.spark.read.schema(_LEDGER).option("basePath", f"{self.path}/v{v}").parquet(*files).select("bucket", "key", "copies", "keep_id", "first_at", "last_at")
            out = part if out is None else out.union(part)
        return out

    def update(self, batch: DataFrame, batch_id: str | None = None) -> bool:
        """Apply one batch of ``record_id, key, at``; False where its id was applied before. An empty batch only leaves its id."""
        batch_id = batch_id or uuid.uuid4().hex
        if batch_id in self.state["batches"]:
            return False
        version = self.state["version"] + 1
        if self.folder.names("manifest")[-1:] > [f"{version - 1:012d}.json"]:
            raise FileExistsError(f"{self.path}: another writer was faster; open the ledger again")
        n = self.state["buckets"] or 1 << max(0, math.ceil(math.log2(max(1, ROOM * batch.count() / BUCKET_ROWS))))
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
        fresh = bucketed.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("keep_id"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        touched = {r["bucket"] for r in bucketed.select("bucket").distinct().collect()}  # at most n rows
        old = self._known(touched)
        if old is not None:
            o, f = old.alias("o"), fresh.alias("n")
            pick = lambda c, g: g(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
            fresh = o.join(f, ["bucket", "key"], "full_outer").select(
                "bucket",
                "key",
                (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
                pick("keep_id", F.least),
                pick("first_at", F.least),
                pick("last_at", F.greatest),
            )
        for name in self.folder.names(""):  # left by a job that died
            if name.startswith("draft-") or (name.startswith("v") and int(name[1:]) >= version):
                self.folder.drop(name)
        if touched:
            # a bucket's rows are written by one task, into one file
            (fresh.repartition("bucket") if n > 1 else fresh).write.partitionBy("bucket").parquet(f"{self.path}/v{version}")
        replaced = [f"v{v}/bucket={b}" for b, v in self.state["at"].items() if int(b) in touched]
        new = {"version": version, "buckets": n, "at": self.state["at"] | {str(b): version for b in touched}, "batches": [*self.state["batches"], batch_id], "replaced": replaced}
        self.folder.publish(f"manifest/{version:012d}.json", json.dumps(new))
        for name in [*self.state["replaced"], *(f"manifest/{m}" for m in self.folder.names("manifest")[:-2])]:
            self.folder.drop(name)
        self.state = new
        return True

    def records(self) -> DataFrame:
        """``bucket, key, copies, keep_id, first_at, last_at``: one row per distinct record."""
        known = self._known()
        if known is None:
            return self.spark.createDataFrame([], "bucket int, key binary, copies long, keep_id long, first_at timestamp, last_at timestamp")
        return known


def collapse(df: DataFrame, id_col: str = "record_id", text: str = "text", meta: str = "meta", at: str = "ingested_at", batches: int = 2) -> tuple[DataFrame, DedupLedger]:
    """Feed a table to a new ledger in ``batches`` steps by arrival time; the keyed rows and the ledger."""
    rows = cut(keyed_records(df, id_col, text, meta, at))
    span = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    ledger = DedupLedger(df.sparkSession)
    if span["a"] is None or batches < 2 or span["a"] == span["b"]:
        ledger.update(rows, "0")
        return rows, ledger
    step = (span["b"] - span["a"]) / batches
    for k in range(batches):
        late = F.col("at") >= F.lit(span["a"] + step * k) if k else F.col("at").isNotNull()
        early = F.col("at") < F.lit(span["a"] + step * (k + 1)) if k < batches - 1 else F.lit(True)
        part = late & early
        ledger.update(rows.filter(part if k < batches - 1 else part | F.col("at").isNull()), str(k))
    return rows, ledger


def copies_of(rows: DataFrame, ledger: DedupLedger) -> DataFrame:
    """``keep_id, record_id``: one row for every record that repeats the representative of its key."""
    many = ledger.records().filter("copies > 1").select("key", "keep_id")
    return rows.join(many, "key").filter(F.col("record_id") != F.col("keep_id")).select("keep_id", "record_id")
