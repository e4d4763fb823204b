"""Token-count rollups kept up to date by signed deltas.

A batch of changes says, for documents and tokenizer versions, that a document is deleted or
what its source, language and token count now are. Against the committed ledger every change
becomes signed rows: what was counted is taken back, what is counted now is added. Totals are
sums over all batches.

A batch's rows are written first and become visible by one entry in the log, whose number says
which state they were made against: an entry is renamed into place and never over another, so a
batch is there whole or not at all, and a writer that finds its number taken makes its rows anew
against the state it finds then. A batch whose name is in the log is not applied again. The ledger
is stored by hash buckets of document and version, of which a batch reads those it touches; every
``compact`` batches its net state is written, and older batches are not read any more.

Defined cases: changes without ``doc_id`` or version name nothing and are ignored; of several
changes of one document in a batch the one with the highest ``seq`` counts, of equal ones the
deletion, then the larger count; deleting what is not there changes nothing; null counts are 0;
a null source or language is a group of its own; an empty batch commits nothing but its name;
other columns are not read, and texts are not read at all: counts are made by the caller.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNED = "doc_id long, version string, source string, lang string, tokens long, docs long, bucket int"
TOTAL = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Log, ledger and totals below ``root``, a folder that all executors share.

    buckets: of the ledger; the first writer fixes it for good. compact: batches between two net
    states.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, compact: int = 16):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)
        entries = self.log()
        self.buckets = entries[0]["buckets"] if entries else buckets

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def log(self) -> list[dict]:
        """The committed entries in order."""
        top = self._path(f"{self.root}/log")
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(top)) if self.fs.exists(top) else []
        paths = [f"{self.root}/log/{n}" for n in names if n.endswith(".json")]
        found = [json.loads(r[0]) for r in self.spark.read.text(paths).collect()] if paths else []
        return sorted(found, key=lambda e: e["number"])

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return [e["name"] for e in self.log()]

    def _append(self, entry: dict) -> bool:
        """Puts an entry at its number; False where another one is there already."""
        made, place = self._path(f"{self.root}/staging/{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{entry['number']:010d}.json")
        self.fs.mkdirs(place.getParent())
        out = self.fs.create(made, False)
        out.write(json.dumps(entry).encode())
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        never_over = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        if self.fs.exists(place):
            return False
        try:
            files.rename(self.fs.makeQualified(made), self.fs.makeQualified(place), never_over)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _rows(self, entries: list[dict], table: str, schema: str) -> DataFrame:
        """What the newest net state and the batches after it have in a table."""
        at = max([k for k, e in enumerate(entries) if e["net"]], default=-1)
        found = [self.spark.read.schema(schema).parquet(f"{self.root}/data/{entries[at]['net']}/{table}")] if at >= 0 else []
        later = [f"{self.root}/data/{e['data']}/{table}" for e in entries[at + 1 :]]
        for path in later:
            found.append(self.spark.read.schema(schema).parquet(path))
        out = self.spark.createDataFrame([], schema)
        for more in found:
            out = out.unionByName(more)
        return out

    def _net(self, entries: list[dict], buckets: list[int] | None = None) -> DataFrame:
        rows = self._rows(entries, "ledger", SIGNED)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", "version", "source", "lang", "tokens", "bucket").agg(F.sum("docs").alias("docs")).where("docs > 0")

    def ledger(self) -> DataFrame:
        """What is counted now: one row per document and version."""
        return self._net(self.log()).drop("docs", "bucket")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all batches, without empty groups."""
        return _summed(self._rows(self.log(), "totals", TOTAL)).where("docs <> 0 or tokens <> 0")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", "version"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> DataFrame:
        rows.select(*[c.split()[0] for c in SIGNED.split(", ")]).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/ledger")
        return self.spark.read.schema(SIGNED).parquet(f"{path}/ledger")

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply (doc_id, version, source, lang, tokens, deleted, seq) once; False if it was there."""
        deleted = F.coalesce(F.col("deleted").cast("boolean"), F.lit(False))
        word = F.struct("seq", deleted.alias("deleted"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "source", "lang")
        while True:
            entries = self.log()
            if name in [e["name"] for e in entries]:
                return False
            # the first writer may have been another one
            self.buckets = entries[0]["buckets"] if entries else self.buckets
            last = changes.where("doc_id is not null and version is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(word).alias("w"))
            last = last.select("doc_id", "version", "w.source", "w.lang", "w.tokens", "w.deleted").withColumn("bucket", self._bucket())
            data = uuid.uuid4().hex
            last.write.parquet(f"{self.root}/staging/{data}")
            last = self.spark.read.schema(last.schema).parquet(f"{self.root}/staging/{data}")
            touched = [r[0] for r in last.select("bucket").distinct().collect()]
            old = self._net(entries, touched).join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            both = old.withColumn("docs", F.lit(-1).cast("long")).unionByName(last.where(~F.col("deleted")).drop("deleted").withColumn("docs", F.lit(1).cast("long")))
            both = both.groupBy("doc_id", "version", "source", "lang", "tokens", "bucket").agg(F.sum("docs").alias("docs")).where("docs <> 0")
            written = self._write(both, f"{self.root}/data/{data}")
            _summed(written.withColumn("tokens", F.col("docs") * F.col("tokens"))).write.parquet(f"{self.root}/data/{data}/totals")
            entry = {"number": len(entries), "name": name, "data": data, "net": None, "buckets": self.buckets}
            if (len(entries) + 1) % self.compact == 0:
                entry["net"] = uuid.uuid4().hex
                after = [*entries, entry | {"net": None}]
                self._write(self._net(after), f"{self.root}/data/{entry['net']}")
                _summed(self._rows(after, "totals", TOTAL)).write.parquet(f"{self.root}/data/{entry['net']}/totals")
            self.fs.delete(self._path(f"{self.root}/staging/{data}"), True)
            if self._append(entry):
                return True


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
