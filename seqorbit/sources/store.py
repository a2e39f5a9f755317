"""A versioned, key-addressed table of sequences in the shared folder (G-8, T-1, S-9).

Layout: ``<path>/log/commit=<n>`` holds one row for each commit, written last; ``<path>/data/<name>``
holds the files of one commit, in folders ``bucket=<hex prefix of the key>``.  A reader sees
exactly the folders that the log names, so a write that failed half-way is invisible and is
written again by its next try.

Keys are 16 bytes (``key_of``).  A commit of n rows is spread over prefixes of so many
digits that a bucket holds about ``BUCKET_ROWS`` rows, and a look-up opens only the buckets that
hold one of its keys.  ``compact`` merges commits once younger ones add up to an older one, so
their number follows the logarithm of the table.  Together the rows read to look up a batch follow
the batch (keys x bucket x logarithm), not the table."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a bucket, about, as long as ``MAX_DIGITS`` digits are enough.
BUCKET_ROWS = 4096
MAX_DIGITS = 4
LOG = "commit int, kind string, name string, first int, digits int, batch_id long, n_rows long, n_late long, n_read long, high timestamp"


def key_of(sequence) -> Column:
    """A 16-byte key of a sequence (or of any value that prints alike)."""
    text = F.concat_ws("-", F.transform(sequence, lambda x: x.cast("string")))
    return F.unhex(F.md5(text))


class VersionedStore:
    """``key`` (16 bytes) and any other columns; all work on rows is done by Spark."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        self._log: list | None = None

    # -- log -----------------------------------------------------------------

    def log(self) -> list:
        """The commits in order: one small row each, read once and then kept up (a store
        has one writer at a time)."""
        if self._log is None:
            try:
                rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
            except AnalysisException:
                rows = []
            self._log = sorted((r.asDict() for r in rows), key=lambda r: r["commit"])
        return self._log

    def live(self) -> list:
        """Commits whose files are read: a compaction stands for the commits from its ``first`` on."""
        out: list = []
        for r in self.log():
            if r["kind"] == "compact":
                out = [x for x in out if x["commit"] < r["first"]]
            if r["n_rows"]:
                out.append(r)
        return out

    def _commit(self, kind: str, name: str, **facts) -> None:
        n = len(self.log())
        row = {"commit": n, "kind": kind, "name": name, "first": n, "digits": 0, "batch_id": None, "n_rows": 0, "n_late": 0,
               "n_read": 0, "high": None, **facts}
        fields = [f.split()[0] for f in LOG.split(", ")]
        one = self.spark.createDataFrame([tuple(row[c] for c in fields)], LOG).coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}/log/commit={n}")
        self._log.append(row)

    def names(self) -> set[str]:
        """The names of all commits."""
        return {r["name"] for r in self.log()}

    def high_mark(self):
        """The latest event time that a commit has seen."""
        return max((r["high"] for r in self.log() if r["high"] is not None), default=None)

    # -- reading -------------------------------------------------------------

    @staticmethod
    def _bucket(digits: int) -> Column:
        """The bucket folder of a key; "all" before the first split."""
        return F.lower(F.substring(F.hex("key"), 1, digits)) if digits else F.lit("all")

    def _read(self, commits: list) -> DataFrame | None:
        out = None
        for r in commits:
            rows = self.spark.read.parquet(f"{self.path}/data/{r['name']}").drop("bucket")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """All live rows, or None if there are none yet."""
        return self._read(self.live())

    def n_rows(self) -> int:
        return sum(r["n_rows"] for r in self.live())

    def known(self, keys: DataFrame) -> DataFrame | None:
        """``key`` of the live rows in the buckets that hold one of ``keys``."""
        spark, seen = keys.sparkSession, None
        for digits in sorted({r["digits"] for r in self.live()}):
            # at most 16 ** MAX_DIGITS names
            names = [r[0] for r in keys.select(self._bucket(digits)).distinct().collect()] if digits else None
            for r in (r for r in self.live() if r["digits"] == digits):
                rows = spark.read.schema("key binary, bucket string").parquet(f"{self.path}/data/{r['name']}")
                if names is not None and len(names) < 16 ** digits:
                    rows = rows.where(F.col("bucket").isin(names))
                rows = rows.select("key")
                seen = rows if seen is None else seen.union(rows)
        return seen

    def _digits(self, n: int) -> int:
        return min(MAX_DIGITS, round(math.log(max(n / self.bucket_rows, 1), 16)))

    def _write(self, rows: DataFrame, name: str, n: int) -> int:
        """Rows by bucket, sorted by key, each bucket in one file; returns the digits used."""
        digits = self._digits(n)
        parts = max(1, math.ceil(n / (16 * self.bucket_rows)))
        placed = rows.withColumn("bucket", self._bucket(digits))
        # one task for as few rows as 16 buckets hold, else ranges of keys
        placed = placed.coalesce(1) if parts == 1 else placed.repartitionByRange(parts, "bucket", "key")
        (placed.sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{name}"))
        return digits

    # -- writing -------------------------------------------------------------

    def add_new(self, rows: DataFrame, name: str, kind: str = "append", limit: int | None = None, batch_id: int | None = None,
                **facts) -> int:
        """Appends the rows whose key is not stored, one for each key (the least row), at most
        ``limit`` of them by key; returns how many.  A ``name`` that is committed already adds nothing."""
        if name in self.names():
            return 0
        others = [c for c in rows.columns if c != "key"]
        one = rows.groupBy("key").agg(F.min(F.struct(*others)).alias("row")).select("key", "row.*")
        seen = self.known(rows.select("key"))
        new = one if seen is None else one.join(seen, "key", "left_anti")
        if limit is not None:
            new = new.orderBy("key").limit(limit)
        new = materialize(new, "store-new")
        n = new.count()  # from the footers
        digits = self._write(new, name, n) if n else 0
        self._commit(kind, name, digits=digits, batch_id=batch_id, n_rows=n, n_read=seen.count() if seen is not None else 0, **facts)
        return n

    def compact(self) -> bool:
        """Merges the youngest commits with those before them that they outgrow (twofold);
        returns whether it did."""
        live = self.live()
        i, total = len(live) - 1, live[-1]["n_rows"] if live else 0
        while i > 0 and live[i - 1]["n_rows"] <= 2 * total:
            i -= 1
            total += live[i]["n_rows"]
        if i >= len(live) - 1:
            return False
        name = f"compact-{len(self.log())}"
        digits = self._write(self._read(live[i:]), name, total)
        self._commit("compact", name, first=live[i]["commit"], digits=digits, n_rows=total)
        return True
