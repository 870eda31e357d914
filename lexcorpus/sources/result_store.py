"""Results kept by key in buckets: a growing history is joined without being exchanged.

A store is a Parquet table in one folder, partitioned by batch and bucketed by the key columns. Rows
that are looked up are dealt into the same buckets, and every join and grouping then happens bucket by
bucket: the history is scanned (column-pruned) where it lies. Looking up which keys are done streams the
history past a hash table of the new keys; joining answers back first keeps only the history of the
keys in question. Both need memory by the size of the new rows, not of the history.

The number of buckets is fixed when a store is made and written beside the table, so any later
session opens it with the same layout. Writing a batch again replaces that batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

RESULT_FIELDS = "output string, status string, attempts int, error string"


def latest_results(results: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """One row per key: a good result if there is any, else the failure of the last batch."""
    picked = F.max_by(
        F.struct("output", "status", "attempts", "error"),
        F.struct((F.col("status") == "ok").alias("ok"), "batch", "output"),
    )
    return results.groupBy(*keys).agg(picked.alias("r")).select(*keys, "r.*")


def next_number(batches: Sequence[str], batch: str) -> int:
    """Number of the first chunk that no earlier run of this batch has written."""
    own = [int(b.rsplit("-", 1)[1]) for b in batches if b.startswith(f"{batch}-")]
    return max(own, default=-1) + 1


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class ResultStore:
    """Results of the rows of one corpus, by key. ``buckets`` counts only for a store that is new."""

    def __init__(self, df: DataFrame, path: str, keys: Sequence[str] = ("id",), buckets: int | None = None):
        self.spark, self.path, self.keys = df.sparkSession, path.rstrip("/"), list(keys)
        types = {f.name: f.dataType for f in df.schema.fields}
        fields = [T.StructField(k, types[k]) for k in self.keys]
        self.schema = T.StructType(fields + T._parse_datatype_string(RESULT_FIELDS).fields)
        self.buckets = self._layout(buckets)
        self.name = "lexcorpus_results_" + hashlib.md5(self.path.encode()).hexdigest()
        self._register()

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets of the store, written down when it is made."""
        spec = f"{self.path}/layout"
        try:
            found = json.loads(self.spark.read.text(spec, wholetext=True).first()[0])
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            found = {"keys": self.keys, "buckets": buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))}
            self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(spec)
        if found["keys"] != self.keys:
            raise ValueError(f"the store in {self.path} is kept by {found['keys']}, not by {self.keys}")
        return found["buckets"]

    def _register(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            return
        folder = self._folder("data")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(map(_quoted, self.keys))
        location = f"{self.path}/data".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        self.spark.catalog.recoverPartitions(self.name)

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def history(self) -> DataFrame:
        """All results so far: keys, output, status, attempts, error, batch."""
        return self.spark.table(self.name)

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` in the buckets of the store."""
        return df.repartition(self.buckets, *self.keys)

    def _insert(self, how: str, rows: DataFrame, batch: str) -> None:
        columns = ", ".join(map(_quoted, self.schema.fieldNames()))
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"INSERT {how} TABLE {self.name} PARTITION (batch = '{name}') SELECT {columns} FROM {{rows}}", rows=rows)

    def append(self, df: DataFrame, batch: str) -> None:
        """Results of one batch, a file per bucket; the same batch again replaces the earlier one."""
        self._insert("OVERWRITE", self.dealt(df.select(*self.schema.fieldNames())), batch)

    def pending(self, df: DataFrame) -> DataFrame:
        """Distinct keys of ``df`` without a good result. Failed keys are pending again."""
        new = self.dealt(df.select(*self.keys)).distinct()
        good = self.history().where(F.col("status") == "ok").select(*self.keys)
        done = good.join(new.hint("shuffle_hash"), self.keys, "left_semi")
        return new.join(done.hint("shuffle_hash"), self.keys, "left_anti")

    def answers(self, df: DataFrame) -> DataFrame:
        """The latest result of each key of ``df`` that has one."""
        asked = self.dealt(df.select(*self.keys)).distinct()
        return latest_results(self.history().join(asked.hint("shuffle_hash"), self.keys, "left_semi"), self.keys)

    def joined(self, df: DataFrame, out: str = "output") -> DataFrame:
        """``df`` with the latest output of each row's key, and its status."""
        found = self.answers(df).select(*self.keys, F.col("output").alias(out), "status")
        return self.dealt(df).join(found.hint("merge"), self.keys, "left")

    def batches(self) -> list[str]:
        """Names of the batches, in order: one row of the catalog each."""
        found = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return sorted(row.partition.split("=", 1)[1] for row in found)

    def compact(self, batch: str) -> None:
        """One row per key as a new batch ``<batch>-<number>`` in place of all batches so far; nothing is exchanged.

        The new batch is complete before an old one goes. Breaking off in between leaves copies of
        results, which change no answer.
        """
        old = self.batches()
        self._insert("INTO", latest_results(self.history(), self.keys), f"{batch}-{next_number(old, batch):06d}")
        for gone in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (batch = '{gone}')")
            folder = self._folder(f"data/batch={gone}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def forget(self) -> None:
        """Drops the name from the catalog; the results stay in their folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
