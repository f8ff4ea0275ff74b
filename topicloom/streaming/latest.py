"""A keep-latest table that grows by micro-batches: the newest row per id, in buckets by id.

A batch reads and writes only the buckets that its ids fall into. Their new contents go to a folder of the batch's own; then one small commit file
names the folder of every bucket, and is put in place by a rename. Readers follow the newest commit, so they see a batch whole or not at all.
A batch that runs again before its commit overwrites its folder; after its commit it does nothing. Keeping the latest of what was kept and of what is
new gives the latest of all, so the batches may cut the rows anywhere and in any order.

Null ids are one id, as in ``keep_latest``. An empty batch commits and changes nothing. ``_bucket`` is refused as a column of the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.dedupe import keep_latest
from topicloom.session import cut_lineage, delete_folder

_BUCKET, _ORDER, _FILE = "_bucket", "_order", "_file"


@dataclass
class LatestTable:
    """``order`` breaks ties of the timestamp, the greatest wins; several columns count from left to right."""

    spark: SparkSession
    path: str
    schema: T.StructType
    id_column: str
    ts: str
    order: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self):
        clash = {_BUCKET, _ORDER, _FILE} & set(self.schema.names)
        if clash:
            raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def commits(self) -> list[int]:
        fs, where = self._files(f"{self.path}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        done = self.commits()
        if not done:
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/commits/{done[-1]:020d}").collect()
        return {int(b): f for b, f in json.loads(rows[0][0]).items()}

    def read(self) -> DataFrame:
        """The newest row of every id."""
        return self._read(self.folders())

    def _read(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folders[b]}/{_BUCKET}={b}" for b in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.id_column), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; ``batch_id`` grows from batch to batch, and one that is committed is left alone."""
        done = self.commits()
        if done and batch_id <= done[-1]:
            return
        rows = cut_lineage(batch.select(*self.schema.names).withColumn(_BUCKET, self._bucket()))
        touched = [r[0] for r in rows.select(_BUCKET).distinct().collect()]  # as many as buckets at most
        folders = self.folders()
        old = self._read({b: folders[b] for b in touched if b in folders}).withColumn(_BUCKET, self._bucket())
        both = rows.unionByName(old).withColumn(_ORDER, F.struct(*self.order))
        newest = keep_latest(both, self.id_column, self.ts, _ORDER).drop(_ORDER)
        cores = self.spark.sparkContext.defaultParallelism
        files = max(1, -(-cores // max(1, len(touched))))
        dealt = newest.withColumn(_FILE, F.pmod(F.xxhash64(self.id_column, F.lit(1)), F.lit(files))).repartition(_BUCKET, _FILE).drop(_FILE)
        folder = f"batch-{batch_id:020d}"
        if touched:
            dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        self._commit(batch_id, folders | {b: folder for b in touched})

    def _commit(self, batch_id: int, folders: dict[int, str]) -> None:
        fs, draft = self._files(f"{self.path}/commits/.draft-{batch_id:020d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, final = self._files(f"{self.path}/commits/{batch_id:020d}")
        if not fs.rename(draft, final):
            raise RuntimeError(f"batch {batch_id} could not be committed")

    def vacuum(self) -> None:
        """Delete what the newest commit does not need; not while others read older ones."""
        used, done = set(self.folders().items()), self.commits()
        fs, where = self._files(self.path)
        for folder in [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []:
            if not folder.startswith("batch-") or (done and int(folder[6:]) > done[-1]):
                continue
            kept = [b for b, f in used if f == folder]
            if not kept:
                delete_folder(self.spark, f"{self.path}/{folder}")
                continue
            for part in fs.listStatus(self._files(f"{self.path}/{folder}")[1]):
                name = part.getPath().getName()
                if name.startswith(f"{_BUCKET}=") and int(name.split("=")[1]) not in kept:
                    delete_folder(self.spark, f"{self.path}/{folder}/{name}")


def merge_stream(records: DataFrame, table: LatestTable, checkpoint: str) -> None:
    """Take in what has landed, batch by batch, and stop."""
    query = records.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
