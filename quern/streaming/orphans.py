"""The orphan tracker over streams of references and parents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.orphans import PARENTS, REFERENCES, OrphanState, advance

BUCKETS = 64
_SCHEMAS = {"parents": PARENTS, "references": REFERENCES}


class OrphanStream:
    """Keeps the tracker's state in buckets of referred ids under a shared folder.

    A micro-batch of either stream reads the buckets that its ids fall into, and writes those anew under the next
    version. A version holds once its index file is there, which is written last: it says in which version each bucket
    stands and how far each stream has come. So a batch that is repeated after a crash finds either its result or the
    state before it, also in a new process; results are exactly-once. Versions that no bucket stands in are deleted once
    ``keep`` newer ones hold.
    """

    def __init__(self, spark, folder: str, keep: int = 3, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        where = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)
        found = self._versions()
        if found:
            self.index = json.loads(self.spark.read.text(self._index(found[-1]), wholetext=True).first()[0])
            if self.index["buckets"] != buckets:
                raise ValueError(f"{folder} has {self.index['buckets']} buckets")
        else:
            self.index = {"version": 0, "buckets": buckets, "at": {}, "done": {}}

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _index(self, version: int) -> str:
        return f"{self.folder}/index-{version:012d}.json"

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[6:-5]) for n in names if n.startswith("index-") and n.endswith(".json"))

    def _bucket(self, column: str = "ref_id") -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.index["buckets"])).cast("int")

    def _read(self, kind: str, buckets: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{self.index['at'][str(b)]}/{kind}/bucket={b}" for b in buckets if str(b) in self.index["at"]]
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        return self.spark.read.schema(_SCHEMAS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[kind])

    @property
    def version(self) -> int:
        return self.index["version"]

    def state(self, buckets: list[int] | None = None) -> OrphanState:
        every = list(range(self.index["buckets"])) if buckets is None else buckets
        return OrphanState(self._read("parents", every), self._read("references", every))

    def apply(self, kind: str, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of ``references`` (tbl, id, ref_id, created_at) or ``parents`` (ref_id, added_at, deleted_at)."""
        if self.index["done"].get(kind, -1) >= batch_id:
            return
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most all buckets
        version = self.version + 1
        at = f"{self.folder}/{version}"
        if touched:
            new = advance(self.state(touched), **{kind: batch})
            for name, frame in (("parents", new.parents), ("references", new.references)):
                frame.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{name}")
        index = self.index | {"version": version, "at": self.index["at"] | {str(b): version for b in touched}, "done": self.index["done"] | {kind: batch_id}}
        self._publish(index)
        self.index = index
        self._forget()

    def _publish(self, index: dict) -> None:
        """Write the index under another name and rename it, so that it is there whole or not at all."""
        draft = self._path(f"{self.folder}/draft-{index['version']}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(index).encode()))
        out.close()
        target = self._path(self._index(index["version"]))
        self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"can't publish version {index['version']}")

    def _forget(self) -> None:
        """Delete old indexes, and versions that neither the kept indexes nor the newest one refer to."""
        known = self._versions()
        for version in known[: -self.keep]:
            self._fs.delete(self._path(self._index(version)), False)
        oldest = known[-self.keep :][0]
        alive = set(self.index["at"].values())
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < oldest and int(name) not in alive:
                self._fs.delete(status.getPath(), True)

    def start(self, kind: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feed a stream of references or parents; run one stream at a time, as each batch needs the latest state."""
        write = stream.writeStream.foreachBatch(lambda batch, n: self.apply(kind, batch, n)).option("checkpointLocation", checkpoint)
        return write.trigger(**(trigger or {"availableNow": True})).start()
