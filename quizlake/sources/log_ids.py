"""S9 — ids of the answer log: a dense ascending sequence, as AUTOINCREMENT gives.

``dense_ids`` numbers the rows of one append: a range sort by answer time, the row
counts of its partitions, and the carry of the earlier partitions; no global window
and no shared counter. ``IdMarks`` keeps the last id that was given out in small
files beside the log (``_id_marks``, hidden from scans): an append reserves its
numbers by creating the next mark, which only one writer can do.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

_ROW_BITS = 33  # of monotonically_increasing_id: partition number above, row in the partition below


def dense_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``id`` to fill) numbered from 0 in ``order``. Rows equal
    in all columns of ``order`` are interchangeable. The sorted rows are staged, so a
    recomputed task cannot deal other numbers."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    dealt = stage(dealt, "log-ids")
    part, at = F.shiftright("id", _ROW_BITS), F.col("id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carry = (dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")))
    return (dealt.withColumn("part", part).join(F.broadcast(carry), "part")  # as many rows as there were partitions
            .withColumn("id", at + F.col("carry")).select(*rows.columns))


class IdMarks:
    """The ids given out so far for the log under ``root``; one small file an append."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self._jvm = sc._jvm
        self._folder = f"{root.rstrip('/')}/_id_marks"
        self._fs = self._path("").getFileSystem(sc._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        self._no_options = sc._gateway.new_array(self._jvm.java.nio.file.OpenOption, 0)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def _read(self, name: str) -> dict | None:
        path = self._path(name)
        for _ in range(50):  # a mark that another writer is just writing is still empty
            if not self._fs.exists(path):
                return None
            stream = self._fs.open(path)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:
                return json.loads(text)
            time.sleep(0.1)
        return None

    def _create(self, name: str, value: dict) -> bool:
        """False if the file is there already."""
        if self._local:  # its create() looks first and creates then, so two writers may both succeed
            file = self._jvm.java.io.File(self._path(name).toUri().getPath())
            file.getParentFile().mkdirs()
            if not file.createNewFile():
                return False
            self._jvm.java.nio.file.Files.write(file.toPath(), bytearray(json.dumps(value).encode()), self._no_options)
            return True
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:  # py4j wraps the store's exception
            if self._fs.exists(self._path(name)):
                return False
            raise e
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return True

    def newest(self) -> tuple[int, int | None]:
        """(number of the newest mark, last id given out); (0, None) without marks."""
        if not self._fs.exists(self._path("")):
            return 0, None
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("")) if f.isFile()]
        k = max((int(n) for n in names if n.isdigit()), default=0)
        return k, (self._read(f"{k:012d}") or {}).get("last") if k else None

    def reserve(self, count: int, batch: str, carried: Callable[[], int | None]) -> int:
        """First of ``count`` new ids. A batch that reserved before gets the same ids
        again. ``carried`` tells the largest id in a log that has no marks yet."""
        known = self._read(f"batch-{batch}")
        if known is not None:
            return known["first"]
        while True:
            k, last = self.newest()
            if last is None:
                last = carried() or 0
            value = {"first": last + 1, "last": last + count}
            if self._create(f"{k + 1:012d}", value):
                self._create(f"batch-{batch}", value)
                return last + 1

    def raise_to(self, last_id: int) -> None:
        """Ids up to ``last_id`` are taken (they came with their rows)."""
        while True:
            k, last = self.newest()
            if last is not None and last >= last_id or self._create(f"{k + 1:012d}", {"first": last_id, "last": last_id}):
                return
