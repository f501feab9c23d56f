"""Results of scans as tables, by id: kept for a time, read page by page.

Each scan is a table of its own among the snapshots, its findings numbered in report order.  Whoever serves
them holds ids only, and any process that sees the folder can serve them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, FINDING, rank_column
from ..sources.lines import numbered
from ..sources.snapshots import Snapshots

_KEPT = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FINDING.fields) + ", place long"
PAGE = 1000


class ScanRegistry:
    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600.0):
        self.spark, self.seconds = spark, seconds
        self.tables = Snapshots(spark, path)

    def _name(self, key: str, now: float) -> str | None:
        """The scan's table, which tells its time; none if it is too old or unknown."""
        found = [n for n in self.tables.current()[1] if n.startswith(f"{key}@")]
        return found[0] if key and found and now - float(found[0].split("@")[1]) < self.seconds else None

    def put(self, findings: DataFrame, now: float) -> str:
        """Keep findings (as shown, secrets and all); gives their id.  What is too old goes."""
        key = uuid.uuid4().hex
        order = findings.select(*COLUMNS, F.lit(0).alias("__scan"), rank_column(F.col("severity")).alias("__rank"), F.monotonically_increasing_id().alias("__id"))
        placed = numbered(order, "__scan", ["__rank", "file", "line", "column", "rule", "__id"], "place").select(*COLUMNS, "place")
        written = self.tables.write(placed.repartitionByRange("place").sortWithinPartitions("place"))
        self.tables.change(lambda parts: {n: p for n, p in parts.items() if now - float(n.split("@")[1]) < self.seconds} | {f"{key}@{now!r}": [written]})
        return key

    def page(self, key: str, now: float, after: int = 0, size: int = PAGE) -> list[dict] | None:
        """At most `size` findings after a place, in order, with their places; None if there is no such scan."""
        name = self._name(key, now)
        if name is None:
            return None
        rows = self.tables.read(name, _KEPT).where((F.col("place") > after) & (F.col("place") <= after + size)).orderBy("place")
        return [r.asDict() for r in rows.collect()]

    def findings(self, key: str, now: float) -> DataFrame | None:
        name = self._name(key, now)
        return None if name is None else self.tables.read(name, _KEPT)
