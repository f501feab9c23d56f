"""Alerts from a stream of findings, each delivered once.

A batch's findings are matched against the outbox - the fingerprints that were delivered - and the others go
out in messages of EACH.  After each message its fingerprints are added to the outbox in one change.  A batch that
fails half way and runs again sends only what isn't in there.  If a machine is lost between a delivery and
its note, that one message comes again, with the same key, by which its receiver can tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..model import COLUMNS, rank_column
from ..sinks.reports import send
from ..sources.shared import staged
from ..sources.snapshots import Snapshots

EACH, MOST_PARTS = 50, 20
_SENT = "fingerprint string, batch long"
SHOWN = ("file", "line", "rule", "severity", "secret", "context", "entropy")


class Outbox:
    """Fingerprints of what was delivered, in a table that changes whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Snapshots(spark, path)

    def sent(self) -> DataFrame:
        return self.tables.read("sent", _SENT)

    def note(self, fingerprints: list[str], batch: int) -> None:
        self.tables.append(sent=self.spark.createDataFrame([(f, batch) for f in fingerprints], _SENT).coalesce(1))
        parts = self.tables.current()[1]
        if len(parts["sent"]) > MOST_PARTS:
            self.tables.replace(parts, sent=self.tables.read("sent", _SENT, parts).groupBy("fingerprint").agg(F.min("batch").alias("batch")))


def deliver(findings: DataFrame, batch: int, outbox: Outbox, transport: Callable[[dict], bool], redact: bool = True, wait: Callable[[float], None] | None = None) -> int:
    """Send what wasn't sent before, worst first; the number of findings sent.

    Each message is tried three times, after waits of 1 and 2 seconds; one that fails for good fails the batch."""
    keyed = findings.withColumn("fingerprint", X.fingerprint(F.col("rule"), F.col("secret"), F.col("file")))
    once = keyed.groupBy("fingerprint").agg(F.min_by(F.struct(*COLUMNS), F.struct(rank_column(F.col("severity")), "file", "line", "column")).alias("f"))
    new = staged(once.join(outbox.sent().select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint", "f.*"))
    shown = new.withColumn("secret", X.redact(F.col("secret")) if redact else F.col("secret"))
    rows = shown.orderBy(rank_column(F.col("severity")), "file", "line", "column", "fingerprint").select("fingerprint", *SHOWN).toLocalIterator()
    done = 0
    while some := list(islice(rows, EACH)):
        marks = [r["fingerprint"] for r in some]
        key = hashlib.sha256(f"{batch}:{','.join(sorted(marks))}".encode()).hexdigest()[:32]
        if not send({"key": key, "findings": [{c: r[c] for c in SHOWN} for r in some]}, transport, wait=wait):
            raise OSError(f"batch {batch}: a message could not be delivered")
        outbox.note(marks, batch)
        done += len(some)
    return done


def alert(findings: DataFrame, path: str, checkpoint: str, transport: Callable[[dict], bool], redact: bool = True, wait: Callable[[float], None] | None = None, **trigger) -> StreamingQuery:
    """Deliver a stream of findings; the outbox is at the path."""
    outbox = Outbox(findings.sparkSession, path)
    return findings.writeStream.foreachBatch(lambda rows, number: deliver(rows, number, outbox, transport, redact, wait) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
