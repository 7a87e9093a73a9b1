"""The state of every material as its audit events arrive, with a timer for runs that got stuck.

Latest event, number of events and of failures are one value per material. While its latest event is
an unfinished stage, an event-time timer waits for the next one; when it fires first, the material is
reported as interrupted. A material that is finished and quiet for ``keep`` leaves the state.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels with the job; executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACTS = ["events", "failures", "log_id", "stage", "level", "created_at"]
MILLISECOND = datetime.timedelta(milliseconds=1)
EPOCH = datetime.datetime(1970, 1, 1)


def output_schema(audit: T.StructType) -> T.StructType:
    """Facts and the keys' types as the audit events have them."""
    return T.StructType([
        audit["material_id"], T.StructField("events", T.LongType()), T.StructField("failures", T.LongType()),
        audit["log_id"], audit["stage"], audit["level"], T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("interrupted", T.BooleanType()),
    ])


class Materials(StatefulProcessor):
    """``stuck`` and ``keep`` are milliseconds; without ``keep`` a material stays for good."""

    def __init__(self, schema: T.StructType, unfinished: list[str], stuck: int, keep: int | None):
        self.schema, self.unfinished, self.stuck, self.keep = schema, set(unfinished), stuck, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        facts = T.StructType([self.schema[name] for name in FACTS])
        self.facts = handle.getValueState("facts", facts)

    def _deadline(self, facts: tuple) -> tuple[int | None, bool]:
        """When to look again, in milliseconds, and whether the run counts as stuck then."""
        at = (facts[5] - EPOCH) // MILLISECOND
        if facts[3] in self.unfinished:
            return at + self.stuck, True
        return (None if self.keep is None else at + self.keep), False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        facts = tuple(self.facts.get()) if self.facts.exists() else None
        before = self._deadline(facts)[0] if facts else None
        for row in rows:
            events, failures = facts[:2] if facts else (0, 0)
            own = (row.log_id, row.stage, row.level, row.created_at)
            newest = own if facts is None or (own[3], own[0]) > (facts[5], facts[2]) else facts[2:]
            facts = (events + 1, failures + (row.level == "error"), *newest)
        self.facts.update(facts)
        after = self._deadline(facts)[0]
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield Row(material_id=key[0], **dict(zip(FACTS, facts)), interrupted=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.facts.exists():
            return
        facts = tuple(self.facts.get())
        deadline, stuck = self._deadline(facts)
        if expiredTimerInfo.getExpiryTimeInMs() != deadline:
            # The second timer of a stuck run: nothing has come since.
            stuck = False
        if stuck:
            if self.keep is not None:
                self.handle.registerTimer(deadline - self.stuck + self.keep)
            yield Row(material_id=key[0], **dict(zip(FACTS, facts)), interrupted=True)
        else:
            self.facts.clear()


def configured(spark: SparkSession):
    """Set the state store that such processors need; returns what sets the old one again."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    return lambda: spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def material_states(
    audit: DataFrame, unfinished: list[str], stuck: datetime.timedelta, late: str = "1 hour",
    keep: datetime.timedelta | None = None,
) -> DataFrame:
    """Latest facts per material in update mode, and once more with ``interrupted`` when its run got stuck.

    ``audit`` is a stream of ``material_id``, ``log_id``, ``stage``, ``level`` and ``created_at``
    (timestamp). A run is stuck when its latest event is an ``unfinished`` stage and the watermark, ``late``
    behind the newest event, is ``stuck`` past it. ``keep`` must be longer than ``stuck``.
    """
    if keep is not None and keep <= stuck:
        raise ValueError("keep must be longer than stuck")
    rows = audit.where(F.col("material_id").isNotNull()).withWatermark("created_at", late)
    # The state holds times without a zone, those of UTC.
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("created_at").cast("timestamp_ntz"))
    plain = rows.select("material_id", "log_id", "stage", "level", utc.alias("created_at"), F.col("created_at").alias("event_time"))
    schema = output_schema(plain.schema)
    processor = Materials(schema, unfinished, stuck // MILLISECOND, None if keep is None else keep // MILLISECOND)
    return plain.groupBy("material_id").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="EventTime")


def newest_states(batches: DataFrame) -> DataFrame:
    """The last row of every material from what ``jobs.upsert_batches`` wrote of ``material_states``."""
    facts = [c for c in batches.columns if c not in ("material_id", "batch")]
    # A timer fires after the batch's events were seen.
    newest = F.max_by(F.struct(*facts), F.struct("batch", "events", "interrupted"))
    return batches.groupBy("material_id").agg(newest.alias("_row")).select("material_id", "_row.*")
