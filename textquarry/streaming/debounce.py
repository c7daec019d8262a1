"""Bursts of changes in a stream, with state and event-time timers."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bucket_of(path: Column, buckets: int) -> Column:
    """Which of a project's buckets a path belongs to; SQL engines agree on it."""
    return F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


# Entries a row of state holds at most.
PAGE_ENTRIES = 1000


class BurstProcessor(StatefulProcessor):
    """Open bursts of one project and bucket, and how often each path changed in them.

    Both are map states whose rows are pages of at most ``PAGE_ENTRIES`` entries, so that
    work follows the events and not the calls to the state.  Bursts are spans of time
    that lie further apart than the gap; an event within the gap of two joins them.  An
    entry of a path carries a time within its burst, so spans that are joined leave it
    as it is.  One timer stands at the earliest end of a gap; bursts that the watermark
    has passed by then are given out and forgotten, and the timer moves on.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "page long", "first_us array<long>, last_us array<long>")
        self.paths = handle.getMapState("paths", "page long", "us array<long>, path array<string>, n array<long>")
        self.next_page = handle.getValueState("next_page", "page long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = Counter((r["us"], r["path"]) for r in rows if r["us"] is not None and r["path"] is not None)
        if not events:
            return iter(())
        pages = self._span_pages()
        known = [span for _, page in sorted(pages.items()) for span in page]
        spans: list[tuple] = []
        for first, last in sorted([*known, *((us, us) for us in {us for us, _ in events})]):
            if spans and first - spans[-1][1] <= self.gap_us:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((first, last))
        starts = [first for first, _ in spans]
        counts: dict[tuple, int] = defaultdict(int)
        for (us, path), n in events.items():
            counts[starts[bisect_right(starts, us) - 1], path] += n
        self._keep_paths(sorted((us, path, n) for (us, path), n in counts.items()))
        self._keep_spans(spans, pages)
        wanted = self._timer_of(spans)
        standing = list(self.handle.listTimers())
        for timer in standing:
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted not in standing:
            self.handle.registerTimer(wanted)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pages = self._span_pages()
        spans = [span for _, page in sorted(pages.items()) for span in page]
        over = [last + self.gap_us <= passed for _, last in spans]
        if any(over):
            starts = [first for first, _ in spans]
            counts: dict[tuple, int] = defaultdict(int)
            left = []
            for (page,), entries in list(self.paths.iterator()):
                ended, stay = [], []
                for us, path, n in zip(*entries):
                    at = bisect_right(starts, us) - 1
                    (ended if over[at] else stay).append((at, us, path, n))
                if ended:
                    self.paths.removeKey((page,))
                    left += [entry[1:] for entry in stay]
                for at, _, path, n in ended:
                    counts[at, path] += n
            self._keep_paths(sorted(left))
            for (at, path), n in counts.items():
                first, last = spans[at]
                yield Row(project_id=key[0], bucket=key[1], first_us=first, last_us=last, path=path, n_events=n)
        remaining = [span for span, ended in zip(spans, over) if not ended]
        self._keep_spans(remaining, pages)
        if remaining:
            self.handle.registerTimer(self._timer_of(remaining))

    def _timer_of(self, spans: list) -> int:
        """When the first of some bursts is over."""
        return -(-(min(last for _, last in spans) + self.gap_us) // 1000)

    def _span_pages(self) -> dict:
        return {k[0]: list(zip(*page)) for k, page in self.spans.iterator()}

    def _keep_spans(self, spans: list, pages: dict) -> None:
        """Write the pages that are not what they were, and drop those no longer needed."""
        cut = [spans[at : at + PAGE_ENTRIES] for at in range(0, len(spans), PAGE_ENTRIES)]
        for number, page in enumerate(cut):
            if pages.get(number) != page:
                self.spans.updateValue((number,), tuple(list(column) for column in zip(*page)))
        for number in pages:
            if number >= len(cut):
                self.spans.removeKey((number,))

    def _keep_paths(self, entries: list) -> None:
        """Add pages of (time within the burst, path, events)."""
        if not entries:
            return
        number = (self.next_page.get() or (0,))[0]
        for at in range(0, len(entries), PAGE_ENTRIES):
            page = entries[at : at + PAGE_ENTRIES]
            self.paths.updateValue((number,), tuple(list(column) for column in zip(*page)))
            number += 1
        self.next_page.update((number,))

    def close(self) -> None:
        pass


def debounce_rows(changes: DataFrame, quiet_seconds: float, lateness: str, buckets: int) -> DataFrame:
    """One row per burst and path of a stream of ``project_id, path, ts``.

    Rows without a path only move the clock.  A burst is given out once the watermark
    has passed its end by ``quiet_seconds``; later rows of it are dropped as late.
    """
    spark = changes.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    found = (
        changes.withWatermark("ts", lateness)
        # Asks for ts too, so that the optimiser leaves it above the watermark, which
        # rows without a path have to move.
        .where("path is not null or ts is null")
        .select(
            "project_id", bucket_of(F.col("path"), buckets).alias("bucket"), "path", "ts",
            F.unix_micros(F.col("ts")).alias("us"),
        )
        .groupBy("project_id", "bucket")
        .transformWithState(
            statefulProcessor=BurstProcessor(int(quiet_seconds * 1_000_000)),
            outputStructType="project_id string, bucket int, first_us long, last_us long, path string, n_events long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return found.select(
        "project_id", "bucket", F.timestamp_micros("first_us").alias("burst_start"),
        F.timestamp_micros("last_us").alias("burst_end"), "path", "n_events",
    )
