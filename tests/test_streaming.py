import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from textquarry.plans import refresh
from textquarry.session import scratch_path
from textquarry.sources.files import file_rows
from textquarry.sources.sessions import export_sessions, memory_list, memory_read, notes_to_files
from textquarry.sources.store import IndexStore
from textquarry.streaming.changes import (
    debounce_changes,
    debounce_stream,
    start_change_stream,
    with_clock,
)
from textquarry.streaming.debounce import BurstProcessor
from textquarry.streaming.memory import (
    rebuild_memory,
    start_memory_sweep,
    start_memory_sync,
    sweep_sessions,
    sync_sessions,
)
from textquarry.workload import catalog

CHANGES = "project_id string, path string, op string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


EVENTS = [
    ("p", "/a", "write", _at(0)), ("p", "/b", "create", _at(1.5)), ("p", "/a", "write", _at(3.5)),
    ("p", "/c", "chmod", _at(4.5)),  # not followed, so it does not prolong the burst
    ("p", "/d", "remove", _at(5.500001)), ("q", "/a", "rename", _at(1)), ("p", "/e", "write", _at(9000)),
    ("p", "/f", "write", _at(3599)), ("p", "/g", "write", _at(3600)), ("p", "/h", "write", _at(3602)),
]


def _bursts(df):
    return sorted((r.project_id, r.burst_start, r.burst_end, r.path, r.n_events) for r in df.collect())


def test_bursts(spark):
    events = spark.createDataFrame(EVENTS, CHANGES)
    want = sorted(
        [
            ("p", _at(0), _at(3.5), "/a", 2), ("p", _at(0), _at(3.5), "/b", 1),
            ("p", _at(5.500001), _at(5.500001), "/d", 1), ("q", _at(1), _at(1), "/a", 1),
            ("p", _at(9000), _at(9000), "/e", 1),
            # one burst across the edge of a time block
            ("p", _at(3599), _at(3602), "/f", 1), ("p", _at(3599), _at(3602), "/g", 1), ("p", _at(3599), _at(3602), "/h", 1),
        ]
    )
    assert _bursts(debounce_changes(events)) == want
    assert _bursts(debounce_changes(events, block_seconds=1)) == want
    assert _bursts(debounce_changes(events, block_seconds=10**6)) == want


TICK = (None, None, "tick", _at(999_999))  # a row without a path moves the clock


def _run_stream(spark, source, folder, **options):
    stream = spark.readStream.schema(CHANGES).parquet(source)
    debounce_stream(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/cp"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("buckets", [1, 3])
def test_stream_gives_the_same_bursts(spark, tmp_path, buckets):
    source = str(tmp_path / "in")
    events = spark.createDataFrame([*EVENTS, TICK], CHANGES)
    events.coalesce(1).write.parquet(source)
    got = _run_stream(spark, source, tmp_path, buckets=buckets)
    want = debounce_changes(spark.createDataFrame(EVENTS, CHANGES), buckets=buckets)
    key = lambda df: sorted(tuple(r[c] for c in want.columns) for r in df.collect())
    assert key(got) == key(want)


def test_bursts_meet_across_batches(spark, tmp_path):
    """A late event joins two open bursts; what has ended stays ended."""
    source = str(tmp_path / "in")

    def run(rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        return _bursts(_run_stream(spark, source, tmp_path, lateness="20 seconds"))

    assert run([("p", "/a", "write", _at(0)), ("p", "/b", "write", _at(3)), ("p", "/a", "write", _at(3.5))]) == []
    ended = [("p", _at(0), _at(4), "/a", 2), ("p", _at(0), _at(4), "/b", 2)]
    assert run([("p", "/b", "write", _at(1.5)), ("p", "/c", "write", _at(4)), ("p", "/c", "write", _at(60))]) == sorted(
        [*ended, ("p", _at(0), _at(4), "/c", 1)]
    )
    again = run([("p", "/late", "write", _at(1)), TICK])
    assert again == sorted([*ended, ("p", _at(0), _at(4), "/c", 1), ("p", _at(60), _at(60), "/c", 1)])


class _State(dict):
    """A map, value and timer state in memory that counts what it is asked for."""

    calls = 0

    def iterator(self):
        self.calls += 1
        return iter([((k,), v) for k, v in self.items()])

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key[0]] = value

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key[0])

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key[0]]


class _Value:
    kept = None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value


class _Handle:
    def __init__(self):
        self.states, self.timers, self.registered = [], set(), 0

    def getMapState(self, *_):  # noqa: N802
        self.states.append(_State())
        return self.states[-1]

    def getValueState(self, *_):  # noqa: N802
        return _Value()

    def listTimers(self):  # noqa: N802
        return iter(set(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.registered += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_many_bursts_cost_few_state_calls():
    """Thousands of open bursts of one project: a page of state each thousand, and one timer."""
    handle, n = _Handle(), 3000
    bursts = BurstProcessor(2_000_000)
    bursts.init(handle)
    rows = [{"us": i * 60_000_000, "path": f"/f{i}"} for i in range(n)]
    list(bursts.handleInputRows(("p", 0), iter(rows[: n // 2]), _Clock(0)))
    list(bursts.handleInputRows(("p", 0), iter(rows[n // 2 :] + rows[5:6]), _Clock(0)))
    assert handle.timers == {2000}

    def expire(ms):
        due = {at for at in handle.timers if at <= ms}
        got = [r for at in due for r in bursts.handleExpiredTimer(("p", 0), _Clock(ms), at)]
        handle.timers -= due
        return sorted((r["first_us"], r["last_us"], r["path"], r["n_events"]) for r in got)

    want = [(i * 60_000_000, i * 60_000_000, f"/f{i}", 2 if i == 5 else 1) for i in range(n)]
    assert expire(1999) == []
    assert expire(100 * 60_000 + 1999) == want[:100]
    assert handle.timers == {100 * 60_000 + 2000}
    assert expire(n * 60_000) == want[100:]
    assert not handle.timers and not any(handle.states)
    assert sum(s.calls for s in handle.states) + handle.registered < 100


def test_a_clock_ends_the_last_burst(spark, tmp_path):
    """Nothing happens after the last change, but time goes on."""
    source = str(tmp_path / "in")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([("p", "/a", "write", now), ("p", "/a", "write", now)], CHANGES).write.parquet(source)
    bursts = debounce_stream(with_clock(spark.readStream.schema(CHANGES).parquet(source)), lateness="0 seconds")
    job = bursts.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp"
    ).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if [n for n in os.listdir(tmp_path) if n == "out"] and spark.read.schema(bursts.schema).parquet(f"{tmp_path}/out").count():
                break
    finally:
        job.stop()
    assert [(r.path, r.n_events) for r in spark.read.schema(bursts.schema).parquet(f"{tmp_path}/out").collect()] == [("/a", 2)]


def test_change_stream(spark, tmp_path):
    """Two changes of a path within the gap are one application; projects go by their roots."""
    store = IndexStore(spark, scratch_path(spark, "stream"))
    source = str(tmp_path / "in")
    tree = {"/r/a.md": "# A\n", "/r/b.md": "# B\n", "/other/c.md": "# C\n"}
    asked = []

    def files(touched):
        names = {r.path for r in touched.collect()}
        asked.append(names)
        rows = [("x", path, text) for path, text in tree.items() if path in names]
        raw = spark.createDataFrame(rows, "project_id string, path string, content string")
        return file_rows(raw, root="/")

    projects = spark.createDataFrame([("p", "/r", 0)], "project_id string, root string, ord int")

    def run(rows):
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).parquet(source)
        start_change_stream(
            stream, store, files, str(tmp_path / "cp"), projects=projects, trigger={"availableNow": True}
        ).awaitTermination()
        return sorted((r.symbol, r.project_id) for r in store.symbols().collect())

    tick = lambda s: (None, None, "tick", _at(s))
    created = [("p", "/r/a.md", "create", _at(0)), ("p", "/r/b.md", "create", _at(1)), ("p", "/other/c.md", "create", _at(1))]
    assert run([*created, ("p", "/r/a.md", "write", _at(2)), tick(20)]) == [("# A", "p"), ("# B", "p"), ("# C", "other")]
    assert asked == [{"/r/a.md", "/r/b.md", "/other/c.md"}]
    tree.update({"/r/a.md": "# A2\n"})
    del tree["/r/b.md"]
    changed = [("p", "/r/a.md", "write", _at(30)), ("p", "/r/b.md", "remove", _at(30)), ("p", "/r/a.md", "chmod", _at(31))]
    assert run([*changed, tick(60)]) == [("# A2", "p"), ("# C", "other")]
    assert len(asked) == 2


TURNS = "conv_id long, turn long, role string, text string"
WHEN = "2024-02-01 00:00:00"


def _when():
    return F.lit(WHEN).cast("timestamp_ntz")


def _sessions(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def test_session_markdown(spark):
    turns = _sessions(
        spark,
        [(1, 0, "user", "user question #1"), (1, 1, "system", "be kind"), (1, 2, "user", "short"), (1, 3, "assistant", "be kind")],
    )
    row = export_sessions(turns, _when()).first()
    assert row.path == "/memory/1.md" and row.project_id == "memory-cascade"
    assert row.content == (
        "# Chat trajectory: 1\n\n- **Provider:** cascade\n- **Source:** `1`\n- **Decrypted size:** 35 bytes\n"
        "- **Dialogue turns:** 3\n- **Extracted strings:** 3\n- **Exported:** 2024-02-01T00:00:00Z\n\n---\n\n"
        "## Dialogue\n\n### User\n\nuser question \\#1\n\n### Assistant\n\nbe kind\n\n### Assistant\n\nbe kind\n\n"
        "## All extracted strings\n\nuser question \\#1\n\nbe kind\n\nshort\n\n"
    )
    assert "## Dialogue" not in export_sessions(_sessions(spark, [(2, 0, "user", "x")]), _when()).first().content


def test_session_in_parts(spark):
    rows = [(7, 3 * i, "user" if i % 2 == 0 else "assistant", f"turn number {i % 9}") for i in range(25)]
    rows += [(8, 0, "user", "a short session")]
    files = {r.path: r.content for r in export_sessions(_sessions(spark, rows), _when(), turns_per_file=10).collect()}
    assert set(files) == {"/memory/7.md", "/memory/7.part1.md", "/memory/7.part2.md", "/memory/8.md"}
    whole = {r.path: r.content for r in export_sessions(_sessions(spark, rows), _when()).collect()}
    assert set(whole) == {"/memory/7.md", "/memory/8.md"}

    def dialogue(text):
        return text.split("## Dialogue\n\n", 1)[1].split("## All", 1)[0]

    parts = [files[f"/memory/7{k}.md"] for k in ("", ".part1", ".part2")]
    assert "".join(dialogue(p) for p in parts) == dialogue(whole["/memory/7.md"])
    counts = [p.split("turns:** ")[1].split("\n")[0] for p in parts]
    assert counts == ["10", "10", "5"] and "**Extracted strings:** 9\n" in whole["/memory/7.md"]


def test_memory_read(spark):
    files = spark.createDataFrame([("/memory/a.md", "A"), ("/etc/x", "X")], "path string, content string")
    asked = spark.createDataFrame(
        [("/memory/a.md",), ("/memory/b.md",), ("/etc/x",), ("/memory/../etc/x",), ("/memoryx/a",)], "path string"
    )
    got = {r.path: (r.content, r.status) for r in memory_read(files, asked).collect()}
    assert got == {
        "/memory/a.md": ("A", "ok"), "/memory/b.md": (None, "not_found"), "/etc/x": (None, "not_allowed"),
        "/memory/../etc/x": (None, "not_allowed"), "/memoryx/a": (None, "not_allowed"),
    }


def test_memory_read_query_asks_for_every_part(spark, tmp_path):
    """All turns of a session are read, however many files it has."""
    turns = [(c, i, "user" if i % 2 else "assistant", f"turn {i} of session {c}") for c, n in ((1, 1), (2, 3), (3, 10)) for i in range(n)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalog.QUERIES["memory_read"](spark, str(tmp_path)).collect()
    assert len(rows) == 1 + 1 + 4 + 2 and sum(r.status == "ok" for r in rows) == 6
    texts = "".join(r.content or "" for r in rows)
    assert all(text in texts for *_, text in turns)


def test_memory_sync_and_rebuild(spark, tmp_path):
    store = IndexStore(spark, scratch_path(spark, "memory"))
    source = str(tmp_path / "turns")

    def sessions(touched):
        return spark.read.schema(TURNS).parquet(source).join(touched, "conv_id", "left_semi")

    def sync(rows):
        _sessions(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TURNS).parquet(source)
        start_memory_sync(
            stream, store, sessions, _when(), str(tmp_path / "cp"), trigger={"availableNow": True}
        ).awaitTermination()

    sync([(1, 0, "user", "first question"), (2, 0, "user", "other session")])
    sync([(1, 1, "assistant", "an answer")])
    turns = spark.read.schema(TURNS).parquet(source)
    once = IndexStore(spark, scratch_path(spark, "memory"))
    sync_sessions(once, turns, _when())
    ids = lambda s: sorted(r.chunk_id for r in s.chunk_vectors().collect())
    assert ids(store) == ids(once) and len(ids(once)) == 4 + 3 + 2
    rebuild_memory(store, turns.where("conv_id = 2"), _when())
    assert {r.path for r in store.file_state().collect()} == {"/memory/2.md"}


def test_notes(spark):
    notes = spark.createDataFrame(
        [
            ("Important Decision", "Use Ollama for embeddings.", ["embedding", "decision"], "", _at(0)),
            ("Plain", "Text", [], "cursor", _at(1)),
            (" ", "no title", [], "", _at(2)),
            ("no content", "", [], "", _at(3)),
        ],
        "title string, content string, tags array<string>, provider string, saved_at timestamp",
    )
    files = notes_to_files(notes)
    got = {r.path: r.content for r in files.collect()}
    assert got == {
        "/memory/20240101-000000-important-decision.md": (
            "# Important Decision\n\n- **Provider:** cascade\n- **Tags:** embedding, decision\n"
            "- **Saved:** 2024-01-01T00:00:00Z\n\nUse Ollama for embeddings.\n"
        ),
        "/memory/20240101-000001-plain.md": "# Plain\n\n- **Provider:** cursor\n- **Saved:** 2024-01-01T00:00:01Z\n\nText\n",
    }
    assert [r.path for r in memory_list(files, "cursor").collect()] == ["/memory/20240101-000001-plain.md"]
    chunks = refresh.build_chunk_vectors(file_rows(files))
    assert chunks.count() == 2


def test_sweep_finds_what_no_event_told(spark):
    """Grown, cut, changed and vanished sessions; parts that are left over go."""
    store = IndexStore(spark, scratch_path(spark, "memory"))
    how = {"turns_per_file": 2}
    rows = [(c, k, "user", f"question {c} {k} of a session") for c in range(5) for k in range(4)]
    assert sweep_sessions(store, _sessions(spark, rows), _when(), **how) == 5
    assert sweep_sessions(store, _sessions(spark, rows), _when(), **how) == 0
    now = [r for r in rows if r[0] != 0 and not (r[0] == 1 and r[1] > 1)]
    now = [(c, k, role, text + "!" if c == 2 else text) for c, k, role, text in now] + [(3, 4, "assistant", "more")]
    batch = store.applied("x")
    assert sweep_sessions(store, _sessions(spark, now), _when(), **how) == 4 and batch == -1
    once = IndexStore(spark, scratch_path(spark, "memory"))
    sync_sessions(once, _sessions(spark, now), _when(), **how)
    ids = lambda s: sorted(r.chunk_id for r in s.chunk_vectors().collect())
    paths = lambda s: sorted(r.path for r in s.file_state().collect())
    assert ids(store) == ids(once) and paths(store) == paths(once)
    assert paths(store) == sorted(["/memory/1.md", *(f"/memory/{c}{p}.md" for c in (2, 3, 4) for p in ("", ".part1")), "/memory/3.part2.md"])


def test_sweep_at_every_tick(spark, tmp_path):
    store = IndexStore(spark, scratch_path(spark, "memory"))
    said = [(1, 0, "user", "a first question")]
    job = start_memory_sweep(
        spark, store, lambda: _sessions(spark, said), _when(), str(tmp_path / "cp"), trigger={"processingTime": "1 second"}
    )
    try:
        for _ in range(60):
            if store.file_state().count():
                break
            time.sleep(1)
        said.append((2, 0, "user", "nobody told of this"))
        for _ in range(60):
            if store.file_state().count() == 2:
                break
            time.sleep(1)
    finally:
        job.stop()
    assert {r.path for r in store.file_state().collect()} == {"/memory/1.md", "/memory/2.md"}


def test_hot_session_is_spread(spark):
    """A session with most turns: no task orders or renders all of it."""
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("question number "), F.col("id")).alias("text"),
    )
    files = export_sessions(rows, _when(), turns_per_file=100)
    assert files.count() == 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small here
    try:
        tasks = files.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8
    last = files.where("path = '/memory/1.part299.md'").first().content
    assert "question number 29999" in last and "question number 29899" not in last
