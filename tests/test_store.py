import io
import json
import random
import threading
import urllib.error
import urllib.request

import pytest

from palimpsest import ConflictError, Store, StoreConfig, TxnAborted, TxnCommitted
from palimpsest.functions.codec import int_key_bytes
from palimpsest.log import JsonLogger
from palimpsest.model import FormatError, NullKeyError
from palimpsest.sources import binary
from palimpsest.sources.manifest import Manifest, latest, publish
from palimpsest.model import ManifestConflict


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, StoreConfig(f"file://{tmp_path}/store", log_level="ERROR"))


def reopened(store):
    return Store(store.spark, store.config)


def crash(store):
    """What the end of a process does to its logs: their locks go."""
    for log in store.memory.logs:
        log.close()


def live(d):
    return {bytes(r["key"]): bytes(r["value"]) for r in d.collect()}


def test_upsert_of_one_version(store):
    store.set(b"1", b"foo", 0)
    store.set(b"1", b"bar", 0)
    assert store.get(b"1", 0) == b"bar"
    m = store.metrics()
    assert (m["memtable_keys"], m["num_runs"], m["total_versions"]) == (1, 0, 1)


def test_budget_rotates(spark, tmp_path):
    s = Store(spark, StoreConfig(f"file://{tmp_path}/s", memtable_bytes=1 << 20, log_level="ERROR"))
    s.set(b"1", b"foo", 0)
    s.set(b"1", b"bar", 0)
    s.set(b"2", b"a" * (1 << 20), 0)
    assert s.get(b"1", 0) == b"bar" and s.get(b"2", 0) == b"a" * (1 << 20)
    s.barrier()
    m = s.metrics()
    assert (m["num_runs"], m["memtable_keys"], m["frozen_memtables"]) == (1, 1, 0) and m["disk_bytes"] > 0
    assert s.get(b"1", 0) == b"bar" and s.get(b"2", 0) == b"a" * (1 << 20)


def test_delete_and_odd_values(store):
    store.set(b"1", b"foo", 0)
    store.delete(b"1", 0)
    assert store.get(b"1", 0) is None
    store.set(b"2", b"\x00", 1)
    store.set(b"3", b"", 1)
    assert (store.get(b"2", 1), store.get(b"3", 1)) == (b"\x00", b"")
    with pytest.raises(NullKeyError):
        store.set(None, b"x")


def test_ranges(store, spark):
    rows = [(bytearray(b"%03d" % i), bytearray(b"foo")) for i in range(100)]
    store.append(spark.createDataFrame(rows, "key binary, value binary"), ts=0)
    count = lambda a, b: store.range(a, b, 9).count()
    assert [count(b"010", b"020"), count(b"090", b"099"), count(b"200", b"300"), count(b"000", b"099"), count(b"050", b"040")] == [11, 10, 0, 100, 0]
    store.delete(b"001", 1)
    assert count(b"000", b"002") == 2
    store.set(b"002", b"bar", 1)
    assert live(store.range(b"002", b"002", 9)) == {b"002": b"bar"} and count(b"1", b"0") == 0
    assert store.range_versions(b"001", b"002").count() == 4
    asked = spark.createDataFrame([(bytearray(k),) for k in (b"001", b"002", b"003", b"003", b"x")], "key binary")
    assert live(store.get_many(asked)) == {b"002": b"bar", b"003": b"foo"} and store.get_many(asked).count() == 2
    assert live(store.get_many(asked, 0)) == {b"001": b"foo", b"002": b"foo", b"003": b"foo"}


def test_log_is_replayed_after_a_crash(store):
    store.set(b"a", b"1", 5)
    store.delete(b"b", 6)
    store.set(b"a", b"2", 5)
    assert len(reopened(store).memory) == 0  # a living writer's log stays its own
    crash(store)  # it is never closed
    again = reopened(store)
    assert again.get(b"a") == b"2" and again.get(b"b") is None and len(again.memory) == 2
    again.set(b"c", b"x" * 100_000, 7)
    crash(again)
    again = reopened(store)
    assert again.get(b"a") == b"2" and again.get(b"c") == b"x" * 100_000 and len(again.memory) == 3 and again.manifest.runs == ()
    again.close()
    assert store.files.names("wal") == []
    assert reopened(again).get(b"a") == b"2" and reopened(again).metrics()["memtable_keys"] == 0


def test_compaction_changes_no_read(store, spark):
    rng, model = random.Random(7), {}
    for step in range(40):
        key, ts = b"%d" % rng.randrange(8), step
        if rng.random() < 0.25:
            store.delete(key, ts)
            model[key, ts] = None
        else:
            store.set(key, b"v%d" % step, ts)
            model[key, ts] = b"v%d" % step
        if step % 6 == 5:
            store.flush()

    def at(t):
        out = {}
        for (k, ts), v in sorted(model.items(), key=lambda x: x[0][1]):
            if ts <= t:
                out[k] = v
        return {k: v for k, v in out.items() if v is not None}

    before = store.manifest
    for t in (7, 20, 39):
        assert live(store.snapshot(t)) == at(t)
    assert store.compact() >= 2
    assert len(store.manifest.runs) < len(before.runs) and max(r.level for r in store.manifest.runs) >= 1
    for t in (7, 20, 39):
        assert live(store.snapshot(t)) == at(t)
    store.flush()
    store.collect_garbage(30)
    for t in (30, 39):
        assert live(store.snapshot(t)) == at(t)
    gone = store.vacuum()
    assert gone and live(reopened(store).snapshot()) == at(99)


def test_three_runs_become_one(store, spark):
    for i, v in ((1, b"A"), (2, b"B"), (3, b"C")):
        store.set(int_key_bytes(i), v, 0)
        store.flush()
    assert store.compact() == 1
    (run,) = store.manifest.runs
    assert (run.level, run.n_keys) == (1, 3) and store.runs().count() == 1
    assert [store.get(int_key_bytes(i)) for i in (1, 2, 3)] == [b"A", b"B", b"C"]


def test_runs_are_pruned_by_key(store, spark):
    for k in (b"a", b"m", b"z"):
        store.set(k, b"1")
        store.flush()
    plan = store.versions(b"m", b"m")
    assert len(plan.inputFiles()) == 1
    text = store.range(b"m", b"m")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "key" in text.split("PushedFilters: [")[1].split("]")[0]


def test_publish_is_first_come(store):
    now = latest(store.files)
    publish(store.files, now.next())
    with pytest.raises(ManifestConflict):
        publish(store.files, now.next())
    assert Manifest.load(now.next().dump()) == now.next()


def test_transactions(store):
    t = store.begin()
    t.set(int_key_bytes(1), b"hello")
    t.set(int_key_bytes(2), b"world")
    assert store.get(int_key_bytes(1)) is None and t.get(int_key_bytes(1)) == b"hello"
    t.commit()
    assert store.get(int_key_bytes(2)) == b"world"
    t = store.begin()
    t.delete(int_key_bytes(1))
    assert t.get(int_key_bytes(1)) is None and live(t.snapshot()) == {int_key_bytes(2): b"world"} and t.range(int_key_bytes(0), int_key_bytes(9)).count() == 1
    t.commit()
    assert store.get(int_key_bytes(1)) is None
    for call in (lambda: t.get(b"x"), lambda: t.set(b"x", b""), lambda: t.delete(b"x"), t.commit, t.rollback):
        with pytest.raises(TxnCommitted):
            call()


def test_first_committer_wins(store):
    a, b = store.begin(), store.begin()
    a.set(b"1", b"bar")
    b.set(b"1", b"baz")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    assert store.get(b"1") == b"bar"
    with pytest.raises(TxnAborted):
        b.get(b"1")


def test_snapshot_reads(store):
    a = store.begin()
    a.set(b"1", b"bar")
    b = store.begin()
    a.commit()
    assert b.get(b"1") is None and b.commit() is None
    c = store.begin()
    c.set(b"2", b"x")
    c.rollback()
    assert store.get(b"2") is None
    with store.begin() as d:
        d.set(b"3", b"y")
    assert store.get(b"3") == b"y"


def test_two_writers_with_clocks_apart(store):
    """Who comes first is told by manifests, whatever the clocks say."""
    ahead = reopened(store)
    ahead.clock.observe(store.clock.now() + 10**15)
    a, b = ahead.begin(), store.begin()
    a.set(b"k", b"a")
    b.set(b"k", b"b")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    # what was committed by the clock ahead is seen by the next to begin
    c = store.begin()
    assert c.get(b"k") == b"a"
    # and the other way: the late clock's commit is a conflict for the one ahead
    d = ahead.begin()
    c.set(b"k", b"c")
    d.set(b"k", b"d")
    c.commit()
    with pytest.raises(ConflictError):
        d.commit()
    ahead.refresh()
    assert ahead.get(b"k") == store.get(b"k") == b"c"


def test_collection_leaves_open_transactions_alone(store, spark):
    with store.begin() as t:
        t.set(b"k", b"1")
        t.set(b"gone", b"1")
    old = store.begin()
    other = reopened(store).begin()
    assert old.get(b"k") == b"1"
    with store.begin() as t:
        t.set(b"k", b"2")
        t.delete(b"gone")
    store.collect_garbage(store.clock.now())
    store.vacuum(orphan_seconds=0)
    assert old.get(b"k") == b"1" and live(old.snapshot()) == {b"k": b"1", b"gone": b"1"}  # repeatable
    old.set(b"gone", b"2")
    with pytest.raises(ConflictError):  # the tombstone is there to be found
        old.commit()
    free = store.begin()
    free.set(b"new", b"1")
    free.commit()  # collection kept all since it began
    # a transaction of another process is not known to this one's collection: it aborts
    store.collect_garbage(store.clock.now())
    other.set(b"unrelated", b"1")
    with pytest.raises(ConflictError):
        other.commit()
    assert live(store.snapshot()) == {b"k": b"2", b"new": b"1"}


def test_transactions_and_the_memtable(store):
    store.set(b"a", b"1")
    t = store.begin()
    store.set(b"b", b"1")
    store.flush()
    assert t.get(b"a") == b"1" and t.get(b"b") is None
    t.set(b"a", b"2")  # the flush of what was there at the start is no conflict
    t.commit()
    u, v = store.begin(), store.begin()
    store.set(b"a", b"3")
    u.set(b"a", b"4")
    with pytest.raises(ConflictError):
        u.commit()
    store.flush()
    v.set(b"a", b"4")
    with pytest.raises(ConflictError):
        v.commit()
    w = store.begin()
    store.set(b"c", b"old", 5)
    x = store.begin()
    store.set(b"c", b"new", 5)
    assert w.get(b"c") is None and x.get(b"c") == b"old" and store.get(b"c") == b"new"


def test_commits_race(store):
    """Of transactions on one key that all began before a commit, one commits."""
    began = [reopened(store).begin() for _ in range(4)]
    for i, t in enumerate(began):
        t.set(b"k", b"%d" % i)
        t.set(b"own%d" % i, b"x")
    done = []

    def run(t):
        try:
            t.commit()
            done.append(t)
        except ConflictError:
            pass

    threads = [threading.Thread(target=run, args=(t,)) for t in began]
    [x.start() for x in threads]
    [x.join() for x in threads]
    store.refresh()
    assert len(done) == 1 and store.get(b"k") == done[0].writes[b"k"] and store.live_keys() == 2


def test_vacuum_spares_runs_in_the_making(store, spark):
    store.append(spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary"))
    store.files.make("runs/0_9_inthemaking")
    assert store.vacuum() == [] and store.vacuum(orphan_seconds=-1) == ["0_9_inthemaking"]


def test_closing_leaves_other_logs(store):
    other = reopened(store)
    store.set(b"a", b"1")
    other.set(b"b", b"1")
    store.close()
    assert len(store.files.names("wal")) == 1
    crash(other)
    assert reopened(store).get(b"b") == b"1"


def test_null_keys_in_batches_are_an_error(store, spark):
    with pytest.raises(Exception, match="null"):
        store.append(spark.createDataFrame([(None, bytearray(b"x"))], "key binary, value binary"))
    store.append(spark.createDataFrame([], "key binary, value binary"))
    assert store.manifest.runs == ()


ENTRIES = [(b"key1", 1, b"value1"), (b"key1", 2, b"value1.2"), (b"key1", 3, b"value1.3"), (b"key2", 1, b"value2"), (b"key2", 2, None), (b"key3", 1, b"value3"),
           (b"key3", 2, b"value3.2"), (b"key4", 1, b"value4"), (b"key5", 1, b"value5"), (b"key6", 1, b"value6"), (b"key6", 2, b"value6.2")]


def test_binary_run_layout():
    data = binary.dump_run(ENTRIES)
    f = binary.footer(data)
    size = sum(1 if v is None else len(v) for _, _, v in ENTRIES)
    assert f["n_keys"] == 11 and f["index_at"] == size + 22 and f["filter_at"] == f["index_at"] + 11 * 18 + 44
    assert list(binary.load_run(data)) == ENTRIES
    with pytest.raises(FormatError):
        list(binary.load_run(data[:10]))
    with pytest.raises(FormatError):
        binary.dump_run([(b"k", 1, b"x" * 70000)])


def test_binary_run_lookups(tmp_path):
    entries = [(b"k%04d" % i, t, None if t == 2 and i % 7 == 0 else b"v%d.%d" % (i, t)) for i in range(300) for t in (1, 2, 3)]
    (tmp_path / "r.sst").write_bytes(binary.dump_run(entries))
    by_key = {(k, t): v for k, t, v in entries}
    with binary.RunFile(f"file://{tmp_path}/r.sst") as f:
        assert f.ends() == (b"k0000", b"k0299") and f.about["n_keys"] == 900
        for i in (0, 7, 150, 299):
            for t in (0, 1, 2, 9):
                want = None if t == 0 else (b"k%04d" % i, min(t, 3), by_key[b"k%04d" % i, min(t, 3)])
                assert f.get(b"k%04d" % i, t) == want
        assert f.get(b"a", 9) is None and f.get(b"z", 9) is None and f.get(b"k00001", 9) is None
    (tmp_path / "bad.sst").write_bytes(b"short")
    with pytest.raises(FormatError):
        binary.RunFile(f"file://{tmp_path}/bad.sst")
    (tmp_path / "none.sst").write_bytes(binary.dump_run([]))
    with binary.RunFile(f"file://{tmp_path}/none.sst") as f:
        assert f.ends() is None and f.get(b"a", 1) is None


def test_binary_log():
    data = b"".join(binary.dump_log_entry(*e) for e in ENTRIES)
    assert list(binary.load_log(data)) == ENTRIES
    with pytest.raises(FormatError):
        list(binary.load_log(data[:-1]))
    assert list(binary.load_log(data[:-1], strict=False)) == ENTRIES[:-1]


def test_binary_sources(store, spark, tmp_path):
    binary.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0_0.sst").write_bytes(binary.dump_run(ENTRIES[:6]))
    (tmp_path / "in/0_1.sst").write_bytes(binary.dump_run(ENTRIES[5:]))
    (tmp_path / "in/x.sst.tmp").write_bytes(b"junk")
    rows = spark.read.format("kv_run").load(f"file://{tmp_path}/in")
    store.append(binary.as_versions(rows).drop("seq"))
    assert store.get(b"key1", 4) == b"value1.3" and store.get(b"key2", 2) is None and store.get(b"key6", 42) == b"value6.2" and store.get(b"key3", 0) is None
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.log").write_bytes(binary.dump_log_entry(b"1", 0, b"foo") + binary.dump_log_entry(b"1", 0, b"bar"))
    log = binary.as_versions(spark.read.format("kv_log").load(f"file://{tmp_path}/log"))
    assert [bytes(r["value"]) for r in log.collect()] == [b"bar"]
    (tmp_path / "out").mkdir()
    made = binary.export_runs(store.versions(), f"file://{tmp_path}/out", file_bytes=100, tasks=2).collect()
    assert sum(r["n_keys"] for r in made) == 11 and len(made) == len({r["name"] for r in made}) > 2
    back = binary.as_versions(spark.read.format("kv_run").load(f"file://{tmp_path}/out"))
    assert back.count() == 11 and back.filter("is_deleted").count() == 1


def test_http_service(store):
    from palimpsest.service import serve

    server = serve(store, port=0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(method, path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method, data=body)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    try:
        assert call("POST", "/set", b'{"key": "foo", "value": "bar"}')[0] == 200
        assert call("GET", "/get?key=foo") == (200, {"key": "foo", "value": "bar"})
        assert call("POST", "/set", b"{")[0] == 400 and call("GET", "/get")[0] == 400 and call("GET", "/get?key=no")[0] == 404
        assert call("DELETE", "/delete?key=foo")[0] == 200 and call("GET", "/get?key=foo")[0] == 404 and call("DELETE", "/delete")[0] == 400
        assert call("GET", "/metrics")[1]["num_runs"] == 2 and call("GET", "/x")[0] == 404
    finally:
        server.shutdown()
        server.server_close()


def test_json_log():
    out = io.StringIO()
    log = JsonLogger(level="INFO", stream=out)
    log.debug("no")
    log.info("yes", a=1)
    log.error("bad", b="x")
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [(x["level"], x["message"]) for x in lines] == [("INFO", "yes"), ("ERROR", "bad")] and lines[0]["a"] == 1


def test_stream_ingest(store, spark, tmp_path):
    from palimpsest.streaming.ingest import ingest, newest_values

    (tmp_path / "s").mkdir()
    schema = "key string, value string, commit_ts long"
    for i in range(3):
        (tmp_path / f"s/{i}.json").write_text(json.dumps({"key": "k", "value": f"v{i}", "commit_ts": 10 - i}))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/s")
    ingest(stream, store, "s", f"file://{tmp_path}/cp", availableNow=True).awaitTermination()
    assert len(store.manifest.runs) == 3 and store.get(b"k") == b"v0"  # the latest commit came first
    assert store.manifest.streams == {"s": 2}
    store.append(spark.createDataFrame([("k", "again")], "key string, value string"), stream=("s", 2))
    assert len(store.manifest.runs) == 3
    full = spark.readStream.schema(schema + ", seq long, is_deleted boolean").json(f"file://{tmp_path}/s")
    q = newest_values(full).writeStream.format("memory").queryName("newest_values").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["value"] for r in spark.table("newest_values").collect()] == ["v0"]
