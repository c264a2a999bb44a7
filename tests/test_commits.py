"""Snapshots against other writers, batches that are run again, numbered lines, patches of JSON lines, sessions with timers."""

import json
import random
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sluicework.operators import contracts, workflow
from sluicework.sources import commits, files
from sluicework.streaming import timed


def test_two_publishers(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []

    def write(k):
        try:
            commits.publish(spark.range(k, k + 5), path)
        except Exception as e:  # told below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert errors == [] and sorted(r.turn for r in commits.log(spark, path).collect()) == [1, 2, 3, 4]
    assert sorted(commits.current(spark, path, k).agg(F.min("id")).first()[0] for k in (1, 2, 3, 4)) == [0, 1, 2, 3]
    with pytest.raises(commits.Conflict):
        commits.publish(spark.range(9), path, base=3)
    assert commits.publish(spark.range(9), path, base=4) and commits.last(spark, path).turn == 5
    assert not list((tmp_path / "t" / "published").glob("_*"))


def test_no_change_is_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda k: lambda now: spark.range(k, k + 1) if now is None else now.union(spark.range(k, k + 1))
    threads = [threading.Thread(target=commits.update, args=(spark, path, one(k))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.id for r in commits.current(spark, path).collect()) == [0, 1, 2, 3]
    assert commits.update(spark, path, one(9), txn="a") == 5 and commits.update(spark, path, one(9), txn="a") is None
    assert commits.current(spark, path).count() == 5


def test_put_on_another_file_system(spark, tmp_path):
    folder = f"viewfs://nowhere{tmp_path}"
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.nowhere.link./tmp", "file:///tmp")
    if not str(tmp_path).startswith("/tmp/"):
        pytest.skip("no such mount")
    assert commits._put(spark, folder, "a.json", "{}") and not commits._put(spark, folder, "a.json", "[]")
    assert (tmp_path / "a.json").read_text() == "{}"


def test_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.publish(spark.createDataFrame([("a", "p/a", "1"), ("b", "p/b", "2")], "id string, path string, sha string"), path)
    change = lambda state, records: state.join(records.select("id", "new"), "id", "left").select("id", "path", F.coalesce("new", "sha").alias("sha"))
    records = lambda *rows: spark.createDataFrame(list(rows), "line int, id string, path string, sha string, new string")
    with pytest.raises(commits.Rejected) as told:
        commits.apply_all(spark, path, records((1, "a", "p/a", "1", "10"), (2, "b", "p/b", "stale", "20")), contracts.applied, change)
    assert [(r.line, r.error) for r in told.value.errors.collect()] and commits.last(spark, path).turn == 1
    assert commits.apply_all(spark, path, records((1, "a", "p/a", "1", "10")), contracts.applied, change) == 2
    assert sorted(map(tuple, commits.current(spark, path).collect())) == [("a", "p/a", "10"), ("b", "p/b", "2")]
    with pytest.raises(commits.Rejected):
        commits.apply_all(spark, path, records((1, "a", "p/a", "1", "11")), contracts.applied, change)  # made for the state before


def test_a_batch_that_is_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, read = str(tmp_path / "t"), lambda: spark.readStream.schema("k string, v long, at long").json(str(tmp_path / "in"))

    def run(checkpoint):
        q = commits.upsert_stream(read(), path, ["k"], "at", "ledger").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, commits.current(spark, path).collect()))

    (tmp_path / "in" / "1.json").write_text('{"k":"a","v":1,"at":1}\n{"k":"a","v":2,"at":3}\n{"k":"b","v":5,"at":1}\n')
    assert run("c") == [("a", 2, 3), ("b", 5, 1)]
    (tmp_path / "in" / "2.json").write_text('{"k":"a","v":9,"at":2}\n{"k":"b","v":6,"at":2}\n')
    assert run("c") == [("a", 2, 3), ("b", 6, 2)] and commits.last(spark, path).turn == 2
    assert run("lost") == [("a", 2, 3), ("b", 6, 2)] and commits.last(spark, path).turn == 2  # a checkpoint that was lost: batch 0 again


def test_numbered_lines(spark, tmp_path):
    rng = random.Random(4)
    for name in ("one.txt", "two.txt"):
        lines = ["" if rng.random() < 0.1 else "x" * rng.randint(1, 40) + "é\r"[: rng.randint(0, 2)] for _ in range(700)]
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "one.txt" else b""))
    (tmp_path / "empty.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        found = files.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5
        got = {}
        for r in found.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("one.txt", "two.txt"):
        text = (tmp_path / name).read_bytes().decode()
        want = [x.removesuffix("\r") for x in (text[:-1] if text.endswith("\n") else text).split("\n")]
        assert got[name] == dict(enumerate(want, 1))


def test_json_rows(spark, tmp_path):
    lines = ['{"id": 1, "n": "a"}', "", "   ", "not json", "[1]", '"s"', '{"id": "x"}', '{"n": "b", "more": 3}', '{"id": 4} trailing', "null"]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    schema = S.StructType([S.StructField("id", S.LongType()), S.StructField("n", S.StringType())])
    good, bad = files.json_rows(spark, str(tmp_path / "rows.jsonl"), schema)
    assert sorted((r.line, r.id, r.n) for r in good.collect()) == [(1, 1, "a"), (8, None, "b")]
    assert sorted((r.line, r.error) for r in bad.collect()) == [(4, "not JSON"), (5, "not an object"), (6, "not an object"), (7, "does not fit the schema"), (9, "not JSON"), (10, "not an object")]
    with pytest.raises(Exception, match=r"rows.jsonl: line \d+ is "):
        files.json_lines_strict(spark, str(tmp_path / "rows.jsonl"), schema).collect()
    (tmp_path / "good.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted((r.line, r.id) for r in files.json_lines_strict(spark, str(tmp_path / "good.jsonl"), schema).collect()) == [(1, 1), (3, 2)]


def test_patches(spark):
    lines = ['{"a": 1, "b" :[1, {"a": "},"}] ,"c":"x\\"y\\\\"}', "{}", '  { "z" : null }  ', '{"a":1,"a":2}', "[1]", "nothing", '{"a":1} x', None, '{"é\\n": {"b": 2}, "b":-1.5e3}', '{"b":"漢😀","q":true}', '{"\\u0062": 1}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r.s for r in df.select(workflow.value_spans(F.col("line")).alias("s")).collect()]
    for line, spans in zip(lines, got, strict=True):
        try:
            pairs = json.loads(line or "x", object_pairs_hook=lambda p: p)
        except ValueError:
            pairs = None
        whole = line is not None and line.strip().startswith("{") and pairs is not None and len({k for k, _ in pairs}) == len(pairs)
        assert (spans is not None) == whole
        for s in spans or []:
            assert json.loads(line[s.start : s.stop]) == json.loads(line)[s.key]
    done = [r.p for r in workflow.patched(df, "line", {"b": F.lit('{"n":1}'), "new": F.lit('"ü"'), "c": F.lit(None).cast("string")}, "p").collect()]
    assert done == ['{"a": 1, "b" :{"n":1} ,"c":"x\\"y\\\\", "new": "ü"}', '{"b": {"n":1}, "new": "ü"}', '  { "z" : null , "b": {"n":1}, "new": "ü"}  ', None, None, None, None, None, '{"é\\n": {"b": 2}, "b":{"n":1}, "new": "ü"}', '{"b":{"n":1},"q":true, "new": "ü"}', '{"\\u0062": {"n":1}, "new": "ü"}']


def _log():
    rng, rows = random.Random(7), []
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for s in range(60):
        at, kinds = start + timedelta(minutes=rng.randint(0, 900)), ["start"] * (s % 5 != 4) + rng.choices(["hint", "hint", "other", "start", "finish", "abandon"], weights=[5, 5, 2, 1, 0.5, 0.5], k=rng.randint(0, 12))
        for seq, kind in enumerate(kinds):
            rows.append((f"s{s}", seq, kind, at))
            at += timedelta(seconds=rng.choice([20, 200, 299, 300, 1000, 3600, 3601, 9000]))
    return [*rows, ("last", 0, "start", max(r[3] for r in rows) - timedelta(seconds=900))]


def _plain(rows, now):
    out = {}
    for session in {r[0] for r in rows}:
        state, hints, early, illegal, ended, last, hint = "none", 0, 0, 0, None, None, None
        for _, _, kind, at in sorted(r for r in rows if r[0] == session):
            t = int(at.timestamp())
            if state == "open" and t - last > timed.IDLE:
                state, ended = "abandoned", last + timed.IDLE
            if state == "none" and kind == "start":
                state = "open"
            elif state == "open" and kind == "hint":
                hints, early, hint = hints + 1, early + (hint is not None and t - hint < timed.COOLDOWN), t
            elif state == "open" and kind in ("finish", "abandon"):
                state, ended = {"finish": "finished"}.get(kind, "abandoned"), t
            else:
                illegal += 1
            last = t
        if state == "open" and last + timed.IDLE < now:
            state, ended = "abandoned", last + timed.IDLE
        out[session] = (state, hints, early, illegal, ended)
    return out


SCHEMA = "session string, seq long, event string, at timestamp"


def test_timed_sessions(spark):
    rows = _log()
    want = _plain(rows, int(max(r[3] for r in rows).timestamp()))
    df = spark.createDataFrame([*rows, (None, 1, "start", rows[0][3]), ("s1", None, "hint", rows[0][3])], SCHEMA)
    assert {r.session: (r.state, r.hints, r.early, r.illegal, r.ended) for r in timed.fold_timed(df).collect()} == want
    assert {w[0] for w in want.values()} == {"none", "open", "finished", "abandoned"} and any(w[2] for w in want.values())
    assert timed.fold_timed(df.limit(0)).collect() == []


def test_timed_stream_ends_as_the_batch(spark, tmp_path):
    rows = sorted(_log(), key=lambda r: r[3])
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 3 * 2], rows[len(rows) // 3 * 2 :]]
        (tmp_path / "in").mkdir()
        for k, part in enumerate(parts):
            (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"session": s, "seq": q, "event": e, "at": t.isoformat()}) + "\n" for s, q, e, t in part))
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
            folded = timed.fold_timed_stream(stream).withColumn("version", F.coalesce("ended", F.lit(0)) + F.col("hints") + F.col("illegal"))
            q = commits.upsert_stream(folded, str(tmp_path / "t"), ["session"], "version", "timed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = {r.session: (r.state, r.hints, r.early, r.illegal, r.ended) for r in commits.current(spark, str(tmp_path / "t")).collect()}
    assert got == _plain(rows, int(rows[-1][3].timestamp()))
