"""Sources, streams and retries."""

import pytest

from kgspark.sources.markdown import folders, read_all, safe_paths
from kgspark.streaming import windows


def test_markdown_tree(spark, tmp_path):
    for name, text in {"a.md": "A", "d/b c.md": "B é", ".hidden/x.md": "no", "d/.y.md": "no", "d/n.txt": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = read_all(spark, {"v": str(tmp_path)})
    assert {r["path"]: r["raw"] for r in rows.collect()} == {"a.md": "A", "d/b c.md": "B é"}
    assert {r["folder"] for r in folders(rows).collect()} == {"d"}
    bad = spark.createDataFrame([("../x",), ("/x",), ("a/../b",), ("ok/x.md",)], "path string")
    assert [r["path"] for r in safe_paths(bad).collect()] == ["ok/x.md"]


def test_late_and_old_changes(spark, tmp_path):
    rows = [(1, 5, "b"), (1, 3, "a"), (2, 1, "x")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 4, "late"), (2, 9, "new")], "user_id long, event_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = windows.read_stream(spark, f"{tmp_path}/in")
    stream = stream.sparkSession.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.drain_batches(windows.latest_changes(stream, "user_id"), "t", lambda b, i: got.extend(tuple(r) for r in b.collect()), "update")
    newest = {}
    for key, seq, kind in got:
        assert key not in newest or newest[key][0] < seq  # never backwards
        newest[key] = (seq, kind)
    assert newest == {1: (5, "b"), 2: (9, "new")}


def test_backoff():
    assert [windows.backoff(k) for k in range(1, 5)] == [2, 4, 8, None] and windows.backoff(9, most=9) == 30
    waits, fails = [], iter([ValueError, ValueError])

    def step():
        error = next(fails, None)
        if error:
            raise error("again")

    assert windows.with_retries(step, lambda e: True, waits.append) == 3 and waits == [2, 4]
    with pytest.raises(ZeroDivisionError):
        windows.with_retries(lambda: 1 / 0, lambda e: False, waits.append)


def _queued(spark, path, batches, late="0 seconds", **options):
    """Tries of ``queue.worked`` over batches of (key, seq, second, kind), one file and one batch each."""
    from kgspark.streaming import queue

    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "key long, seq long, s long, kind string").selectExpr("key", "seq", "timestamp_seconds(s) AS ts", "kind")
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in/b{k}")
    schema = "key long, seq long, ts timestamp, kind string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")

    def work(key, seq, kind, attempt):
        if kind == "broken":
            raise ValueError("no use")
        if kind.startswith("flaky") and attempt <= int(kind[5:]):
            raise ConnectionError("again")

    with queue.timed_state(spark):
        found = windows.drain(queue.worked(stream, work, "key", late=late, **options), "queue-test")
    return sorted((r["key"], r["seq"], r["attempt"], r["at_ms"] // 1000, r["outcome"]) for r in found.collect())


def test_queue_waits_retries_and_gives_up(spark, tmp_path):
    batches = [
        [(1, 1, 100, "put"), (2, 2, 100, "flaky2"), (3, 3, 100, "flaky9"), (4, 4, 100, "broken"), (5, 5, 100, "put"), (5, 6, 101, "put"), (6, 7, 100, "flaky9")],
        [(6, 8, 105, "put"), (7, 9, 105, "delete"), (1, 0, 104, "put")],  # 8 comes while 7 waits for its second retry; 0 is older than 1
        [(2, 10, 300, "put"), (3, 11, 400, "delete")],
        [(9, 12, 1000, "put")],
    ]
    got = _queued(spark, tmp_path, batches)
    assert [r for r in got if r[0] == 1] == [(1, 1, 1, 102, "done")]
    assert [r for r in got if r[0] == 2] == [(2, 2, 1, 102, "retry"), (2, 2, 2, 104, "retry"), (2, 2, 3, 108, "done"), (2, 10, 1, 302, "done")]
    assert [r for r in got if r[0] == 3] == [(3, 3, 1, 102, "retry"), (3, 3, 2, 104, "retry"), (3, 3, 3, 108, "retry"), (3, 3, 4, 116, "exhausted"), (3, 11, 0, 400, "deleted")]
    assert [r for r in got if r[0] == 4] == [(4, 4, 1, 102, "failed")]
    assert [r for r in got if r[0] == 5] == [(5, 6, 1, 103, "done")]  # the burst counts once
    assert [r for r in got if r[0] == 6] == [(6, 7, 1, 102, "retry"), (6, 7, 2, 104, "retry"), (6, 8, 1, 107, "done")]
    assert [r for r in got if r[0] in (7, 9)] == [(7, 9, 0, 105, "deleted")]  # 9 is not due at the last watermark


def test_queue_does_not_depend_on_batches(spark, tmp_path):
    """The same rows in one batch and in many give the same tries."""
    rows = [(k % 5, k, 100 + 7 * k, ["put", "flaky1", "flaky3", "delete", "flaky9", "broken"][k % 6]) for k in range(60)] + [(99, 999, 5000, "put")]
    whole = _queued(spark, tmp_path / "whole", [rows])
    assert whole == _queued(spark, tmp_path / "parts", [rows[i : i + 9] for i in range(0, len(rows), 9)]) and len(whole) > 60


def test_queue_in_processing_time(spark, tmp_path):
    """Timers of the clock keep a query running for good, so it is stopped once both keys have been worked on."""
    import time

    from kgspark.streaming import queue

    spark.createDataFrame([(1, 1, "delete"), (2, 1, "put")], "key long, seq long, kind string").selectExpr("*", "timestamp_seconds(9) AS ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, seq long, kind string, ts timestamp").parquet(f"{tmp_path}/in")
    found = []
    with queue.timed_state(spark):
        rows = queue.worked(stream, lambda *_: None, "key", late=None, forget_ms=60_000, retries=queue.Retries(quiet_ms=500))
        run = rows.writeStream.foreachBatch(lambda b, i: found.extend((r["key"], r["outcome"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    until = time.monotonic() + 60
    while len(found) < 2 and time.monotonic() < until:
        time.sleep(0.5)
    run.stop()
    assert sorted(found) == [(1, "deleted"), (2, "done")]
    with pytest.raises(ValueError):
        queue.worked(stream, print, "key", forget_ms=1)


def _files(root):
    return {p.relative_to(root).as_posix(): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_notes_are_written_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    from kgspark.sources.note_writer import HELD, WHOLE, finish_writes, write_notes

    root = tmp_path / "vault"
    root.mkdir()
    notes = spark.range(1000).selectExpr("concat('d', id % 7, '/é ', id, '.md') AS path", "concat('text ', id, '\\n🙂') AS raw").repartition(5)
    write_notes(notes, str(root))
    before = _files(root)
    assert len(before) == 1000 and before["d3/é 10.md"] == "text 10\n🙂"
    write_notes(notes.where("path like '%5.md'").withColumn("raw", F.upper("raw")), f"file://{root}")
    edited = _files(root)
    assert {p for p in before if edited[p] != before[p]} == {p for p in before if p.endswith("5.md")} and set(edited) == set(before)
    late = F.when(F.col("path").endswith("999.md"), F.raise_error(F.lit("stop"))).otherwise(F.lit("new"))
    bad = [notes.withColumn("raw", late), notes.withColumn("path", F.lit("same.md")), notes.withColumn("path", F.concat(F.lit("../"), "path")), notes.withColumn("raw", F.lit(None).cast("string"))]
    for rows in bad:
        with pytest.raises(Exception):  # noqa: B017
            write_notes(rows, str(root))
        assert _files(root) == edited  # nothing written, nothing left over
    # a driver that died: ahead of the mark nothing holds, behind it everything does
    for name, whole in (("a", False), ("b", True)):
        held = root / f"{HELD}{name}" / "t"
        held.mkdir(parents=True)
        (held / "0").write_text(f"late {name}")
        (held.parent / "t.json").write_text(f'[["t/0", "new/{name}.md"], ["t/1", "moved.md"]]')
        if whole:
            (held.parent / WHOLE).write_text('["t.json"]')
    assert finish_writes(str(root)) == {"finished": 1, "removed": 1}
    assert _files(root) == edited | {"new/b.md": "late b"}


def test_notes_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The rows of ``read_markdown``, from files that only tasks list: the query never asks the driver for them."""
    from kgspark.plans import flows
    from kgspark.sources import markdown

    for name, text in {"a.md": "a", "d/é +1.md": "b\n🙂", "d/e/_c.md": "", "d/x.txt": "-", ".h/z.md": "-", "d/.z.md": "-", "big.md": "x" * 99}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        listed = markdown.list_notes(spark, root)
        assert sorted(r["path"] for r in listed.collect()) == ["a.md", "big.md", "d/e/_c.md", "d/é +1.md"]
        got = {tuple(r) for r in markdown.read_notes(listed.where("path not like '%\\_c.md'"), root, "v", 50).collect()}
        assert got == {tuple(r) for r in markdown.read_markdown(spark, root, "v", 50).collect()} and len(got) == 2
    empty = tmp_path / "none"
    empty.mkdir()
    assert markdown.list_notes(spark, str(empty)).count() == 0
    assert not hasattr(flows, "read_markdown")
