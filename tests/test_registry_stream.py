"""The stored registry: files of any age, restarts, force, retention, compaction."""

from __future__ import annotations

import os
import shutil

import pytest

from ledgerleaf.streaming.intake import Registry, arriving

DAY = 86400


def put(folder, name, body, days_ago=0.0, now=1_700_000_000):
    path = folder / name
    path.write_bytes(body)
    os.utime(path, (now - days_ago * DAY,) * 2)


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    registry = Registry(spark, str(tmp_path / "registry"))
    run = lambda now=1_700_000_000.0, **how: registry.run_once(arriving(spark, str(tmp_path / "in")), str(tmp_path / "state"), now, **how)
    return registry, tmp_path, run


def told(registry):
    return sorted((os.path.basename(r.path), r.new, r.batch) for r in registry.seen().collect())


def test_old_files_that_arrive_late(store):
    """A file older than all before it is passed on, however old; a content is passed on once, also after a year."""
    registry, folder, run = store
    put(folder / "in", "a.pdf", b"1")
    run()
    put(folder / "in", "b.pdf", b"2", 30)
    put(folder / "in", "c.pdf", b"3", 60)
    run()
    put(folder / "in", "d.pdf", b"1", -365)
    put(folder / "in", "e.pdf", b"3", 400)
    run(1_700_000_000.0 + 365 * DAY)
    assert told(registry) == [("a.pdf", True, 0), ("b.pdf", True, 1), ("c.pdf", True, 1), ("d.pdf", False, 2), ("e.pdf", False, 2)]
    ids = {os.path.basename(r.path): r.file_id for r in registry.seen().collect()}
    assert ids["d.pdf"] == ids["a.pdf"] and ids["e.pdf"] == ids["c.pdf"] and len(set(ids.values())) == 3
    assert {(r.name, r.size, r.mime_type) for r in registry.entries().collect()} == {(n, 1, "application/pdf") for n in ("a.pdf", "b.pdf", "c.pdf")}


def test_restarted_batch_changes_nothing(spark, store):
    registry, folder, run = store
    put(folder / "in", "a.pdf", b"1")
    put(folder / "in", "b.pdf", b"1")
    run()
    before = sorted(map(tuple, registry.entries().collect())), told(registry)
    # the stream lost what it had committed, so it sends the batch again, under the same number
    shutil.rmtree(folder / "state/commits")
    run(1_800_000_000.0)
    assert (sorted(map(tuple, registry.entries().collect())), told(registry)) == before == (before[0], [("a.pdf", True, 0), ("b.pdf", False, 0)])
    # the batch was cut off before its log was complete
    shutil.rmtree(folder / "registry/log=0")
    assert registry.entries().count() == 0
    shutil.rmtree(folder / "state/commits")
    run()
    assert (sorted(map(tuple, registry.entries().collect())), told(registry)) == before


def test_force_retention_and_base(spark, store):
    registry, folder, _ = store
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    registry.absorb(files(("x/a.pdf", "1"), ("x/b.txt", None), ("x/b.pdf", "1")), 0, 0.0)
    registry.compact()
    old = {r.hash: r.file_id for r in registry.entries().collect()}
    registry.absorb(files(("x/c.pdf", "1")), 1, 1.0, force=True)
    assert len(old) == 1 and registry.entries().first().file_id not in old.values() and registry.entries().first().name == "c.pdf"
    assert registry.entries(1).first().file_id in old.values()
    registry.absorb(files(("x/d.pdf", "1")), 2, 5.0 * DAY, days=7)
    registry.compact()
    registry.absorb(files(("x/e.pdf", "1"), ("x/f.pdf", "2")), 3, 30.0 * DAY, days=7)
    assert told(registry) == [("a.pdf", True, 0), ("b.pdf", False, 0), ("c.pdf", True, 1), ("d.pdf", False, 2), ("e.pdf", True, 3), ("f.pdf", True, 3)]
    whole = sorted(map(tuple, registry.entries().collect()))
    registry.compact()
    assert sorted(map(tuple, registry.entries().collect())) == whole and len(whole) == 2
