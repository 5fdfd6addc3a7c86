import hashlib
import os
from datetime import datetime

import pytest

from lodestone.operators import incremental as inc
from lodestone.operators import references as ref

PARSED = "repo string, id string, revision int, is_deleted boolean, content_hash string, mtime double, raw_content string, extra string"
STATE = "repo string, id string, content_hash string, mtime double, run_id int, indexed_at timestamp, hash string"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"
T0 = datetime(2024, 1, 1)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([(1, T0, T0, "succeeded"), (2, T0, None, "failed"), (3, T0, T0, " Succeeded ")], RUNS)


def found(df):
    return sorted((r.repo, r.id, r.reason) for r in df.collect())


def test_new_and_changed(spark, runs):
    parsed = spark.createDataFrame(
        [
            ("r", "0001", 1, False, "aa", 1.0, "x", None), ("r", "0001", 2, False, "bb", 0.0, "y", None), ("r", "0001", 1, False, "aa", 9.0, "x", None),
            ("r", "0002", 1, False, None, None, "text", None), ("r", "0003", 1, False, "cc", 1.0, "z", None), ("r", "0003", 2, True, None, None, None, None),
            ("r", "0004", 1, False, "dd", 1.0, "w", None), ("r", "0005", 1, False, "ee", 1.0, "w", None), ("r", "0006", 1, None, "ee", 1.0, "w", None),
        ],
        PARSED,
    )
    state = spark.createDataFrame(
        [
            ("r", "0001", "aa", 1.0, 1, T0, "clash"), ("r", "0002", "SHA256:" + sha("text").upper(), None, 1, T0, None), ("r", "0002", "zz", None, 2, T0, None),
            ("r", "0004", "old", 1.0, 1, T0, None), ("r", "0004", "DD", 1.0, 3, T0, None), ("r", "0005", "ee", 1.0, 2, T0, None),
        ],
        STATE,
    )
    assert found(inc.pending_records(parsed, state, runs)) == [("r", "0001", "changed"), ("r", "0005", "new")]


def test_empty_tables(spark, runs):
    parsed, state = spark.createDataFrame([], PARSED), spark.createDataFrame([], STATE)
    assert inc.pending_records(parsed, state, runs).count() == 0
    one = spark.createDataFrame([("r", "1", 1, False, "a", 0.0, "t", None)], PARSED)
    assert found(inc.pending_records(one, state, runs)) == [("r", "1", "new")]
    assert inc.removed_records(parsed, spark.createDataFrame([("r", "1", "a", 0.0, 1, T0, None)], STATE), runs).count() == 1


def _expire(tmp_path, lease):
    os.utime(f"{tmp_path}/run=7/leases/{lease.bucket}-{lease.token}", (0, 0))


def _ledger(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"{i:04d}", "h") for i in range(40)], "repo string, id string, content_hash string")
    ledger = inc.WorkLedger(spark, f"file://{tmp_path}", "7", ttl_s=60)
    assert ledger.plan(rows, 10) == ledger.plan(rows.limit(1), 10) == len(ledger.buckets())
    return ledger


ALL = [f"{i:04d}" for i in range(40)]


def _finish(ledger):
    while leases := ledger.lease_some("b", 2):
        ledger.commit(leases, ledger.records(*leases))
    assert ledger.finished() and sorted(r.id for r in ledger.results().collect()) == ALL


def test_ledger_leases_and_fencing(spark, tmp_path):
    ledger = _ledger(spark, tmp_path)
    dead = ledger.lease("a")
    assert ledger.states()[dead.bucket] == "leased"
    _expire(tmp_path, dead)  # the lease runs out and the bucket is pending again
    assert ledger.states()[dead.bucket] == "pending"
    taken = {}
    while lease := ledger.lease("b"):
        taken[lease.bucket] = lease
    assert taken[dead.bucket].token == dead.token + 1
    with pytest.raises(inc.StaleToken):
        ledger.commit(dead, ledger.records(dead))
    for lease in taken.values():
        ledger.commit(lease, ledger.records(lease))
        ledger.commit(lease, ledger.records(lease))  # a retry by the same token changes nothing
    _finish(ledger)
    assert sorted(os.listdir(f"{tmp_path}/run=7")) == ["done", "leases", "output", "plan"]


@pytest.mark.parametrize("dies_at", ["lease", "output", "done"])
def test_a_writer_that_dies_after_any_file_operation(spark, tmp_path, monkeypatch, dies_at):
    ledger = _ledger(spark, tmp_path)
    lease = ledger.lease("a")
    if dies_at != "lease":
        real = ledger._create

        def create(name):
            if dies_at == "done":
                real(name)
            raise KeyboardInterrupt

        monkeypatch.setattr(ledger, "_create", create)
        with pytest.raises(KeyboardInterrupt):
            ledger.commit(lease, ledger.records(lease))
        monkeypatch.setattr(ledger, "_create", real)
    state = ledger.states()[lease.bucket]
    assert state == ("done" if dies_at == "done" else "leased")
    if dies_at != "done":
        _expire(tmp_path, lease)
        assert ledger.states()[lease.bucket] == "pending"
    _finish(ledger)


def test_a_late_writer_between_check_and_done_file(spark, tmp_path):
    ledger = _ledger(spark, tmp_path)
    slow = ledger.lease("a")
    _expire(tmp_path, slow)
    held = ledger.lease_some("b", 99)
    fast = next(x for x in held if x.bucket == slow.bucket)
    for x in held:
        if x is not fast:
            _expire(tmp_path, x)
    ledger.commit(fast, ledger.records(fast))
    ledger._create(f"done/{slow.bucket}-{slow.token}-ffff")  # it had passed its last check before it was overtaken
    assert ledger._done()[slow.bucket][0] == fast.token
    _finish(ledger)


def test_run_pending_goes_on_after_a_crash(spark, runs, tmp_path):
    parsed = spark.createDataFrame([("r", f"{i:04d}", 1, False, f"h{i}", 0.0, "t", None) for i in range(50)], PARSED)
    state = spark.createDataFrame([], STATE)
    calls = []

    def dies(rows):
        calls.append(1)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        inc.run_pending(parsed, state, runs, f"file://{tmp_path}", "r", dies)
    with pytest.raises(RuntimeError):
        inc.run_pending(parsed, state, runs, f"file://{tmp_path}", "r")  # the dead worker's lease still holds
    for f in os.listdir(f"{tmp_path}/run=r/leases"):
        os.utime(f"{tmp_path}/run=r/leases/{f}", (0, 0))
    out = inc.run_pending(parsed, state, runs, f"file://{tmp_path}", "r")
    assert sorted(r.id for r in out.collect()) == [f"{i:04d}" for i in range(50)] and "bucket" not in out.columns
    again = inc.run_pending(parsed, state, runs, f"file://{tmp_path}", "r")
    assert again.count() == 50


REFS = "repo string, id string, revision int, is_deleted boolean, ingested_at timestamp_ntz, metadata struct<depends_on: array<string>, superseded_by: array<string>, required_by: array<string>>, kind string"


def day(n):
    return datetime(2024, 1, n)


def test_orphans(spark):
    meta = lambda d=None, s=None, r=None: (d, s, r)
    parsed = spark.createDataFrame(
        [
            ("r", "0001", 1, False, day(2), meta(["ADR-0009", "9", "none", None, " 0002", "adr_0003.md", "0004", "00009"]), None),
            ("r", "0001", 1, False, day(5), meta(["ADR-0009", "9", "none", None, " 0002", "adr_0003.md", "0004", "00009"]), None),
            ("r", "0002", 1, False, day(1), meta(), None), ("r", "0003", 1, False, day(1), meta(), None), ("r", "0003", 2, True, day(2), None, None),
            ("r", "0004", 1, False, day(3), meta([], ["0001"], None), None), ("s", "0009", 1, False, day(1), meta(None, None, ["0001"]), None),
        ],
        REFS,
    )
    got = sorted((r.repo, r.id, r.field, r.target_id, r.kind) for r in ref.orphan_references(parsed).collect())
    assert got == [
        ("r", "0001", "depends_on", "0003", "deleted"), ("r", "0001", "depends_on", "0004", "late"), ("r", "0001", "depends_on", "0009", "missing"), ("s", "0009", "required_by", "0001", "missing"),
    ]
    report = {(r.field, r.period): (r.n_references, r.missing, r.deleted, r.late) for r in ref.orphan_report(parsed).collect()}
    assert report[("depends_on", "2024-01")] == (4, 1, 1, 1)
    assert ref.orphan_references(spark.createDataFrame([], REFS)).count() == 0


def test_hot_target(spark):
    """A key that nearly all references name goes by broadcast and loses none."""
    rows = [("r", f"{i:05d}", 1, False, day(1), (["77777"], None, None), None) for i in range(10000, 16000)]
    assert ref.orphan_references(spark.createDataFrame(rows, REFS)).count() == 6000
