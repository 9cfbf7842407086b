"""The append log: folding, compaction, and writers and compactors at the same time."""

import threading
from collections import defaultdict

import pytest

from quarry.sources.append_log import AppendLog

DDL = "key bigint, seq bigint, value double"


@pytest.fixture
def log(spark, tmp_path):
    return AppendLog(spark, f"file://{tmp_path}/log", buckets=4)


def _read(log, field):
    return {r["key"]: (r["value"], r["items"]) for r in log.read().where(f"field = '{field}'").collect()}


def test_sets_and_appends_fold_before_between_and_after_compactions(spark, log):
    assert log.read().collect() == []
    log.append(spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.2), (2, 1, None), (None, 1, 1.0)], DDL), "times")
    log.set(spark.createDataFrame([(1, 1, 10.0), (1, 3, 30.0), (1, 3, 20.0), (3, 1, 7.0)], DDL), "nodes")
    times, nodes = {1: (None, [0.2, 0.5]), 2: (None, [None])}, {1: (20.0, None), 3: (7.0, None)}
    assert _read(log, "times") == times and _read(log, "nodes") == nodes
    assert log.compact() and _read(log, "times") == times and _read(log, "nodes") == nodes
    log.append(spark.createDataFrame([(1, 3, 0.3), (4, 1, 4.0)], DDL), "times")
    log.set(spark.createDataFrame([(1, 2, 99.0), (3, 2, 8.0)], DDL), "nodes")
    times, nodes = {**times, 1: (None, [0.2, 0.3, 0.5]), 4: (None, [4.0])}, {**nodes, 3: (8.0, None)}
    assert _read(log, "times") == times and _read(log, "nodes") == nodes
    assert log.compact() and log.compact()
    log.clean()
    assert _read(log, "times") == times and _read(log, "nodes") == nodes
    assert log._list("appends") == [] and len(log._list("tables")) == 1


def test_two_writers_and_a_compactor_lose_nothing(spark, log):
    wrong = []

    def writer(n):
        try:
            for i in range(4):
                log.append(spark.createDataFrame([(k, n * 100 + i, float(n * 100 + i)) for k in range(5)], DDL), "times")
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    done = [log.compact() for _ in range(3)]
    for t in threads:
        t.join()
    assert not wrong and all(done)
    want = sorted(float(n * 100 + i) for n in (1, 2) for i in range(4))
    assert _read(log, "times") == {k: (None, want) for k in range(5)}
    assert log.compact() and _read(log, "times") == {k: (None, want) for k in range(5)}


def test_of_two_compactors_one_commits(spark, log):
    log.append(spark.createDataFrame([(1, 1, 1.0)], DDL), "times")
    n, manifest = log._manifest()
    assert log.compact()
    assert not log._commit(n + 1, {"table": "lost", "holds": []})
    assert _read(log, "times") == {1: (None, [1.0])}


def test_a_write_that_is_not_complete_is_not_read(spark, log, tmp_path):
    log.append(spark.createDataFrame([(1, 1, 1.0)], DDL), "times")
    log.append(spark.createDataFrame([(1, 2, 2.0)], DDL), "times")
    broken = sorted((tmp_path / "log/appends").iterdir())[0]
    (broken / "_SUCCESS").unlink()
    (got,) = _read(log, "times").values()
    assert len(got[1]) == 1
    (broken / "_SUCCESS").touch()
    assert log.compact() and defaultdict(list, {1: [1.0, 2.0]}) == {k: v[1] for k, v in _read(log, "times").items()}
