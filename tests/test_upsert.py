import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import upsert as U

COLUMNS = "record_id long, source string, score double, namespace string"


def rows(spark, path):
    return sorted((tuple(r) for r in U.read_records(spark, path, COLUMNS).select("record_id", "source", "score", "namespace").collect()), key=repr)


def test_upserts_and_repeats(spark, tmp_path):
    path = f"{tmp_path}/sink"
    make = lambda data: spark.createDataFrame(data, COLUMNS)
    first = make([(1, "a", 1.0, "en"), (2, "a", 2.0, "en"), (1, "a", 3.0, "de"), (5, "n", None, None), (None, "x", 0.0, "en"), (2, "b", 2.0, "en")])
    assert U.upsert(first, path, 1, COLUMNS)
    assert rows(spark, path) == sorted([(1, "a", 1.0, "en"), (2, "b", 2.0, "en"), (1, "a", 3.0, "de"), (5, "n", None, None)], key=repr)
    second = make([(2, "c", 9.0, "en"), (7, "c", 7.0, "en"), (5, "m", 1.0, None)])
    assert U.upsert(second, path, 2, COLUMNS)
    want = sorted([(1, "a", 1.0, "en"), (2, "c", 9.0, "en"), (7, "c", 7.0, "en"), (1, "a", 3.0, "de"), (5, "m", 1.0, None)], key=repr)
    assert rows(spark, path) == want
    # again, and an older one: nothing changes
    assert not U.upsert(second, path, 2, COLUMNS) and not U.upsert(first, path, 1, COLUMNS)
    assert rows(spark, path) == want
    # only the namespaces that a batch touches are written again
    held = {(r.namespace, r.commit) for r in U._latest(spark, path)[2].collect()}
    assert U.upsert(make([]), path, 3, COLUMNS) and rows(spark, path) == want
    assert U.upsert(make([(1, "z", 0.0, "de")]), path, 4, COLUMNS)
    after = {(r.namespace, r.commit) for r in U._latest(spark, path)[2].collect()}
    assert {n for n, _ in held ^ after} == {"de"} and len(rows(spark, path)) == 5


def test_an_interrupted_batch_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/sink"
    U.upsert(spark.createDataFrame([(1, "a", 1.0, "en")], COLUMNS), path, 1, COLUMNS)
    batch = spark.createDataFrame([(1, "b", 2.0, "en"), (2, "b", 2.0, "fr")], COLUMNS)
    with monkeypatch.context() as m:
        m.setattr(type(batch), "coalesce", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))  # after the data, before the manifest
        with pytest.raises(RuntimeError):
            U.upsert(batch, path, 2, COLUMNS)
    assert rows(spark, path) == [(1, "a", 1.0, "en")]
    assert U.upsert(batch, path, 2, COLUMNS)
    assert rows(spark, path) == [(1, "b", 2.0, "en"), (2, "b", 2.0, "fr")]


def test_files_against_a_manifest(spark, tmp_path):
    root = tmp_path / "corpus (1)"
    (root / "sub").mkdir(parents=True)
    files = {"a.txt": b"alpha", "sub/b.bin": b"\x00\xff" * 1000, "sub/c.txt": b"", "d.txt": b"delta"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    listed = [(n, hashlib.sha256(d).hexdigest().upper()) for n, d in files.items() if n != "d.txt"] + [("gone.txt", "00")]
    (root / "sub/b.bin").write_bytes(b"altered")
    got = U.file_checks(spark, str(root), spark.createDataFrame(listed, "relative_path string, sha256 string")).collect()
    assert {r.relative_path: r.status for r in got} == {"a.txt": "match", "sub/b.bin": "hash_differs", "sub/c.txt": "empty_or_missing", "d.txt": "not_listed", "gone.txt": "missing"}
    assert all((r.actual == r.expected) == (r.status == "match") for r in got if r.actual and r.expected)
