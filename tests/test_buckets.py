import uuid

import pytest
from pyspark.sql import functions as F

from tmengine.operators import textindex
from tmengine.plans import index
from tmengine.sources import buckets

SPACE = uuid.UUID(int=5)
ROWS = "row_id long, source string, target string, status string"


def files(spark, root):
    fs, folder = buckets._path(spark, f"{root}/data")
    found, out = fs.listFiles(folder, True), set()
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".parquet"):
            out.add(name.split("/data/")[1])
    return out


def some(spark, a, z, status="Done"):
    return spark.createDataFrame([(i, f"word{i} common", f"t{i}", status) for i in range(a, z)], ROWS)


def test_a_small_load_writes_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "ix")
    index.load(spark, root, some(spark, 0, 200), SPACE, "c", n_buckets=16)
    before = files(spark, root)
    assert index.load(spark, root, some(spark, 7, 8, "CQA_Done"), SPACE, "c") == 2
    new = files(spark, root) - before
    assert len(before) == 32 and len(new) <= 3  # one bucket of points, those of two tokens
    assert index.points(spark, root).count() == 200
    assert {r.status for r in index.points(spark, root).where("source = 'word7 common'").collect()} == {"CQA_Done"}


def test_old_versions_go_and_the_one_before_stays_readable(spark, tmp_path):
    root = str(tmp_path / "ix")
    index.load(spark, root, some(spark, 0, 50), SPACE, n_buckets=4)
    seen = index.points(spark, root)
    for k in range(4):
        index.load(spark, root, some(spark, 50 + k, 51 + k), SPACE)
        if k == 0:
            assert seen.count() == 50
    assert len(buckets.versions(spark, root)) == index.KEEP
    named = {f for n in buckets.versions(spark, root) for held in buckets.load(spark, root, n).parts.values() for f in held.values()}
    assert {f.rsplit("/", 1)[0] for f in files(spark, root)} == named
    assert index.points(spark, root).count() == 54


@pytest.mark.parametrize("where", ["stage", "publish"])
def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch, where):
    root = str(tmp_path / "ix")
    index.load(spark, root, some(spark, 0, 20), SPACE, n_buckets=4, batch="m#0")
    real, calls = getattr(buckets, where), []

    def broken(*a):
        calls.append(real(*a) if where == "stage" else None)
        raise OSError("lost")

    monkeypatch.setattr(buckets, where, broken)
    with pytest.raises(OSError, match="lost"):
        index.load(spark, root, some(spark, 10, 30, "CQA_Done"), SPACE, batch="m#1")
    monkeypatch.undo()
    assert index.points(spark, root).count() == 20 and index.frequencies(spark, root)[1].first()["n"] == 20
    assert index.load(spark, root, some(spark, 10, 30, "CQA_Done"), SPACE, batch="m#1") == 2
    assert index.load(spark, root, some(spark, 10, 30, "CQA_Done"), SPACE, batch="m#1") is None
    rows = index.points(spark, root)
    assert rows.count() == 30 and rows.where("status = 'CQA_Done'").count() == 20
    held, n = index.frequencies(spark, root)
    want = textindex.frequencies(textindex.postings(rows, "pair_id", "source"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.collect())) and n.first()["n"] == 30


def test_a_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    mine, other = buckets.Manifest(), buckets.Manifest()
    assert buckets.publish(spark, root, mine) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        buckets.publish(spark, root, other)


def test_nothing_there_and_nothing_to_load(spark, tmp_path):
    root = str(tmp_path / "t")
    assert buckets.load(spark, root) is None and index.points(spark, root) is None and index.frequencies(spark, root) is None
    index.load(spark, root, some(spark, 0, 0), SPACE)
    assert index.points(spark, root).count() == 0
    assert buckets.read(spark, root, index.TOKENS, buckets.load(spark, root)).agg(F.count("*")).first()[0] == 0
