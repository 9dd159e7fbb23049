from __future__ import annotations

import pytest

from stratakit.llm import common, linededup, mixing, quality, simhash, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [quality.op4_quality, mixing.op8_mixing, warc.op7_warc])
def test_salted_joins_equal_broadcast_ones(spark, monkeypatch, query):
    """Beyond the bound of a broadcast the other plan gives the same rows."""
    rows = lambda: sorted(map(str, query(spark, SF).drop("distance2").collect()))  # noqa: E731 - a sum of floats in another order
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_marked_rows(spark):
    """Numbers of several partitions, with what is written beside them; rows of other partitions are not there."""
    rows = common.numbered(spark.range(0, 50, 1, 5), {"id": "id"})
    folder = common.mark_rows(rows.filter("id % 3 = 0"))
    assert sorted(r.id for r in common.only_marked(rows, folder).collect()) == list(range(0, 50, 3))
    pairs = rows.filter("id IN (4, 40)").selectExpr("_row", "explode(array(1, 2)) AS k", "id").selectExpr("_row", "unhex(md5(concat(id, k))) AS p")
    beside = common.Marked(common.mark_rows(pairs, payload="p"), 16)
    number = {r.id: r._row for r in rows.collect()}
    assert len(beside.payloads(number[4])) == 2 == len(beside.payloads(number[40])) and not beside.payloads(number[5])


def test_tables_of_a_scope_go_and_kept_ones_stay(spark):
    with common.scope():
        with common.scope():
            gone, kept = common.written(spark.range(3), "gone"), common.written(spark.range(4), "kept", keep=True)
        assert kept.count() == 4
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found|No such"):
            gone.count()


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


@pytest.mark.parametrize("operator", ["op9", "near_duplicates", "mixing", "op8"])
def test_scans_that_are_split_otherwise_read_the_same_rows(spark, monkeypatch, tmp_path, operator):
    """Executors join or leave between two scans of the same 16 files: other splits, the same result."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    layouts = [("4", "128m", "4m"), ("3", "20k", "1k"), ("1", "128m", "1"), ("7", "60k", "2k")]

    def lay_out(k):
        for key, value in zip(keys, layouts[k % len(layouts)], strict=True):
            spark.conf.set(key, value)

    docs = lambda: common.documents(spark, str(tmp_path))
    run = {
        "op9": lambda: linededup.op9_line_dedup(spark, str(tmp_path)),
        "near_duplicates": lambda: simhash.stage(spark, docs(), ""),
        "mixing": lambda: mixing.stage(spark, docs(), ""),
        "op8": lambda: mixing.op8_mixing(spark, str(tmp_path)),
    }[operator]
    rows = lambda: sorted(map(str, run().collect()))
    try:
        lay_out(0)
        want, turn, write, mark = rows(), iter(range(1, 1000)), common.written, common.mark_rows
        monkeypatch.setattr(common, "written", lambda *a, **k: (write(*a, **k), lay_out(next(turn)))[0])
        monkeypatch.setattr(common, "mark_rows", lambda *a, **k: (mark(*a, **k), lay_out(next(turn)))[0])
        assert rows() == want
    finally:
        for key in keys:
            spark.conf.unset(key)
