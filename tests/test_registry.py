"""The registry of runs, studies and selections on small inputs."""

import sqlite3
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.operators import governance as G
from quillstream.operators import selection as L
from quillstream.operators import studies as S
from quillstream.operators.registry import Refused, Registry, fingerprint
from quillstream.sources import sinks as K


def test_fingerprints_see_through_forms():
    at = datetime(2024, 1, 1, 9, tzinfo=timezone(timedelta(hours=9)))
    assert fingerprint({"a": "é", "b": 1.0, "c": {"y", "x"}, "t": at}) == fingerprint({"t": datetime(2024, 1, 1, tzinfo=UTC), "c": {"x", "y"}, "b": 1, "a": "é"})
    assert fingerprint({"a": [1, 2]}) != fingerprint({"a": [2, 1]})
    for bad in ({"a": float("nan")}, {"t": datetime(2024, 1, 1)}, {"k": "Bearer abc"}):
        with pytest.raises(Refused):
            fingerprint(bad)


def test_runs_are_registered_once_retried_in_line_and_kept(spark, tmp_path):
    r = Registry(str(tmp_path / "runs.sqlite"))
    one = r.begin({"q": 1})
    for again in (None, "why"):
        with pytest.raises(Refused):
            r.begin({"q": 1}, again)  # it still runs
    with pytest.raises(Refused):
        r.begin({"q": 2}, "nothing there")
    with pytest.raises(Refused):
        r.finish(one, "completed", {"x": "no digest"})
    r.finish(one, "failed")
    with pytest.raises(Refused):
        r.finish(one, "completed")
    two = r.begin({"q": 1.0}, "try again")
    assert r.check({"q": 1}) == "running" and r.check({"q": 9}) is None
    with sqlite3.connect(r.path) as db, pytest.raises(sqlite3.Error):
        db.execute("delete from events")
    assert {(x["run_id"], x["retry_of"], x["status"]) for x in r.runs(spark).collect()} == {(one, None, "failed"), (two, one, "running")}
    assert r.log(spark).groupBy("kind").count().where("kind = 'begun'").first()["count"] == 2


def test_tops_budgets_ranks_and_sets(spark):
    df = spark.createDataFrame([("g", i, i % 7) for i in range(500)] + [("h", 1, 1), (None, 2, 2)], "g string, i int, size int")
    top = L.top_per_group(df, ["g"], [F.desc("i")], 3, F.col("i")).collect()
    assert [(r["i"], r["place"]) for r in sorted(top, key=lambda r: r["place"]) if r["g"] == "g"] == [(499, 1), (498, 2), (497, 3)] and len(top) == 5
    used = {r["i"]: r["used"] for r in L.within_budget(df.where("g = 'g'"), "g", "i", F.col("size"), 20).collect()}
    want, total = {}, 0
    for i in range(500):
        total += max(1, i % 7)
        if total > 20:
            break
        want[i] = total
    assert used == want
    ranked = L.ranked(df.where("g = 'g'").repartition(5), [F.desc("size"), F.asc("i")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 501)) and [(r["size"], r["i"]) for r in ranked] == sorted(((r["size"], r["i"]) for r in ranked), key=lambda x: (-x[0], x[1]))
    a, b = (spark.createDataFrame(rows, "k string, v string") for rows in ([("x", "1"), ("x", "2"), ("y", "1"), ("z", None)], [("x", "2"), ("x", "1"), ("x", "1"), ("y", "2"), ("w", "1")]))
    assert {tuple(r) for r in L.same_sets(a, b, "k", "v").collect()} == {("x", "equal"), ("y", "differs"), ("z", "left_only"), ("w", "right_only")}
    assert spark.range(3).select(L.even_positions(F.col("id"), 5)).collect()[2][0] == [0, 1]


def test_steps_materials_and_reuse(spark):
    ev = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "b"), ("v", 1, "b")], "k string, t int, kind string")
    assert {tuple(r) for r in S.step_breaks(ev, "k", ["t"], "kind", {"": ["a"], "a": ["b"], "b": []}).collect()} == {("u", "b", "b", 1), ("v", "b", "", 1)}
    x, y = (spark.createDataFrame(rows, "id int, t string") for rows in ([(1, "a"), (2, "b"), (2, "b"), (3, None)], [(1, "a"), (2, "b"), (4, "d"), (3, None)]))
    assert {tuple(r) for r in S.material_differences(x, y, "id").collect()} == {(2, "changed"), (4, "unexpected")}
    runs = spark.createDataFrame([("r1", 1, "failed", "p"), ("r2", 2, "completed", "p"), ("r3", 3, "completed", "p"), ("r4", 1, "completed", "q")], "run string, at int, status string, x string")
    assert {tuple(r) for r in S.reusable(runs, ["x"]).collect()} == {("r3", "r2")}


def test_prior_splits_stay_and_manifests_tell(spark):
    from quillstream.operators.temporal import partition_groups

    nodes = spark.createDataFrame([("a", None), ("b", "dev"), ("c", None), ("d", "test")], "node string, wanted string")
    edges, prior = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string"), spark.createDataFrame([("a", "dev"), ("c", "train")], "node string, split string")
    got = {r["node"]: (r["split"], r["conflict"]) for r in partition_groups(nodes, edges, [("train", 1.0)], "s", prior).collect()}
    assert got == {"a": ("dev", False), "b": ("dev", False), "c": (None, True), "d": (None, True)}
    items, listed = (spark.createDataFrame(rows, "p string, h string") for rows in ([("1", "a"), ("2", "b"), ("3", "c")], [("1", "a"), ("2", "x"), ("4", "d"), ("5", "e"), ("5", "f")]))
    assert {tuple(r) for r in G.against_manifest(items, listed, ("p", "h")).collect()} == {("1", "verified"), ("2", "digest_differs"), ("3", "not_listed"), ("4", "not_there"), ("5", "not_there")}
    with pytest.raises(ValueError, match="gold"):
        G.raw_admitted(items.withColumn("gold", F.lit(1)), "2024-01-01T00:00:00Z")


def test_content_store_writes_each_content_once(spark, tmp_path):
    files = spark.createDataFrame([("/x/a.TXT", bytearray(b"one")), ("/x/b.txt", bytearray(b"one")), ("/x/c", bytearray(b"two"))], "path string, content binary")
    target = str(tmp_path / "store")
    rows = K.content_store(files, target).collect()
    assert len({r["copy"] for r in rows}) == 2 == len(list((tmp_path / "store").iterdir())) and len(rows) == 3
    next((tmp_path / "store").iterdir()).write_bytes(b"spoiled")
    with pytest.raises(Exception, match="differs from its name"):
        K.content_store(files, target).collect()
    assert K.markdown_table(spark.createDataFrame([("a|<b>\n", None)], "x string, y string"), ["x", "y"], 5).splitlines()[2] == "| a\\|&lt;b&gt;  |  |"
