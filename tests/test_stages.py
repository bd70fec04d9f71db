"""Durable stages: found again by another session, partial ones ignored, changed inputs rebuilt, eviction."""

import os

from quillspark.sources.stages import DurableStages, pending_stages


def test_reuse_change_and_partial(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(10).write.parquet(source)
    builds = []

    def build():
        builds.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 as v")

    def get(session=spark, **params):
        return DurableStages(root).get(session, "double", build, [source], params)
    assert get(k=1).count() == 10 and len(builds) == 1
    # another store, as of another driver, finds it
    assert sorted(r.v for r in get(spark.newSession(), k=1).collect()) == list(range(0, 20, 2)) and len(builds) == 1
    get(k=2)
    assert len(builds) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert get(k=1).count() == 12 and len(builds) == 3
    # a folder without the marker is no stage
    store = DurableStages(root)
    path = store.path(spark, "double", [source], {"k": 3})
    os.makedirs(path)
    (tmp_path / "stages" / os.path.basename(path) / "part-0.parquet").write_bytes(b"half")
    assert get(k=3).count() == 12 and len(builds) == 4
    assert not os.listdir(f"{root}/_building")


def test_a_failed_build_leaves_no_stage(spark, tmp_path):
    store = DurableStages(str(tmp_path))
    try:
        store.get(spark, "bad", lambda: spark.sql("select raise_error('lost') as x"))
    except Exception:  # noqa: BLE001
        pass
    assert store.stages(spark) == []
    assert store.get(spark, "bad", lambda: spark.range(3)).count() == 3
    assert len(store.stages(spark)) == 1


def test_eviction_of_the_longest_unused(spark, tmp_path):
    store = DurableStages(str(tmp_path))
    for i in range(3):
        store.get(spark, f"s{i}", lambda: spark.range(1000))
    for i, name in enumerate(("s1", "s2", "s0")):
        os.utime(f"{store.path(spark, name)}/_SUCCESS", (1000 + i, 1000 + i))
    size = store.stages(spark)[0][1]
    gone = store.evict(spark, 2 * size)
    assert [os.path.basename(g).split("-")[0] for g in gone] == ["s1"] and len(store.stages(spark)) == 2
    os.makedirs(tmp_path / "_building" / "lost")
    assert len(store.evict(spark, 10 ** 12, builds_before=10 ** 14)) == 1
    wanted = spark.createDataFrame([("s0",), ("s1",), (None,)], "dataset string")
    assert sorted(r[0] or "" for r in pending_stages(spark, store, wanted, "dataset", lambda n: store.path(spark, n)).collect()) == ["", "s1"]
