"""Scans, sinks, alignment, streams and masks on temporary files and small arrays."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline.operators import masks, sets
from flockline.sources import tables
from flockline.streaming import judgments as stream


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_id,identity,path,date,orientation,species,split,dataset\n007,,a.jpg,2024-01-01,top,lynx,train,d\n8,x,b.jpg,,left,lynx,test,d\n")
    m = tables.metadata(spark, str(tmp_path / "m.csv"))
    assert [tuple(r) for r in m.orderBy("image_id").select("image_id", "identity").collect()] == [("007", ""), ("8", "x")]
    assert tables.labeled(m).count() == 1
    with pytest.raises(ValueError, match="missing columns: split"):
        tables.require(m.drop("split"), tables.METADATA)


def test_optional(spark, tmp_path):
    assert tables.optional(spark, str(tmp_path / "none.csv"), tables.METADATA_SCHEMA).columns == list(tables.METADATA)


def test_json(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"session_name": "s", "pair_judgments": [{"judgment_id": "1", "pair_key": "a|b", "label": " YES "}, {"judgment_id": "2", "pair_key": "a|c", "label": "maybe"}]}))
    j = tables.judgments(spark, str(tmp_path / "j.json"))
    assert [(r.pair_key, r.label) for r in j.collect()] == [("a|b", "yes")]
    (tmp_path / "o.json").write_text(json.dumps({"rule_name": "r", "operations": [{"operation_id": "x", "action": "split", "source_cluster_ids": [1, 2], "member_image_ids": ["a"]}]}))
    assert [(r.position, r.source_cluster_ids, r.member_image_ids) for r in tables.overlay(spark, str(tmp_path / "o.json")).collect()] == [(0, [1, 2], ["a"])]
    tables.write_json_document(j.select("pair_key", "label"), str(tmp_path / "out"), "s", "pair_judgments")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))["pair_judgments"] == [{"pair_key": "a|b", "label": "yes"}]


def test_alignment_and_submission(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    with pytest.raises(ValueError, match="lacks"):
        tables.aligned(a, a.where("id = 1"), ["id"])
    with pytest.raises(ValueError, match="repeats"):
        tables.aligned(a, a.union(a), ["id"])
    with pytest.raises(ValueError, match="no prediction"):
        tables.submission(a, a.where("id = 1"), "id", "v", "cluster")
    assert tables.markdown(a).splitlines()[0] == "| id | v |"


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 - 50).alias("k"))
    out = sets.positions(df, "k", "n", 5).orderBy("k").collect()
    assert [r.n for r in out] == list(range(1000))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 4, "click" if i % 3 else "view", float(i % 5)) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream.read(spark, str(tmp_path / "in"), e)
    stream.upserted(s, str(tmp_path / "t"), str(tmp_path / "c"), ["user_id", "event_type"], "ts", "event_id")
    key = lambda df: sorted(map(str, df.select("user_id", "event_type", "event_id", "value").collect()))
    assert key(stream.latest(spark, str(tmp_path / "t"))) == key(sets.last_wins(e, ["user_id", "event_type"], "ts", "event_id"))
    q = stream.windowed(stream.read(spark, str(tmp_path / "in"), e, 10), key="event_id").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    closed = spark.table("w")
    batch = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("rows"))
    assert closed.join(batch, ["window", "event_type", "rows"]).count() == closed.count()


def test_masks(spark):
    m = [[1, 1, 0, 0], [1, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]]
    df = spark.createDataFrame([(m,)], "m array<array<int>>")
    r = df.select(masks.sharpness("m").alias("s"), masks.largest_component("m").alias("b"), masks.column_profile("m", F.lit(2)).alias("p"), masks.thicker_end("m", F.lit(0.1)).alias("e"), masks.body_axis("m").alias("a")).first()
    a = np.array(m, float)
    assert r.s == pytest.approx(np.diff(a, axis=1).var() + np.diff(a, axis=0).var())
    assert r.b == [[1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert r.p == pytest.approx([0.6, 0.4]) and r.e == "missing" and 0 <= r.a.confidence <= 1


def test_homography(spark):
    a = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [5.0, 7.0], [3.0, 3.0]]
    b = [[-y + 3, x + 7] for x, y in a[:-1]] + [[99.0, 99.0]]
    r = spark.createDataFrame([(a, b)], "a array<array<double>>, b array<array<double>>").select(masks.homography("a", "b", F.lit(0.01)).alias("h")).first().h
    assert r.inliers == 5 and r.h == pytest.approx([0, -1, 3, 1, 0, 7, 0, 0, 1], abs=1e-6)
