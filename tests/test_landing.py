"""Uploads that land as a stream, tables that are replaced as a whole, and staleness along a graph of stages."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import planned
from cadenza.sources import replace
from cadenza.sources.tables import Measures, kept
from cadenza.streaming import landing


def names(df):
    return sorted((r["path"].rpartition("/")[2], r["name"], r["reason"]) for r in df.collect())


def test_uploads_land_once(spark, tmp_path):
    folder, target, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    folder.mkdir()
    run = lambda **how: landing.land(landing.uploads(spark, str(folder)), str(folder), target, check, **how)
    for name, content in (("talk one.mp4", b"x"), ("TALK.MP4", b"xy"), ("notes.txt", b"x"), ("empty.mp4", b"")):
        (folder / name).write_bytes(content)
    assert landing.landed(spark, target).count() == 0

    def killed(number):
        raise RuntimeError("ended between writing and noting the batch")

    with pytest.raises(Exception, match="ended between"):
        run(after_write=killed).awaitTermination(120)
    assert landing.landed(spark, target).count() == 4  # written, but the stream doesn't know
    assert run().awaitTermination(120)
    first = [("TALK.MP4", "TALK", None), ("empty.mp4", None, "empty"), ("notes.txt", None, "not an MP4 file"), ("talk one.mp4", "talk_one", None)]
    assert names(landing.landed(spark, target)) == first
    (folder / "talk_one.mp4").write_bytes(b"z")
    (folder / "void.mp4").write_bytes(b"")
    assert run().awaitTermination(120)
    assert names(landing.landed(spark, target)) == sorted([*first, ("talk_one.mp4", "talk_one_2", None), ("void.mp4", None, "empty")], key=lambda x: x[0])
    assert run().awaitTermination(120) and landing.landed(spark, target).count() == 6  # nothing new
    assert {r["bytes"] for r in landing.landed(spark, target).filter("name = 'TALK'").collect()} == {2}


def rows(spark, path):
    return sorted(r["x"] for r in spark.read.parquet(path).collect())


def table(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def test_tables_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace.replace_table(table(spark, 1, 2), path)
    assert rows(spark, path) == [1, 2] and replace.recover(spark, path) == "in order"
    replace.replace_table(spark.read.parquet(path).withColumn("x", F.col("x") + 1), path)  # out of itself
    assert rows(spark, path) == [2, 3]
    with pytest.raises(ValueError, match="refused"):
        replace.replace_table(table(spark, 9), path, lambda new: new.count() > 1)
    assert rows(spark, path) == [2, 3] and not (tmp_path / "t.new").exists()
    with pytest.raises(Exception, match="broken row"):
        replace.replace_table(table(spark, 9).withColumn("x", F.raise_error(F.lit("broken row")).cast("int")), path)
    assert rows(spark, path) == [2, 3] and replace.recover(spark, path) in ("dropped", "in order")


@pytest.mark.parametrize("fails_at", [1, 2])
def test_broken_swaps_are_finished(spark, tmp_path, monkeypatch, fails_at):
    """The job ends before the first or the second rename of the swap; the new table was checked, so it wins."""
    path, renames = str(tmp_path / "t"), []
    replace.replace_table(table(spark, 1), path)
    real = replace._Folder.rename

    def rename(self, source, target):
        renames.append(source)
        if len(renames) == fails_at:
            raise OSError("ended")
        real(self, source, target)

    monkeypatch.setattr(replace._Folder, "rename", rename)
    with pytest.raises(OSError, match="ended"):
        replace.replace_table(table(spark, 2), path)
    monkeypatch.setattr(replace._Folder, "rename", real)
    assert (tmp_path / "t").exists() is (fails_at == 1)
    assert replace.recover(spark, path) == "new" and rows(spark, path) == [2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_unchecked_tables_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, 5).write.parquet(f"{path}.new")
    assert replace.recover(spark, path) == "none" and not (tmp_path / "t.new").exists()
    table(spark, 1).write.parquet(f"{path}.old")
    table(spark, 5).write.parquet(f"{path}.new")
    assert replace.recover(spark, path) == "old" and rows(spark, path) == [1]


def test_staleness_follows_the_graph(spark):
    graph = {"sound": ["wav"], "text": ["words"], "fusion": ["sound", "text"], "export": ["fusion"]}
    stamps = {
        "fresh": {"wav": 1, "words": 1, "sound": 2, "text": 1, "fusion": 3, "export": 3},
        "new_wav": {"wav": 5, "words": 1, "sound": 2, "text": 2, "fusion": 3, "export": 4},
        "no_fusion": {"wav": 1, "words": 1, "sound": 2, "text": 2, "export": 9},
        "no_words": {"wav": 1, "sound": 0, "fusion": 3},
        "late_text": {"wav": 1, "words": 1, "sound": 2, "text": 8, "fusion": 3, "export": 4},
    }
    df = spark.createDataFrame([(v, s, t) for v, of in stamps.items() for s, t in of.items()] + [("fresh", "fusion", 1), ("fresh", "other", 99)], "video_id string, stage string, at int")
    got = {}
    for r in planned.stale_stages(df, graph).collect():
        got.setdefault(r["video_id"], {})[r["stage"]] = r["reason"]
    assert got == {
        "new_wav": {"sound": "older", "fusion": "of stale", "export": "of stale"},
        "no_fusion": {"fusion": "missing", "export": "of stale"},
        "no_words": {"sound": "older"},
        "late_text": {"fusion": "older", "export": "of stale"},
    }
    assert planned.stale_stages(df.limit(0), graph).count() == 0
    with pytest.raises(ValueError, match="reads itself"):
        planned.stale_stages(df, {"a": ["b"], "b": ["a"]})


def test_stages_tell_their_rows_as_they_run(spark):
    measures = Measures()
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as video_id", "id * 0.5D as x")
    out = kept(df, "video_id", "x", stage="numbers", measures=measures, of=("x",))
    assert measures == {"numbers": {"rows": 1000, "least_x": 0.0, "greatest_x": 499.5}} and out.count() == 1000
    kept(df.limit(0), "video_id", stage="none", measures=measures, of=("x",))
    assert measures["none"] == {"rows": 0, "least_x": None, "greatest_x": None}
