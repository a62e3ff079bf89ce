"""The picture store: what is valid, and that an older writer which comes late leaves nothing."""

import os

from stillmark.operators import snapshots
from stillmark.sources import pictures

FRAME = "video_id long, time_ms long, rgb binary, width int, height int"


def frames(spark, rows):
    return spark.createDataFrame([(v, t, bytearray([v, t, 0]), 1, 1) for v, t in rows], FRAME)


def jpeg(data, width, height):
    return b"J" + bytes(data)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".jpg"))


def ids(spark, *videos):
    return spark.createDataFrame([(v,) for v in videos], "video_id long")


def test_an_older_writer_that_comes_late_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    store = pictures.new_store(spark, root)
    old, store = pictures.begin(ids(spark, 1, 2), store)
    pictures.commit(pictures.write(frames(spark, [(1, 10), (2, 10), (3, 10)]), old, root, jpeg), root).collect()
    assert files(root) == ["1/1/10.jpg", "2/1/10.jpg"]  # nobody may write video 3
    new, store = pictures.begin(ids(spark, 1), store)
    late = pictures.write(frames(spark, [(1, 20), (2, 20)]), old, root, jpeg)  # it doesn't know yet
    first = pictures.commit(pictures.write(frames(spark, [(1, 30)]), new, root, jpeg), root)
    assert [tuple(r) for r in first.collect()] == [(1, 2, 30, 4)]
    assert [tuple(r)[:3] for r in pictures.commit(late, root).collect()] == [(2, 1, 20)]
    assert files(root) == ["1/2/30.jpg", "2/1/10.jpg", "2/1/20.jpg"]
    assert open(f"{root}/1/2/30.jpg", "rb").read() == bytes([ord("J"), 1, 30, 0])
    again = pictures.write(frames(spark, [(1, 40)]), old, root, jpeg)  # it still doesn't
    assert files(root)[0] == "1/1/40.jpg" and pictures.commit(again, root).isEmpty()
    assert files(root) == ["1/2/30.jpg", "2/1/10.jpg", "2/1/20.jpg"]


def test_batches_of_one_writer_and_removed_videos(spark, tmp_path):
    root = str(tmp_path)
    store = pictures.new_store(spark, root)
    tokens, store = pictures.begin(ids(spark, 7), store)
    for batch in ([(7, 1), (7, 2)], [(7, 2), (7, 3)]):
        assert pictures.commit(pictures.write(frames(spark, batch), tokens, root, jpeg), root).count() == 2
    broken = spark.createDataFrame([(7, 9, bytearray(b"xx"), 1, 1)], FRAME)
    assert pictures.write(broken, tokens, root, jpeg).isEmpty()
    assert files(root) == ["7/1/1.jpg", "7/1/2.jpg", "7/1/3.jpg"]
    store = pictures.remove(ids(spark, 7), store, root)
    assert files(root) == []
    assert pictures.commit(pictures.write(frames(spark, [(7, 5)]), tokens, root, jpeg), root).isEmpty() and files(root) == []
    assert [tuple(r) for r in snapshots.read(spark, store).drop("bucket").collect()] == [(7, 2)]
    tokens, store = pictures.begin(ids(spark, 7), store)
    assert pictures.commit(pictures.write(frames(spark, [(7, 5)]), tokens, root, jpeg), root).count() == 1 and files(root) == ["7/3/5.jpg"]
