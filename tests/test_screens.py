"""Frames to screen texts: images, recogniser, documents, failures by video."""

import json

import pytest
from pyspark.sql import functions as F

from sparkyard.plans import screens
from sparkyard.sources import readers


def put_video(folder, video, images, paths=None):
    frames = folder / f"screenshots_{video}"
    frames.mkdir()
    for name, content in images.items():
        (frames / name).write_bytes(content)
    named = paths or sorted(images)
    index = [{"seconds": 30 * i, "timestamp_str": f"00:00:{30 * i:02d}" if i < 2 else "00:01:00", "path": f"/elsewhere/{p}"} for i, p in enumerate(named)]
    (folder / f"screenshots_{video}.json").write_text(json.dumps(index))


def recogniser(log):
    def detect(content):
        with open(log, "a") as f:
            f.write(content.decode() + "\n")
        if content == b"broken":
            raise ValueError("no image")
        return None if content == b"blank" else [(content.decode(), 0.9), ("noise", 0.39), ("kept", 0.4)]

    return detect


def test_frames_to_documents(spark, tmp_path):
    log, folder = tmp_path / "log", tmp_path / "in"
    folder.mkdir()
    put_video(folder, "v", {"f1.jpg": b"LOTE 01", "f2.jpg": b"blank", "unasked.jpg": b"unasked"}, ["f1.jpg", "f2.jpg", "absent.jpg"])
    put_video(folder, "other", {"f1.jpg": b"not asked"})
    put_video(folder, "bad", {"f1.jpg": b"fine", "f2.jpg": b"broken"})
    put_video(folder, "none", {}, [])
    (folder / "screenshots_torn.json").write_text('[{"seconds": 0')
    (folder / "screenshots_none.json").write_text("[]")
    asked = ["v", "bad", "none", "torn", "unknown"]
    read = lambda **more: {r.video_id: r.error for r in screens.read_screens(spark, str(folder), recogniser(log), asked, **more).collect()}
    failed = read()
    assert failed == {"bad": "f2.jpg: no image", "torn": "screenshots: no such JSON"}
    assert json.loads((folder / "ocr_results_v.json").read_text()) == {"00:00:00": ["LOTE 01", "kept"], "00:00:30": [], "00:01:00": []}
    assert json.loads((folder / "ocr_results_none.json").read_text()) == {}
    assert sorted(p.name for p in folder.glob("ocr_results_*")) == ["ocr_results_none.json", "ocr_results_v.json"]
    assert sorted(log.read_text().split("\n")[:-1]) == ["LOTE 01", "blank", "broken", "fine"]
    # read back by the readers of the other stages
    assert readers.ocr(spark, f"{folder}/ocr_results_v.json").orderBy("ocr_idx").first().tokens == ["LOTE 01", "kept"]
    # again: only what failed is put to the recogniser
    log.write_text("")
    assert read() == failed and sorted(log.read_text().split()) == ["broken", "fine"]
    # a changed image, a document gone, other settings
    (folder / "screenshots_bad" / "f2.jpg").write_bytes(b"mended")
    (folder / "ocr_results_v.json").unlink()
    log.write_text("")
    assert read() == {"torn": "screenshots: no such JSON"} and sorted(log.read_text().split()) == ["fine", "mended"]
    assert json.loads((folder / "ocr_results_bad.json").read_text())["00:00:30"] == ["mended", "kept"] and (folder / "ocr_results_v.json").exists()
    log.write_text("")
    read(least=0.3)
    assert json.loads((folder / "ocr_results_v.json").read_text())["00:00:00"] == ["LOTE 01", "noise", "kept"]
    log.write_text("")
    read(least=0.3, resume=False)
    assert sorted(log.read_text().split("\n")[:-1]) == ["LOTE 01", "blank", "fine", "mended"]
    assert not list((folder / "_work").iterdir())


@pytest.mark.parametrize("sent", [screens.FRAMES_SENT, 0])
def test_frames_beyond_a_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(screens, "FRAMES_SENT", sent)
    frames = spark.createDataFrame([("v", 0, "00:00:00", "a/x.jpg"), ("v", 1, "00:00:30", "C:\\a\\x.jpg"), ("w", 0, "00:00:00", "x.jpg"), ("w", 1, "00:00:30", "y.jpg")], "video_id string, frame_idx int, ts string, path string")
    images = spark.createDataFrame([("v", "x.jpg", b"one"), ("w", "x.jpg", b"two"), ("w", "z.jpg", b"three")], "video_id string, file string, content binary")
    got = screens.texts_of_frames(frames, images, lambda b: [(b.decode(), 1.0)]).orderBy("video_id", "ocr_idx").collect()
    assert [tuple(r) for r in got] == [("v", 0, "00:00:00", ["one"], None), ("v", 1, "00:00:30", ["one"], None), ("w", 0, "00:00:00", ["two"], None), ("w", 1, "00:00:30", [], None)]
    empty = screens.texts_of_frames(frames.limit(0), images, lambda b: [])
    assert empty.count() == 0


def test_images_of_others_are_not_listed(spark, tmp_path):
    put_video(tmp_path, "a b", {})
    put_video(tmp_path, "v", {"f1.jpg": b"x"})
    put_video(tmp_path, "w", {"f1.jpg": b"yy"})
    hidden = "~" + "ü/1".encode().hex()
    put_video(tmp_path, hidden, {"f1.jpg": b"zzz"})
    got = lambda ids: {(r.video_id, r.file, r.length) for r in readers.frame_images(spark, str(tmp_path), ids).collect()}
    assert got(["v"]) == {("v", "f1.jpg", 1)} and got(["ü/1"]) == {("ü/1", "f1.jpg", 3)} and got(["nobody"]) == set()
    assert got(None) == {("v", "f1.jpg", 1), ("w", "f1.jpg", 2), ("ü/1", "f1.jpg", 3)}
    plan = readers.frame_images(spark, str(tmp_path), ["v"]).groupBy("video_id").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
