"""Image files to summaries in one call, and eyes that somebody else has located."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlens.operators import batch as B
from burstlens.operators import scoring as SC
from burstlens.operators.predict import score_folder, with_detections
from burstlens.schemas import DETECTION
from burstlens.sources import read_images

SIDE = 96


def pixels(seed=0, blur=False):
    noise = np.random.default_rng(seed).integers(80, 180, (SIDE, SIDE, 3)).astype(np.uint8)
    return np.full_like(noise, 120) if blur else noise


def bitmap(image) -> bytes:
    head = struct.pack("<2sIHHI", b"BM", 54 + image.nbytes, 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, SIDE, SIDE, 1, 24, 0, 0, 0, 0, 0, 0)
    return head + info + image[::-1].tobytes()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for i in range(4):
        (tmp_path / "sub" / f"{i}.bmp").write_bytes(bitmap(pixels(i)))
    (tmp_path / "broken.BMP").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("no image either")
    return tmp_path


def box(shift=0.0, confidence=0.9):
    points = [{"x": 30.0 + 8 * k + shift, "y": 40.0 + shift, "confidence": 0.8} for k in range(6)]
    corners = {"x1": 10.0, "y1": 10.0, "x2": 90.0, "y2": 90.0}
    return {**corners, "bbox_confidence": confidence, "keypoints": points}


def flat_detections(spark, root):
    rows = []
    for i in (0, 1, 3):
        for n, confidence in enumerate((0.5, 0.9, 0.9)):
            d = box(shift=float(i + n), confidence=confidence)
            points = [tuple(p.values()) for p in d["keypoints"]]
            rows.append((f"{root}/sub/{i}.bmp", n, 10.0, 10.0, 90.0, 90.0, confidence, points, SIDE, SIDE))
    rows.append((f"{root}/broken.BMP", 0, 10.0, 10.0, 90.0, 90.0, 0.9, points, SIDE, SIDE))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DETECTION.fields)
    return spark.createDataFrame(rows, f"path string, {fields}, image_width bigint, image_height bigint")


COLUMNS = ("path", "error", "notes", "eyes", *SC.SUMMARY_COLUMNS)


def test_folder_to_summaries(spark, folder):
    found = score_folder(spark, str(folder), flat_detections(spark, folder), crop_base="debug")
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert sorted(rows) == ["0.bmp", "1.bmp", "2.bmp", "3.bmp", "broken.BMP"]
    bad = rows["broken.BMP"]
    assert bad.error == "decode_error" and bad.eyes is None and bad.notes is None
    assert all(bad[n] is None for n in SC.SUMMARY_COLUMNS)
    assert rows["2.bmp"].notes == ["no_pose_detection"] and rows["2.bmp"].quality_grade == 0
    assert rows["0.bmp"].eye_visible_count == 2 and rows["0.bmp"].focus_score > 0
    assert rows["0.bmp"].scored[0].crop_path == "debug/0_left_eye.jpg"
    # Of equal boxes the earlier one counts: the second of three, shifted by one.
    assert rows["0.bmp"].eyes[0].center_x == 39.0


def test_nested_detections_need_no_join(spark, folder):
    flat = flat_detections(spark, folder)
    nested = flat.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct(*[f.name for f in DETECTION.fields]))).alias("detections")
    )
    images = read_images(spark, str(folder)).join(nested, "path", "left")
    a = SC.score_files(images).select(*COLUMNS).orderBy("path").collect()
    b = score_folder(spark, str(folder), flat).select(*COLUMNS).orderBy("path").collect()
    assert a == b and len(a) == 5


def test_orientations_of_files(spark, folder):
    flat = flat_detections(spark, folder)
    turns = [(f"{folder}/sub/0.bmp", 6), (f"{folder}/sub/1.bmp", 9), (f"{folder}/sub/2.bmp", None)]
    turned = spark.createDataFrame(turns, "path string, orientation int")
    plain = {r.path: r for r in score_folder(spark, str(folder), flat).collect()}
    found = {r.path: r for r in score_folder(spark, str(folder), flat, turned).collect()}
    assert found.keys() == plain.keys()
    assert found[f"{folder}/sub/0.bmp"].focus_score != plain[f"{folder}/sub/0.bmp"].focus_score
    for name in ("sub/1.bmp", "sub/2.bmp", "sub/3.bmp"):
        path = f"{folder}/{name}"
        assert [found[path][c] for c in SC.SUMMARY_COLUMNS] == [plain[path][c] for c in SC.SUMMARY_COLUMNS]


def test_pixels_meet_detections_in_one_join(spark, folder):
    plan = score_folder(spark, str(folder), flat_detections(spark, folder))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1 and text.count("image#") > 0


def test_model_is_not_shown_broken_files(spark, folder):
    boxes = [box(confidence=0.2), box(shift=2.0)]

    def make():
        def predict(batch):
            assert len(batch) <= 3 and (batch["width"] > 0).all()
            return [boxes] * len(batch)

        return predict

    shown = with_detections(read_images(spark, str(folder)).coalesce(1), make, batch_rows=3)
    sizes = {r.path.rsplit("/", 1)[1]: len(r.detections) for r in shown.collect()}
    assert sizes == {"0.bmp": 2, "1.bmp": 2, "2.bmp": 2, "3.bmp": 2, "broken.BMP": 0}
    scored = score_folder(spark, str(folder), make_predict_fn=lambda: lambda batch: [boxes] * len(batch))
    assert scored.filter("eye_visible_count = 2").count() == 4
    with pytest.raises(ValueError, match="either"):
        score_folder(spark, str(folder))


def photos(spark, count=1, blur=False):
    rows = [(i, SIDE, SIDE, 3, 1, bytearray(pixels(i, blur).tobytes())) for i in range(count)]
    kinds = "image_id bigint, width int, height int, n_channels int, orientation int, data binary"
    return spark.createDataFrame(rows, kinds)


def eyes(spark, *rows, head=60.0):
    kinds = (
        "image_id bigint, eye_side string, center_x double, center_y double, confidence double, "
        "visibility string, bbox_norm array<double>, head_width_px double"
    )
    return spark.createDataFrame([(*r, [0.1, 0.1, 0.2, 0.2], head) for r in rows], kinds)


def test_more_confident_eye_of_two(spark):
    given = eyes(spark, (0, "right", 60.0, 40.0, 0.92, "visible"), (0, "left", 30.0, 40.0, 0.92, "visible"))
    row = SC.score_located(photos(spark), given, crop_base="x").first()
    best = max(row.scored, key=lambda e: (e.focus_score, e.sharpness_score, -e.eye_idx))
    assert row.eye_visible_count == 2 and row.best_eye_side == best.eye_side
    assert [e.eye_side for e in row.scored] == ["left", "right"] and row.notes == []


@pytest.mark.parametrize("visibility", ["too_small", "hidden", "turned_away"])
def test_invisible_eyes_stay_in_the_document(spark, visibility):
    given = eyes(spark, (0, "left", 30.0, 40.0, 0.7, visibility))
    scored = SC.score_located(photos(spark, 2), given)
    rows = {r.image_id: r for r in scored.collect()}
    assert rows[0].eye_visible_count == 0 and rows[0].best_eye_side is None
    assert rows[0].failure_type == "none" and len(rows[0].scored) == 1
    assert rows[1].eye_visible_count == 0 and not rows[1].scored
    documents = SC.to_result(scored, "image_id").collect()
    assert sorted(len(d.result.detections) for d in documents) == [0, 1]


def test_low_confidence_rejects_nothing(spark):
    given = eyes(spark, (0, "left", 30.0, 40.0, 0.35, "partially_visible"))
    low = SC.score_located(photos(spark, blur=True), given).first()
    assert (low.failure_type, low.eye_visible_count) == ("none", 1) and low.quality_grade <= 2
    sure = given.withColumn("confidence", F.lit(0.9))
    assert SC.score_located(photos(spark, blur=True), sure).first().failure_type == "defocus"


def test_repeated_sides_and_extras(spark):
    rows = [
        (0, "left", 30.0, 40.0, 0.5, "visible"),
        (0, "left", 50.0, 40.0, 0.8, "visible"),
        (0, "left", 20.0, 40.0, 0.8, "visible"),
        (0, "third", 20.0, 40.0, 0.9, "visible"),
        (7, "left", 20.0, 40.0, 0.9, "visible"),
    ]
    extras = spark.createDataFrame(
        [(0, [[1.0, 2.0, 3.0]], ["by_hand"]), (1, None, ["none_found"])],
        "image_id bigint, pose_keypoints array<array<double>>, notes array<string>",
    )
    found = SC.score_located(photos(spark, 3), eyes(spark, *rows), extras).orderBy("image_id").collect()
    assert [r.image_id for r in found] == [0, 1, 2]
    assert [e.center_x for e in found[0].eyes] == [50.0]
    assert [r.notes for r in found] == [["by_hand"], ["none_found"], []]
    assert found[0].pose_keypoints == [[1.0, 2.0, 3.0]] and found[1].pose_keypoints == []


def test_batch_tells_three_failures_apart(spark):
    given = eyes(spark, (0, "left", 30.0, 40.0, 0.9, "visible"))
    scored = SC.score_located(photos(spark, 2), given).withColumns(
        {"path": F.concat(F.lit("p"), "image_id"), "decoded": F.col("image_id") == 0}
    )
    manifest = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "line_no bigint, path string")
    listing = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "path string")
    rows = B.batch_records(B.score_batch(manifest, listing, scored)).orderBy("line_no").collect()
    assert [r.error for r in rows] == [None, "decode_error", "not_scored", "file_not_found"]
    assert '"eye_visible_count":1' in rows[0].record
    assert rows[1].record == '{"path":"p1","error":"decode_error"}'
