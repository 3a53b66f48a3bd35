"""Sources, sinks, the stream and the plans."""

import json

import pytest
from pyspark.sql import functions as F

from burstlens import sinks as K
from burstlens import sources as R
from burstlens import streaming as ST
from burstlens.constants import SUMMARY_FIELD
from burstlens.operators import batch as B
from burstlens.operators import coverage as COV
from burstlens.operators import crops as CR
from burstlens.operators import dataset as DS
from burstlens.operators import detections as D
from burstlens.operators import scoring as SC
from burstlens.operators.localize import localize
from burstlens.plans import dataset_queries as DQ
from burstlens.plans import fixtures as X
from burstlens.plans import pixel_queries as PQ
from burstlens.plans import scoring_queries as SQ
from burstlens.session import shared_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_order_and_errors(spark, tmp_path):
    lines = ['{"path": "a"}', "", '{"image_path": "b", "x": 1}', "{}", '{"path": "", "image_path": "c"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = R.read_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()
    assert [r.path for r in rows] == ["a", "b", "c"]
    (tmp_path / "bad.jsonl").write_text('{"path": "a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_coco_document(spark, tmp_path):
    doc = {
        "info": {},
        "images": [{"id": 1, "file_name": "a/b.jpg", "width": 100, "height": 50}],
        "annotations": [{"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4], "keypoints": [1, 2, 2]}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=2))
    t = R.read_coco(spark, str(tmp_path / "doc.json"))
    listing = spark.createDataFrame([("a/b.jpg",)], "path string")
    manifest, labels = DS.prepare_from_coco(t["images"], t["annotations"], listing)
    assert manifest.first().dst == "images/val/a__b.jpg"
    row = labels.first()
    assert row.label == "labels/val/a__b.txt" and len(row.line.split()) == 23


def test_csv_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('bbox_json,note,image_path\n"[1,2,3,4]",n,x.jpg\n,m,y.jpg\n')
    rows = R.read_annotation_csv(spark, str(tmp_path / "a.csv")).orderBy("image_path").collect()
    assert rows[0].box == [1.0, 2.0, 3.0, 4.0] and rows[0].keypoints == []
    assert (rows[1].box, rows[1].width) == ([], 0)


def test_listing_ignores_other_files(spark, tmp_path):
    for name in ("a.JPG", "sub/b.png", "c.txt", "d.webp", "noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = R.list_images(spark, str(tmp_path)).select("path").collect()
    assert sorted(r.path for r in listed) == sorted(
        str(tmp_path / n) for n in ("a.JPG", "d.webp", "sub/b.png")
    )


def test_result_sinks(spark, sf_dir, tmp_path):
    scored = SQ._with_paths(spark, sf_dir)
    K.write_results(SC.to_result(scored), str(tmp_path / "json"))
    back = spark.read.text(str(tmp_path / "json")).select(SC.parse_result(F.col("value")).alias("r"))
    assert back.count() == 1500
    sums = back.agg(F.sum(F.col("r")[SUMMARY_FIELD]["eye_visible_count"])).first()[0]
    assert sums == scored.agg(F.sum("eye_visible_count")).first()[0]
    K.write_summary(scored, str(tmp_path / "summary"))
    K.write_per_eye(scored, str(tmp_path / "eyes"))
    assert spark.read.parquet(str(tmp_path / "summary")).columns[1:] == list(SC.SUMMARY_COLUMNS)
    eyes = spark.read.parquet(str(tmp_path / "eyes"))
    assert eyes.count() == scored.agg(F.sum(F.size("scored"))).first()[0]


def test_batch_sink_keeps_order(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"path": p}) for p in "zayb"))
    manifest = R.read_manifest(spark, str(tmp_path / "m.jsonl"))
    listing = spark.createDataFrame([("a",), ("b",), ("z",)], "path string")
    images = spark.createDataFrame([("a", True), ("b", False), ("z", True)], "path string, decoded boolean")
    empty = F.lit(None).cast("array<array<double>>")
    scored = SC.empty_result(images).withColumn("pose_keypoints", empty)
    K.write_batch(B.score_batch(manifest, listing, scored), str(tmp_path / "out"))
    texts = []
    for part in sorted((tmp_path / "out").glob("part-*")):
        texts += part.read_text().splitlines()
    records = [json.loads(t) for t in texts]
    assert [r["path"] for r in records] == list("zayb")
    assert [r.get("error") for r in records] == [None, None, "file_not_found", "decode_error"]
    assert records[0][SUMMARY_FIELD]["best_eye_side"] is None
    assert records[0]["debug"]["notes"] == ["skipped"]


def test_dataset_sinks(spark, sf_dir, tmp_path):
    made = DS.convert_parts(X.annotation_tables(spark, sf_dir), X.annotation_files(spark, sf_dir))
    K.write_labels(made["labels"], str(tmp_path / "labels"))
    K.write_dataset_manifest(made["manifest"], str(tmp_path / "manifest"))
    K.write_coco_tables(made, str(tmp_path / "coco"))
    kept = made["stats"].first().kept
    lines = spark.read.text(str(tmp_path / "labels"))
    assert lines.count() == kept and {r.split for r in lines.select("split").distinct().collect()} == {"train", "val"}
    assert spark.read.json(str(tmp_path / "manifest")).count() == kept
    assert R.read_coco_tables(spark, str(tmp_path / "coco"))["annotations"].count() == kept


def test_coverage_sink(spark, tmp_path):
    schema = (
        "image_id bigint, load_error boolean, detected boolean, no_pose boolean, "
        "no_visible_eyes boolean, n_visible int, eyes array<struct<visibility: string, confidence: double>>"
    )
    rows = [
        (1, False, True, False, False, 1, [("visible", 0.9), ("turned_away", 0.1)]),
        (2, True, False, False, False, 0, None),
        (3, False, False, True, False, 0, None),
    ]
    flags = spark.createDataFrame(rows, schema)
    summary, hist = COV.coverage_summary(flags), COV.visibility_histogram(flags)
    K.write_coverage(summary, hist, str(tmp_path / "c"))
    out = spark.read.json(str(tmp_path / "c")).first().asDict(recursive=True)
    assert out["detection_rate_pct"] == round(100 / 3, 2) and out["mean_eye_confidence"] == 0.5
    assert out["visibility_histogram"] == {"visible": 1, "turned_away": 1, "load_error": 1}
    none = COV.coverage_summary(flags.filter("image_id < 0")).first()
    assert (none.total_images, none.detection_rate_pct) == (0, 0.0)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    flat = X.detections(spark, sf_dir).withColumn("det_idx", F.col("p"))
    fields = [f.name for f in ST.DETECTION.fields]
    nested = flat.groupBy("image_id", "image_width", "image_height").agg(
        F.collect_list(F.struct(*fields)).alias("detections")
    )
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for side in (0, 1):
        nested.filter(F.col("image_id") % 2 == side).write.mode("append").parquet(source)
        ST.run_available(ST.eyes_of_stream(ST.read_detection_stream(spark, source)), out, state)
    streamed = spark.read.parquet(out)
    batch = ST.eyes_of_stream(nested).select(streamed.columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_best_detection_limits_before_the_shuffle(spark, sf_dir):
    best = D.best_detection(X.detections(spark, sf_dir), tie_break=X.DETECTION_ORDER)
    text = plan(best)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_localisation_adds_no_shuffle(spark, sf_dir):
    best = D.best_detection(D.gate_detections(X.detections(spark, sf_dir)), tie_break=X.DETECTION_ORDER)
    assert plan(localize(best)).count("Exchange") == plan(best).count("Exchange") == 1


def test_pixels_do_not_shuffle(spark, sf_dir):
    windows = PQ._located(spark, sf_dir).select("image_id", "windows")
    joined = CR.join_located(X.photos(spark, sf_dir), windows, broadcast=True)
    text = plan(CR.crop_moments(CR.cut_windows(joined)))
    assert "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning") == plan(windows).count("Exchange hashpartitioning")


def test_shuffle_join_gives_the_same_crops(spark, sf_dir):
    windows = PQ._located(spark, sf_dir).select("image_id", "windows")
    few = CR.join_located(X.photos(spark, sf_dir), windows, broadcast=True)
    a = CR.crop_moments(CR.cut_windows(few))
    merged = CR.join_located(X.photos(spark, sf_dir), windows)
    b = CR.crop_moments(CR.cut_windows(merged))
    assert "ShuffledHashJoin" in plan(b) and "SortMergeJoin" not in plan(b)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_bucketed_images_stay_in_place(spark, sf_dir, tmp_path):
    spark.sql("DROP TABLE IF EXISTS burst_photos")
    K.write_bucketed_images(X.photos(spark, sf_dir), "burst_photos", 8, str(tmp_path / "photos"))
    windows = PQ._located(spark, sf_dir).select("image_id", "windows")
    joined = CR.join_located(spark.table("burst_photos"), windows)
    scan = plan(joined).split("burst_photos")[0]
    assert "ShuffledHashJoin" in scan and scan.rfind("Exchange hashpartitioning") < scan.rfind("ShuffledHashJoin")
    spark.sql("DROP TABLE burst_photos")


def test_crop_sink(spark, sf_dir, tmp_path):
    crops = CR.extract_crops(PQ._cuts(spark, sf_dir))
    K.write_crops(crops, str(tmp_path / "crops"))
    back = spark.read.parquet(str(tmp_path / "crops"))
    assert back.count() == crops.count()
    assert back.filter("crop_width_px > 0 AND length(gray) <> crop_width_px * crop_height_px").count() == 0


def test_gate_reaches_the_scan(spark, tmp_path, sf_dir):
    path = str(tmp_path / "d")
    X.detections(spark, sf_dir).select(*[f.name for f in R.detections.DETECTIONS.fields]).write.parquet(path)
    text = plan(D.gate_detections(R.read_detections(spark, path)).select("image_id", "det_idx"))
    assert "GreaterThanOrEqual(bbox_confidence,0.25)" in text
    assert "keypoints" not in text


def test_annotations_are_not_collected(spark, sf_dir):
    text = plan(DS.join_annotations(DQ._coco_images(spark, sf_dir), DQ._annotations(spark, sf_dir)))
    assert "collect_list" not in text and "CartesianProduct" not in text


class _Unset:
    """A session without spark.checkpoint.dir, whose settings cannot be changed."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return default

    def set(self, key, value):
        raise AssertionError("a running session refuses this")

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/own"


def test_shared_dir_without_setting():
    local = _Unset("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Unset("spark://host:7077"))


def test_painted_photos_and_images_reach_python_in_small_batches(spark, sf_dir, tmp_path):
    parts = spark.range(2000).selectExpr("id AS p_partkey", "CAST(5 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    from burstlens.session import tune

    tune(spark)
    painted = X.photos(spark, str(tmp_path)).coalesce(1)

    def sizes(batches):
        for pdf in batches:
            yield pdf[["image_id"]].head(1).assign(image_id=sum(map(len, pdf["data"])))

    largest = painted.mapInPandas(sizes, "image_id bigint").agg(F.max("image_id")).first()[0]
    total = painted.agg(F.sum(F.length("data"))).first()[0]
    assert total > 12_000_000 and largest < 9_000_000
