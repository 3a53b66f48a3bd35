"""Figures that must not grow faster than the input."""

import pytest
from pyspark.sql import functions as F

from burstlens.operators import dataset as DS
from burstlens.operators.downstream import upsert_table, write_summary_table
from burstlens.session import tune


def test_scan_tasks_are_small_enough_to_sort(spark):
    """Wide rows spilled in tasks of 128 MB."""
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    tune(other)
    assert other.conf.get("spark.sql.files.maxPartitionBytes") == "64m"


def test_upsert_runs_the_new_rows_once(spark, tmp_path):
    """they ran once more to tell their buckets."""
    path = str(tmp_path / "table")
    stamp = F.lit("2002-01-01").cast("timestamp")
    rows = spark.range(100).select(
        F.col("id").alias("image_id"), F.lit(0.5).alias("focus_score"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    write_summary_table(rows, path, buckets=4)
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    upsert_table(rows.mapInPandas(seen, rows.schema), path, buckets=4)
    assert runs.value == 100
    assert spark.read.parquet(path).count() == 100


def test_annotations_are_hashed_and_narrow(spark, sf_dir):
    """F32: whole annotations were shuffled and sorted."""
    from burstlens import plans

    images = spark.range(100).selectExpr("id", "'f' AS file_name", "1L AS width", "1L AS height")
    anns = spark.range(300).selectExpr("id", "id % 90 AS image_id", "id AS n")
    joined = DS.join_annotations(images, anns, ("n",))
    assert joined.count() == 310
    plan = plans.queries()["image_annotations"](spark, sf_dir)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "ShuffledHashJoin" in text
    exchanged = [line for line in text.splitlines() if "Exchange" in line]
    assert exchanged and not any("keypoints" in line for line in exchanged)
    joins = [line for line in text.splitlines() if "ShuffledHashJoin [image_id" in line]
    assert joins


def test_tasks_list_and_read_files(spark, sf_dir, tmp_path):
    """the driver held a list of all files."""
    from burstlens import plans
    from burstlens import sources as R
    from burstlens.sources.files import read_texts

    for name in ("a.JPG", "sub/deep/b.png", "sub/c.txt", "_hidden/d.png", "sub/.e.png", "f g%20h.bmp"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        rows = sorted(R.list_images(spark, root).collect())
        names = ("a.JPG", "f g%20h.bmp", "sub/deep/b.png")
        assert [tuple(r) for r in rows] == [(str(tmp_path / n), len(n)) for n in names]
    named = spark.createDataFrame([("a.JPG",), ("sub/c.txt",)], "file string")
    assert sorted(read_texts(named, str(tmp_path)).collect()) == [("a.JPG", "a.JPG"), ("sub/c.txt", "sub/c.txt")]
    for query in ("image_listing", "label_files"):
        scans = plans.queries()[query](spark, sf_dir).inputFiles()
        assert not [f for f in scans if f.endswith((".bmp", ".txt"))]


def test_load_errors_lists_once(spark, sf_dir):
    """two listings in the driver, and a join of them."""
    from burstlens import plans

    text = plans.queries()["load_errors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("FileScan") == 1


def test_places_are_longs_and_grow_along_files(spark, tmp_path):
    """places were decimals of 38 digits, and each line went through regular expressions."""
    from burstlens.sources import annotations as A

    (tmp_path / "locs").mkdir()
    body = [f"{i} {i % 7} 1.5 2.5 1" for i in range(900)]
    for name, lines in (("a", body), ("b", ["5  5\t7 8 0", "", " 6 6   7 8 0 ", "7 \x0b 6 7 8 0"])):
        (tmp_path / "locs" / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines = A.placed_lines(spark, str(tmp_path / "locs"))
        assert lines.schema["place"].dataType.simpleString() == "bigint"
        rows = [r.value for r in sorted(lines.collect(), key=lambda r: r.place)]
        assert len({r.place for r in lines.collect()}) == 904
        assert rows[:900] == body and rows[900] == "5  5\t7 8 0"
        found = A.parse_part_locs(lines).filter("y = 8").drop("place").collect()
        assert sorted(found) == [(5, 5, 7.0, 8.0, 0), (6, 6, 7.0, 8.0, 0), (7, 6, 7.0, 8.0, 0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rank_goes_before_place(spark, tmp_path):
    """the first of several ids of a name wins, then its last line, also as one long."""
    from burstlens.sources.annotations import read_part_tables

    files = {
        "images.txt": "1 a", "bounding_boxes.txt": "1 1 1 1 1", "parts/parts.txt": "9 beak\n4 Beak\n5 crown",
        "parts/part_locs.txt": "1 4 1 1 1\n1 9 2 2 1\n1 4 3 3 1\n1 9 4 4 1\n1 4 5 5 1\n2 4 6 6 1\n2 4 7 7 0",
    }
    (tmp_path / "parts").mkdir()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    t = read_part_tables(spark, str(tmp_path))
    out = {r.image_id: r.beak for r in DS.pivot_parts(t["locs"], t["parts"]).collect()}
    assert (out[1].x, out[2].x, out[2].v) == (4.0, 7.0, 0)
    assert "decimal" not in str(t["locs"].schema).lower()


def test_tasks_decode_plain_bitmaps_like_the_image_source(spark, tmp_path):
    """all image files were listed in the driver."""
    import struct
    import zlib

    from burstlens import sources as R

    def bitmap(w, h, bits=24, up=1, offset=54):
        body = bytes((7 * i + w) % 256 for i in range((w * bits // 8 + 3) // 4 * 4 * h))
        head = struct.pack("<2sIHHI", b"BM", offset + len(body), 0, 0, offset)
        return head + struct.pack("<IiiHHIIiiII", 40, w, up * h, 1, bits, 0, 0, 0, 0, 0, 0) + body

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0))
    png += chunk(b"IDAT", zlib.compress(b"\0" + bytes(range(6)))) + chunk(b"IEND", b"")
    plain = {"a/1.bmp": bitmap(4, 3), "a/2.BMP": bitmap(5, 2), "3.bmp": bitmap(1, 1) + b"tail", "4.bmp": b"broken", "5.bmp": b""}
    mixed = plain | {
        "6.png": png, "7.bmp": png, "8.bmp": bitmap(5, 2, up=-1), "9.bmp": bitmap(3, 2, bits=32), "a/b c.bmp": bitmap(2, 2),
        "cut.bmp": b"BM\0\0", "gone.jpg": b"\xff\xd8\xff",
    }
    for name, files in (("plain", plain), ("mixed", mixed), ("glob", {"x[1].bmp": bitmap(3, 3), "y.bmp": bitmap(2, 3)})):
        root = tmp_path / name
        for file, body in files.items():
            (root / file).parent.mkdir(exist_ok=True, parents=True)
            (root / file).write_bytes(body)
        old = spark.read.format("image").option("recursiveFileLookup", "true").load(str(root))
        wanted = old.selectExpr(
            "regexp_replace(image.origin, '^file:/+', '/')", "image.width", "image.height", "image.nChannels", "image.data"
        )
        found = R.read_images(spark, str(root))
        rows = found.select("path", "width", "height", "n_channels", "data").collect()
        # The image source leaves out empty files; they cannot be decoded, so they are rows too.
        empty = [(str(root / n), -1, -1, -1, b"") for n, body in files.items() if not body]
        assert sorted(map(tuple, rows)) == sorted([*map(tuple, wanted.collect()), *empty])
        text = found._jdf.queryExecution().executedPlan().toString()
        assert ("FileScan image" in text) == (name != "plain")


def test_crops_move_no_pixels(spark, sf_dir):
    """whole photos were shuffled to meet their windows."""
    from burstlens import plans
    from burstlens.plans import fixtures as X

    for query in ("crop_gray", "photo_moments", "crop_pixels"):
        text = plans.queries()[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        pixels = text.index("ArrowEvalPython [data(")
        assert "Exchange" not in text[:pixels] and "MapInPandas" not in text
    meta = X.photo_meta(spark, sf_dir)
    same = X.photos(spark, sf_dir).select("image_id", "n_channels", "data")
    assert X.with_pixels(meta).select("image_id", "n_channels", "data").exceptAll(same).count() == 0


def test_paths_of_files_are_not_broadcast(spark, sf_dir):
    """the driver held the path of every photo, twice."""
    from burstlens import plans

    plan = plans.queries()["score_files"](spark, sf_dir)._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()


def test_label_files_take_no_block_each(spark, sf_dir, tmp_path, monkeypatch):
    """r04 F1: a label of 200 bytes took 4 KB and an inode of the disk."""
    import zipfile

    from burstlens import plans
    from burstlens import sinks as K
    from burstlens.plans import dataset_queries as DQ
    from burstlens.sources.files import read_packed

    monkeypatch.setattr(DQ, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = plans.queries()["label_files"](spark, sf_dir).select("label", "line").collect()
    files = [p for p in (tmp_path / "labels").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    assert 0 < len(files) <= 16 < len(rows)
    members = {}
    for file in files:
        with zipfile.ZipFile(file) as pack:
            members |= {n: pack.read(n).decode() for n in pack.namelist()}
    assert members == {r.label: f"{r.line}\n" for r in rows}

    manifest = spark.range(50_000).selectExpr("concat('labels/', id % 3, '/', id, '.txt') AS label").coalesce(1)
    many = spark.range(300).selectExpr("'labels/0/0.txt' AS label", "concat('line ', 299 - id) AS line", "299 - id AS ann_id")
    K.write_label_files(manifest, many, str(tmp_path / "many"), packed=True)
    back = {r.file: r.value for r in read_packed(spark, str(tmp_path / "many")).collect()}
    assert len(back) == 50_000 and back["labels/0/0.txt"] == "".join(f"line {n}\n" for n in range(300))
    assert {v for n, v in back.items() if n != "labels/0/0.txt"} == {""}
    with pytest.raises(Exception, match="new folder"):
        K.write_label_files(manifest, many, str(tmp_path / "many"), packed=True)


def test_a_second_run_of_a_task_replaces_its_packs(spark, tmp_path):
    """r04 F1: packs are whole or absent, and closed before their index grows large."""
    from burstlens.sinks import files as SF
    from burstlens.sources.files import read_packed

    root = str(tmp_path / "out")
    writer = SF.PackedFilesWriter({"path": root, "separator": "|"})

    def attempt(fail):
        def rows():
            for n in range(10):
                if fail and n == 9:
                    raise OSError("lost")
                yield (f"d/{n // 2}.txt", f"{n}")

        def run(_):
            usual, SF.PACK_FILES = SF.PACK_FILES, 2
            try:
                return [writer.write(rows()).n_files]
            finally:
                SF.PACK_FILES = usual

        return run

    one = spark.sparkContext.parallelize([0], 1)
    with pytest.raises(Exception, match="lost"):
        one.mapPartitions(attempt(True)).collect()
    assert not list((tmp_path / "out").glob("*.zip"))
    for _ in range(2):
        assert one.mapPartitions(attempt(False)).collect() == [5]
    assert len(list((tmp_path / "out").glob("*.zip"))) == 3
    rows = sorted(map(tuple, read_packed(spark, root).collect()))
    assert rows == [(f"d/{n}.txt", f"{2 * n}|{2 * n + 1}") for n in range(5)]


def test_summaries_of_photos_move_no_pixels(spark, sf_dir):
    """r04 F3: whole photos were shuffled to meet their boxes or eyes."""
    from burstlens import plans
    from burstlens.operators import scoring as SC
    from burstlens.plans import fixtures as X

    for query in ("photo_summary", "score_located"):
        text = plans.queries()[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        pixels = text.index("ArrowEvalPython [data(")
        assert "Exchange" not in text[:pixels] and "Broadcast" not in text
    given = (X.photo_detections(spark, sf_dir), X.photo_meta(spark, sf_dir), X.photos(spark, sf_dir))
    late = SC.score_photos(given[1], given[0], tie_break=X.DETECTION_ORDER, pixels=X.with_pixels)
    early = SC.score_photos(given[2], given[0], tie_break=X.DETECTION_ORDER).select(*late.columns)
    assert late.count() == early.count() > 0 and late.exceptAll(early).count() == 0


def test_files_are_decoded_behind_the_join(spark, sf_dir, tmp_path):
    """r04 F2: whole photos were shuffled to meet their boxes, also where other images are among them."""
    import struct
    import zlib

    from burstlens import plans
    from burstlens.operators import scoring as SC
    from burstlens.operators.predict import score_folder
    from burstlens.plans import fixtures as X
    from burstlens.sources import read_images

    text = plans.queries()["score_files"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    pixels = text.index("ArrowEvalPython [image(")
    assert "Exchange" not in text[:pixels] and text.count("image(_uri") == 1

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    root = X.render_photos(spark, sf_dir, F.col("image_id") < 40)
    folder = root.removeprefix("file:")
    lines = b"".join(b"\0" + bytes((x * y + c) % 256 for x in range(60) for c in range(3)) for y in range(50))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 60, 50, 8, 2, 0, 0, 0))
    with open(f"{folder}/lot_0/part_900.png", "wb") as out:
        out.write(png + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    ids = F.regexp_extract("path", r"part_(\d+)\.", 1).cast("bigint").alias("image_id")
    paths = read_images(spark, root).select("path", ids)
    near = F.when(F.col("image_id") == 41, 900).otherwise(F.col("image_id"))
    boxes = X.photo_detections(spark, sf_dir).withColumn("image_id", near).join(paths, "image_id").drop("image_id")
    late = score_folder(spark, root, boxes, tie_break=X.DETECTION_ORDER).drop("eyes", "orientation")
    early = SC.score_files(read_images(spark, root), boxes, tie_break=X.DETECTION_ORDER).select(*late.columns)
    assert late.count() == early.count() >= 40 and late.exceptAll(early).count() == 0
    other = late.filter("path LIKE '%part_900.png'").first()
    assert (other.width, other.height, other.error) == (60, 50, None) and other.notes == []


@pytest.mark.parametrize("name", ["score_files", "image_scan", "image_listing", "load_errors"])
def test_photos_are_on_disk_a_lot_at_a_time(spark, sf_dir, tmp_path, monkeypatch, name):
    """r04 F2: all photos stood on the disk together, 11 KB each."""
    from compare import connect, differences

    from burstlens import plans
    from burstlens.plans import fixtures as X

    seen, drop = [], X._drop
    monkeypatch.setattr(X, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{len(seen)}"))
    monkeypatch.setattr(X, "_LOT", 60)

    def dropped(spark, root):
        seen.append(sum(p.suffix.lower() == ".bmp" for p in tmp_path.rglob("*.*")))
        drop(spark, root)

    monkeypatch.setattr(X, "_drop", dropped)
    table = plans.queries()[name](spark, sf_dir)
    assert differences(table, connect(sf_dir), plans.oracles()[name]) == []
    assert len(seen) == 3 and all(0 < n <= 60 for n in seen)
