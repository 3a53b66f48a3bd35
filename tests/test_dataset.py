"""Names, numbers, splits, ordering and joins against brute force."""

import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from burstlens import sinks as K
from burstlens.functions import names as N
from burstlens.functions.numbers import exact_round
from burstlens.operators import dataset as DS
from burstlens.operators.downstream import upsert_table, write_summary_table
from burstlens.operators.ordering import dense_index, group_rank
from burstlens.sources.annotations import last_rows, read_part_tables


def test_paths(spark):
    paths = ["a/b.jpg", "x.jpg", "/x.jpg", "a//b/./c.tar.gz", "./a/b", ".hidden", "d/.hid", "a.b/c", "/a/b.c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(
        "p", N.group_key(F.col("p")).alias("g"), N.safe_name(F.col("p")).alias("s"),
        N.stem(N.base_name(F.col("p"))).alias("stem"),
    ).collect()
    for r in rows:
        path = PurePosixPath(r.p)
        assert r.g == str(path.parent)
        assert r.s == str(path).replace("/", "__")
        assert r.stem == path.stem


def test_label_text_is_exact(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w, h = rng.choice([(640, 480), (1280, 960), (333, 77)])
        box = [float(rng.randrange(w)) for _ in range(4)]
        kps = [rng.choice([float(rng.randrange(-9, w)), rng.uniform(0, w)]) for _ in range(18)]
        for j in range(2, 18, 3):
            kps[j] = float(rng.randrange(3))
        rows.append((i, box, kps[: 3 * rng.randrange(7)], w, h))
    df = spark.createDataFrame(
        rows, "i int, box array<double>, k array<double>, w int, h int"
    )
    out = df.select("i", N.label_line(*[F.col(c) for c in ("box", "k", "w", "h")]).alias("t"))
    for i, text in out.collect():
        _, (x, y, bw, bh), k, w, h = rows[i]
        cells = ["0"] + [f"{v:.6f}" for v in ((x + bw / 2) / w, (y + bh / 2) / h, bw / w, bh / h)]
        for j in range(6):
            kx, ky, kv = k[3 * j : 3 * j + 3] or (0.0, 0.0, 0)
            cells += [f"{kx / w:.6f}", f"{ky / h:.6f}", str(int(kv))]
        assert text == " ".join(cells)
        assert len(cells) == 23


def test_exact_round(spark):
    rng = random.Random(5)
    xs = [i / 640 for i in range(500)] + [i * 0.5e-4 for i in range(-400, 400)]
    xs += [99.765, 2.675, 0.125, 3.5e-6, -7.75e-5] + [rng.uniform(0, 100) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cells = [exact_round(F.col("x"), d).alias(f"r{d}") for d in (2, 3, 4)]
    for r in df.select("x", *cells).collect():
        assert [r.r2, r.r3, r.r4] == [round(r.x, 2), round(r.x, 3), round(r.x, 4)]


def test_split_invariants(spark):
    rng = random.Random(1)
    # One folder holds a third of all rows.
    folders = ["hot"] * 500 + [f"g{rng.randrange(40)}" for _ in range(1000)]
    rows = [(i, f"{f}/{i}.jpg") for i, f in enumerate(folders)]
    df = spark.createDataFrame(rows, "id int, file string")
    n = len(set(folders))
    for ratio in (0.0, 0.15, 0.5, 1.0):
        out = DS.split_groups(df, "file", ratio, seed=9).select("group", "split").distinct()
        sides = [r.split for r in out.collect()]
        assert len(sides) == n
        assert sides.count("val") == max(1, int(n * ratio))
    empty = DS.split_groups(df.filter("id < 0"), "file")
    assert empty.count() == 0


def _skewed(spark, n=4000):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), rng.randrange(5), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g int, score int, id int").repartition(5)


def test_group_rank_with_hot_group(spark):
    rows, df = _skewed(spark)
    order = [F.col("score").desc(), F.col("id").asc()]
    got = {r.id: r["rank"] for r in group_rank(df, "g", order, "rank").collect()}
    seen: dict[int, int] = {}
    for g, _, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]
    assert len(got) == len(rows)


def test_dense_index(spark):
    rows, df = _skewed(spark)
    out = dense_index(df, [F.col("id")], "n").select("id", "n").collect()
    assert sorted((r.id, r.n) for r in out) == [(i, i + 1) for i in range(len(rows))]


def test_hot_image_is_a_split_skew_join(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        anns = spark.range(60_000).repartition(8).select(
            F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("image_id"), "id",
            F.array(F.rand(1), F.rand(2)).alias("bbox"), F.array(F.rand(3)).alias("keypoints"),
        )
        images = spark.range(60_000).select(
            "id", F.lit("a/b.jpg").alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height")
        )
        joined = DS.join_annotations(images, anns)
        assert len(joined.collect()) == 60_000 + 40_000 - 1
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_part_id_of_a_name_wins(spark):
    parts = spark.createDataFrame([(1, "beak"), (2, "beak"), (3, "tail")], "part_id bigint, part_name string")
    locs = spark.createDataFrame(
        [(1, 2, 5.0, 5.0, 1), (1, 1, 7.0, 7.0, 0), (2, 2, 9.0, 9.0, 1), (3, 3, 1.0, 1.0, 1)],
        "image_id bigint, part_id bigint, x double, y double, v int",
    )
    out = {r.image_id: r.beak for r in DS.pivot_parts(locs, parts).collect()}
    assert (out[1].x, out[1].v, out[2].x) == (7.0, 0, 9.0)
    assert out.keys() == {1, 2}


def test_csv_collisions_and_bad_boxes(spark):
    rows = spark.createDataFrame(
        [("a/x.jpg", 100, 80, [1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 2.0]),
         ("b/x.jpg", 0, 0, [1.0, 2.0, 3.0, 4.0], []),
         ("b/y.jpg", 10, 10, [], []),
         ("b/gone.jpg", 10, 10, [1.0, 2.0, 3.0, 4.0], [])],
        "image_path string, width bigint, height bigint, box array<double>, keypoints array<double>",
    )
    listing = spark.createDataFrame(
        [("a/x.jpg", 100, 80), ("b/x.jpg", 50, 40), ("b/y.jpg", 10, 10)],
        "path string, width bigint, height bigint",
    )
    manifest, labels = DS.prepare_from_csv(rows, listing, ratio=1.0)
    assert {(r.src, r.collides) for r in manifest.collect()} == {
        ("a/x.jpg", True), ("b/x.jpg", True), ("b/y.jpg", False),
    }
    lines = {r.image_path: r.line for r in labels.collect()}
    assert lines["b/y.jpg"] is None
    assert lines["b/x.jpg"].startswith("0 0.050000 0.100000 0.060000 0.100000 0.000000")


def test_last_line_of_an_id_counts(spark, tmp_path):
    """Ids that stand again, over blocks and files; the order of part ids is that of their first line."""
    files = {
        "images.txt": ["1 a/x.jpg", "2 b.jpg", "", "1 c/y z.jpg"],
        "bounding_boxes.txt": ["1 0 0 1 1", "1 10 20 60 50", "2 1 2 3 4", "2 5 6 7 8", "2 9 9 9 9"],
        "parts/parts.txt": ["7 Crown", "2 tail", "5 beak", "2 Crown"],
    }
    (tmp_path / "parts/part_locs.txt").mkdir(parents=True)
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    # A folder of two files, many blocks each: the last line of the second one counts.
    body = [f"1 {p} {n}.0 {p}.5 1" for n in range(400) for p in (7, 2, 5)]
    (tmp_path / "parts/part_locs.txt/part-0").write_text("\n".join(body) + "\n")
    (tmp_path / "parts/part_locs.txt/part-1").write_text("\n".join([*body[::-1], "2 2 4.0 4.0 1"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        t = read_part_tables(spark, str(tmp_path))
        assert sorted(t["images"].collect()) == [(1, "c/y z.jpg"), (2, "b.jpg")]
        assert sorted(t["boxes"].collect()) == [(1, 10.0, 20.0, 60.0, 50.0), (2, 9.0, 9.0, 9.0, 9.0)]
        assert sorted(t["parts"].collect()) == [(2, "crown", 2), (5, "beak", 3), (7, "crown", 1)]
        assert t["locs"].rdd.getNumPartitions() > 4
        last = sorted(last_rows(t["locs"], "image_id", "part_id").select("image_id", "part_id", "x").collect())
        assert last == [(1, 2, 0.0), (1, 5, 0.0), (1, 7, 0.0), (2, 2, 4.0)]
        out = {r.image_id: r for r in DS.pivot_parts(t["locs"], t["parts"]).collect()}
        assert (out[1].crown.x, out[1].crown.y, out[1].beak.y) == (0.0, 7.5, 5.5)
        assert out[2].crown.y == 4.0 and out[2].beak is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pivot_hashes(spark, tmp_path):
    """The largest table is combined by hash before its one shuffle."""
    kinds = "image_id bigint, part_id bigint, x double, y double, v int, place decimal(38,0)"
    spark.range(100).selectExpr(
        "id AS image_id", "id % 3 AS part_id", "1D AS x", "2D AS y", "1 AS v",
        "CAST(id AS decimal(38,0)) AS place",
    ).write.parquet(str(tmp_path / "locs"))
    locs = spark.read.schema(kinds).parquet(str(tmp_path / "locs"))
    parts = spark.createDataFrame([(0, "crown"), (1, "beak")], "part_id bigint, part_name string")
    text = DS.pivot_parts(locs, parts)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_label_files(spark, tmp_path):
    """One file per label, lines in order; writing again gives the same files, others stay."""
    manifest = spark.createDataFrame(
        [("labels/train/a.txt",), ("labels/val/b.txt",), ("labels/val/b.txt",)], "label string"
    )
    rows = [("labels/train/a.txt", f"line {n}", n) for n in range(300)]
    labels = spark.createDataFrame([*rows[::-1], ("labels/val/b.txt", None, 1)], "label string, line string, ann_id int")
    (tmp_path / "other.txt").write_text("stays")
    for _ in range(2):
        K.write_label_files(manifest, labels, str(tmp_path))
        assert (tmp_path / "labels/train/a.txt").read_text() == "".join(f"line {n}\n" for n in range(300))
        assert (tmp_path / "labels/val/b.txt").read_text() == ""
        names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
        assert names == ["_SUCCESS", "labels/train/a.txt", "labels/val/b.txt", "other.txt"]


def test_a_lost_task_leaves_no_part_of_a_file(spark, tmp_path):
    """A task that fails in the middle has moved nothing; a second attempt moves whole files."""
    from burstlens.sinks.files import KeyedFilesWriter

    def rows(fail):
        for n in range(4):
            if fail and n == 3:
                raise OSError("lost")
            yield (f"d/{n // 2}.txt", f"{n}")

    def attempt(fail):
        return lambda _: [KeyedFilesWriter({"path": root}).write(rows(fail)).n_files]

    root = str(tmp_path / "out")
    one = spark.sparkContext.parallelize([0], 1)
    with pytest.raises(Exception, match="lost"):
        one.mapPartitions(attempt(True)).collect()
    assert not (tmp_path / "out/d").exists()
    assert one.mapPartitions(attempt(False)).collect() == [2]
    assert (tmp_path / "out/d/1.txt").read_text() == "2\n3"


def test_crop_files(spark, tmp_path):
    rows = [("dbg/a_left_eye.jpg", 2, 1, bytearray(b"\x01\xff")), ("dbg/b.jpg", 0, 0, bytearray(b"\x00"))]
    kinds = "crop_path string, crop_width_px int, crop_height_px int, gray binary"
    K.write_crop_files(spark.createDataFrame(rows, kinds), str(tmp_path))
    assert (tmp_path / "dbg/a_left_eye.pgm").read_bytes() == b"P5\n2 1\n255\n\x01\xff"
    assert not (tmp_path / "dbg/b.pgm").exists()


def test_upsert_replaces_touched_buckets_only(spark, tmp_path):
    def rows(ids, score, at):
        return spark.range(*ids).selectExpr(
            "id AS image_id", f"{score}D AS focus_score", f"TIMESTAMP '{at}' AS created_at",
            f"TIMESTAMP '{at}' AS updated_at",
        )

    path = tmp_path / "table"
    write_summary_table(rows((0, 200), 0.1, "2020-01-01"), str(path), buckets=8)
    listed = lambda: {p.parent.name: p.name for p in path.rglob("*.parquet")}
    before = listed()
    assert len(before) == 8
    upsert_table(rows((5, 6), 0.9, "2021-01-01"), str(path), buckets=8)
    after = listed()
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    table = spark.read.parquet(str(path))
    assert table.count() == 200
    row = table.filter("image_id = 5").first()
    assert (row.focus_score, row.created_at.year, row.updated_at.year) == (0.9, 2020, 2021)
    upsert_table(rows((5, 6), 0.2, "2019-01-01"), str(path), buckets=8)  # an older run changes nothing
    assert spark.read.parquet(str(path)).filter("image_id = 5").first().focus_score == 0.9
    upsert_table(rows((0, 0), 0.2, "2030-01-01"), str(path), buckets=8)
    assert spark.read.parquet(str(path)).count() == 200


def test_part_rows_are_not_sent_whole_to_the_tasks(spark, sf_dir):
    from burstlens.plans import fixtures as X

    tables = X.annotation_tables(spark, sf_dir)
    pivoted = DS.pivot_parts(tables["locs"], tables["parts"])
    files = X.annotation_files(spark, sf_dir)
    classified = DS.classify_images(tables["images"], tables["boxes"], files, pivoted)
    found = pivoted._jdf.queryExecution().executedPlan().toString()
    assert found.count("BroadcastHashJoin [part_id") == 1
    assert "Inner, BuildRight" in found and "Inner, BuildLeft" not in found
    # Only the vocabulary is broadcast; images, files, boxes and parts grow with the input.
    assert classified._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
