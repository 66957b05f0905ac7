"""Files: images, logs, tables, bucketed joins."""

import numpy as np
import pytest
from images import write_png
from pyspark.sql import Observation
from pyspark.sql import functions as F

from steadymark.operators.labels import label_from_path
from steadymark.plans import layers
from steadymark.sources import images, tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(2)
    for name in ("b_dog", "a_cat"):
        (root / "nested" / name).mkdir(parents=True)
        for i in range(3):
            write_png(root / "nested" / name / f"{i}.png", rng.integers(0, 256, (4, 6, 3)))
    write_png(root / "nested" / "a_cat" / "grey.png", np.full((2, 2), 9))
    (root / "nested" / "b_dog" / "junk.png").write_bytes(b"this is no image")
    return root


def test_scan_falls_back_to_png_and_labels_by_directory(spark, folder):
    rows = images.scan_images(spark, str(folder)).collect()
    assert sorted(r["true_label"] for r in rows) == ["a_cat"] * 4 + ["b_dog"] * 4
    assert images.scan_images(spark, str(folder), ("*.jpg", "*.png")).columns == ["image_path", "true_label", "length"]


def test_scan_of_an_empty_folder_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        images.scan_images(spark, str(tmp_path))


def test_dataset_has_label_indices(spark, folder):
    rows = images.image_dataset(spark, str(folder)).select("true_label", "label_index").distinct().collect()
    assert sorted(map(tuple, rows)) == [("a_cat", 0), ("b_dog", 1)]


def test_junk_is_dropped_and_counted(spark, folder, tmp_path):
    seen = Observation("images")
    decoded = images.decode_images(spark, str(folder), "*.png", seen)
    tables.write_table(decoded, str(tmp_path / "decoded"))
    assert spark.read.parquet(str(tmp_path / "decoded")).count() == 7
    assert seen.get == {"read": 8, "dropped": 1}


def test_pixels_are_rgb_in_row_order(spark, tmp_path):
    picture = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 7
    (tmp_path / "x").mkdir()
    write_png(tmp_path / "x" / "1.png", picture)
    write_png(tmp_path / "x" / "2.png", np.array([[5, 6]]))
    rows = {r["width"]: r for r in images.decode_images(spark, str(tmp_path), "*.png").collect()}
    assert rows[3]["vector"] == picture.ravel().tolist() and rows[3]["height"] == 2
    assert rows[2]["vector"] == [5, 5, 5, 6, 6, 6]


def test_images_of_different_sizes_are_corrupted(spark, folder):
    decoded = images.decode_images(spark, str(folder), "*.png")
    shape = layers.ImageShape("height", "width", "channels", pixels=True)
    rows = layers.corrupted_images(decoded, shape).select(
        "corruption_type", F.size("vector").alias("n"), F.array_min("vector").alias("lo"), F.array_max("vector").alias("hi")
    ).collect()
    assert len(rows) == 7 * 9
    assert {r["n"] for r in rows} == {4 * 6 * 3, 2 * 2 * 3}
    assert all(0 <= r["lo"] <= r["hi"] <= 255 for r in rows)


def test_run_log_appends_with_a_header(spark, tmp_path):
    path = str(tmp_path / "runs")
    tables.log_run(spark, path, 100, 16, "cpu", 8.0, {"CPU_Avg": 12.5})
    tables.log_run(spark, path, 100, 16, "cpu", 0.0)
    rows = images.read_or_empty(spark, path, tables.RUN_LOG).orderBy("Img_Per_Sec").collect()
    assert [r["Img_Per_Sec"] for r in rows] == ["0.00", "12.50"]
    assert len(rows[0]) == 13 and rows[1]["CPU_Avg"] == 12.5 and rows[1]["Images"] == 100


def test_training_log(spark, tmp_path):
    path = str(tmp_path / "training")
    assert images.read_or_empty(spark, path, tables.TRAINING_LOG).count() == 0
    tables.log_training(spark, path, 16, 0.30712, {"accuracy": 0.967, "f1": 0.9666}, 36.77)
    row = images.read_or_empty(spark, path, tables.TRAINING_LOG).first()
    assert (row["rank"], row["train_loss"], row["accuracy"], row["f1"], row["recall"]) == (16, 0.3071, 0.967, 0.9666, 0.0)


def test_projection_reaches_the_scan(spark, sf_dir):
    plan = tables.read_table(spark, f"{sf_dir}/lineitem.parquet", "l_tax").where("l_tax > 0.04")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in text and "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.04)]" in text


def test_single_file_and_overwrite(spark, tmp_path):
    path = tmp_path / "t"
    for n in (100, 7):
        tables.write_single_file(spark.range(n).repartition(5), str(path))
        assert len(list(path.glob("*.parquet"))) == 1 and tables.read_table(spark, str(path)).count() == n
    assert tables.preview(spark.range(100), 3).count() == 3
    tables.write_table(spark.range(3), str(path))
    assert spark.read.parquet(str(path)).count() == 3


def test_tables_bucketed_alike_join_without_a_shuffle(spark):
    keys = ["image_path", "adapter_rank"]
    base = spark.range(500).select(F.col("id").alias("image_path"), (F.col("id") % 3).alias("adapter_rank"))
    tables.write_bucketed(base, "bucketed_left", keys, 4)
    tables.write_bucketed(base.withColumn("v", F.lit(1)), "bucketed_right", keys, 4)
    joined = spark.table("bucketed_left").hint("merge").join(spark.table("bucketed_right"), keys)
    assert joined.count() == 500
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("bucketed_left", "bucketed_right"):
        spark.sql(f"DROP TABLE {name}")


def test_label_of_a_nested_path(spark):
    df = spark.createDataFrame([("/r/x/y/z.png",)], "p string")
    assert df.select(label_from_path(F.col("p"))).first()[0] == "y"


def test_all_image_suffixes_are_read(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    for name in ("1.png", "2.PNG"):
        write_png(tmp_path / "cat" / name, np.full((2, 2), 9))
    (tmp_path / "cat" / "3.jpg").write_bytes(b"junk")
    (tmp_path / "cat" / "4.Jpeg").write_bytes(b"junk")
    (tmp_path / "cat" / "5.txt").write_bytes(b"text")
    assert images.scan_images(spark, str(tmp_path)).count() == 4
    assert images.decode_images(spark, str(tmp_path)).count() == 2
