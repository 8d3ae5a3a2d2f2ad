"""Queries that take in every row of their tables. Those with SQL are held against it in test_queries."""

from spectrafold.queries import QUERIES
from spectrafold.sources.cubes import event_cube

DATA = "/root/testdata/sf0.01"


def test_merge_and_concatenate_take_every_cell(spark):
    cube = event_cube(spark, DATA).select("ch", "time", "epoch").cache()
    later = cube.selectExpr("ch", "time + 1 AS time", "epoch")
    merged = QUERIES["merge_all_cells"](spark, DATA).select("ch", "time", "epoch").collect()
    assert sorted(merged) == sorted(cube.union(later).distinct().collect())
    both = QUERIES["concatenate_all_cells"](spark, DATA)
    assert both.count() == 2 * cube.count() and both.select("epoch").distinct().count() == cube.select("epoch").distinct().count()


def test_indicators_of_every_class(spark):
    found = QUERIES["label_indicators_all"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/embeddings.parquet").where("label is not null")
    assert found.select("sub_problem").distinct().count() == labels.select("label").distinct().count()
    assert found.where("y = 1").count() == labels.count()


def test_whiten_takes_vectors_without_label(spark, tmp_path):
    rows = [(i, None if i % 2 else 1, [float((i * 7 + k * k) % 11) for k in range(64)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r["vec_id"] for r in QUERIES["whiten"](spark, str(tmp_path)).collect()) == list(range(20))
