from lodeline.operators import architecture as A


def test_layers_of_one_split_are_dealt(spark):
    files = spark.range(100).selectExpr("id", "concat('src/handlers/', id, '.py') as path", "false as is_entry").coalesce(1)
    made = A.fuse_layers(files)
    assert made.rdd.getNumPartitions() > 1
    assert made.where("layer = 'api'").count() == 100
