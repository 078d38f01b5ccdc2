"""What only shows on tables that are larger, or lie otherwise, than the given ones."""

import duckdb
from pyspark.sql import functions as F

from flowlens.operators import ml
from flowlens.plans import registry, report_queries
from flowlens.plans.fixtures import Tables

from .conftest import SF


def repeated(spark, path, times, shift):
    """The events of the smallest tables ``times`` over, with shifted keys."""
    copies = spark.range(times).withColumnRenamed("id", "i")
    events = spark.read.parquet(f"{SF}/events.parquet").crossJoin(copies)
    events.withColumn("event_id", F.col("event_id") + F.col("i") * shift).drop("i").coalesce(1).write.parquet(f"{path}/events.parquet")


def test_strict_timeline_without_a_significant_window(spark, tmp_path):
    # with so many flows in each window, none of some tactics has half of its attacks found
    repeated(spark, tmp_path, 60, 100_003)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = registry.QUERIES["t07_timeline_strict"](spark, str(tmp_path))
    want = con.sql(registry.ORACLES["t07_timeline_strict"]).select(*out.columns).fetchall()
    assert any(r[out.columns.index("first_significant_idx")] is None for r in want)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def partition_sizes(df):
    return df.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"].tolist()


def uneven(spark):
    """Rows of which nearly all lie in one partition."""
    rows = spark.range(3_000, numPartitions=1).union(spark.range(10, numPartitions=3))
    return rows.select(F.array((F.col("id") % 2).cast("float"), F.lit(0.5)).alias("features"), (F.col("id") % 2).cast("int").alias("y"))


def test_forest_passes_over_even_partitions(spark, monkeypatch):
    seen = []

    class Forest(ml.RandomForestClassifier):
        def fit(self, data):
            seen.append((partition_sizes(data), self.getCacheNodeIds()))
            return super().fit(data)

    monkeypatch.setattr(ml, "RandomForestClassifier", Forest)
    ml.train_forest(uneven(spark), trees=2, depth=2)
    ((sizes, kept),) = seen
    assert sum(sizes) == 3_010 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.1 * min(sizes) and kept


def test_more_rows_are_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(ml, "ROWS", 300)
    assert len(partition_sizes(ml.spread(uneven(spark)))) == 12


def test_a_model_scores_its_test_rows_once(spark, monkeypatch):
    scored = []
    score = ml.score_flows

    def counting(model, rows):
        out = score(model, rows)
        times = spark.sparkContext.accumulator(0)
        scored.append(times)
        mark = F.udf(lambda p: times.add(1) or p, "double").asNondeterministic()
        return out.withColumn("Probability", mark("Probability"))

    monkeypatch.setattr(ml, "score_flows", counting)
    e = uneven(spark).withColumns({"y_real": F.col("y"), "split": F.lit("test")})
    report_queries.evaluated(Tables(spark, SF), ml.train_forest(e, trees=2, depth=2), e).collect()
    assert [t.value for t in scored] == [3_010]


def test_edge_representation_rounds_what_is_the_edges_own(spark):
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        plan = registry.QUERIES["g12_edge_representation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.split("Join")[0].count("round(") == report_queries.WIDE


def test_net_passes_over_even_partitions(spark, monkeypatch):
    seen = []

    class Net(ml.MultilayerPerceptronClassifier):
        def fit(self, data):
            seen.append(partition_sizes(data))

    monkeypatch.setattr(ml, "MultilayerPerceptronClassifier", Net)
    ml.train_edge_mlp(uneven(spark), inputs=2)
    (sizes,) = seen
    assert sum(sizes) == 3_010 and max(sizes) < 1.1 * min(sizes)
