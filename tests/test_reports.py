"""Reports rendered from orders: tasks follow the rows, queries write no more than they read back."""

import os

import pytest
from pyspark.sql import functions as F

from folioquery.catalog import markdown as md, stores as cs
from folioquery.functions import fixed_values as fv
from folioquery.operators import parse as ps
from folioquery.session import new_table_path
from folioquery.sources import stores as st


@pytest.fixture()
def sf(spark, tmp_path):
    orders = spark.range(1, 41).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"),
                                       F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"))
    items = orders.where("o_orderkey > 3").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("l_linenumber")) \
        .select("*", (F.col("l_orderkey") * 10).alias("l_partkey"), F.col("l_orderkey").alias("l_suppkey"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_tasks_follow_the_number_of_items(spark, sf, monkeypatch):
    want = sorted(map(str, md.report_chunks(spark, sf).collect()))
    monkeypatch.setattr(md, "ITEMS_A_TASK", 10)
    for rendered in (md.reports, md.web_reports):
        assert rendered(spark, sf).rdd.getNumPartitions() == 12
    assert sorted(map(str, md.report_chunks(spark, sf).collect())) == want and len(want) == 40 * 5 + 37 * 3


def test_chunks_read_once_are_not_written(spark, sf):
    folder = os.path.dirname(new_table_path(spark, "probe"))
    before = set(os.listdir(folder))
    assert md.table_audit(spark, sf).count() == 37 * 3 + 40  # rows and figures
    assert sum(r["n"] for r in md.content_type_hist(spark, sf).collect()) == 40 * 5 + 37 * 3
    assert sum(r["n"] for r in md.index_quality(spark, sf).collect()) == 40 * 5 + 37 * 3
    assert set(os.listdir(folder)) == before


def test_stored_files_are_compressed_and_read_without_moving_texts(spark, sf, tmp_path):
    path = str(tmp_path / "parents")
    chunks = ps.parse_chunks(md.reports(spark, sf))
    st.write_jsonl(ps.parent_store(chunks), path)
    assert {f.rsplit(".", 1)[1] for f in os.listdir(path) if f.startswith("part-")} == {"gz"}
    rows = st.read_parents(spark, path)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "Aggregate" not in plan
    assert rows.count() == chunks.count() == cs.parent_store_file(spark, sf).count()


def test_last_of_repeated_ids(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "z", 2), (None, "u", 4), (None, "v", 5), ("a", "w", 2)], "id string, text string, place int")
    want = {("a", "y"), ("b", "z"), (None, "v")}
    assert {tuple(r) for r in st.last_per_id(rows, "place").collect()} == want
    monkeypatch.setattr(st, "fits_broadcast", lambda df: False)
    assert {tuple(r) for r in st.last_per_id(rows, "place").collect()} == want


def test_cells_of_repeated_and_single_columns(spark):
    name = fv.PRIMARY_COLUMNS[-1]
    text = f"## Table 1 Things\n| k | {name} | k |\n|---|---|---|\n| 1 | r1 | 3 |\n## Table 2 More\n| a | {name} |\n|---|---|\n| 1 | r2 |"
    rows = ps.parse_chunks(spark.createDataFrame([(1, text)], "file_id long, value string")).orderBy("n").collect()
    assert [r["text"].split(" | ", 3)[3] for r in rows] == [f"k: 3 | {name}: r1", f"a: 1 | {name}: r2"]
    assert [r["page_content"].rsplit(" | ", 1)[1] for r in rows] == ["r1", "r2"]
