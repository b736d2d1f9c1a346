"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from freshet import session
from freshet.operators.detect import first_sightings
from freshet.operators.extract import explode_links, extract
from freshet.plans.workload import QUERIES
from freshet.plans.workload_sql import ORACLE
from freshet.sources.snapshots import snapshots_of_pages

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def many_pages(spark):
    return snapshots_of_pages(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.fixture
def large(monkeypatch):
    """Any input counts as one that has a large share for every core."""
    monkeypatch.setattr(session, "SMALL_SHARE_BYTES", 0)


def test_extraction_does_not_shuffle(spark, large):
    text = plan(explode_links(extract(many_pages(spark), skip_navigation=False)))
    assert "Exchange" not in text and text.count("MapInArrow") <= 2
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text


def test_a_small_input_is_dealt_to_all_cores_once(spark):
    assert plan(extract(many_pages(spark), skip_navigation=False)).split("\n\n")[0].count("Exchange") == 1


def test_planning_runs_no_job(spark):
    pages = many_pages(spark)
    ends = pages.groupBy("site_id").agg(F.max("run_ts").alias("last"))
    spark.sparkContext.setJobGroup("planning", "planning")
    explode_links(extract(pages.join(ends, "site_id"), skip_navigation=False))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["canonical_urls"](spark, SF))
    assert "html" not in plan(QUERIES["same_site_hosts"](spark, SF)).split("ReadSchema")[1].splitlines()[0]


def test_sightings_combine_before_the_only_shuffle(spark, large):
    links = explode_links(extract(many_pages(spark), skip_navigation=False))
    text = plan(first_sightings(links))
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "partial_min" in text and "Window" not in text


def test_later_filters_do_not_repeat_extraction(spark, large):
    pages = extract(many_pages(spark), skip_navigation=False)
    plain, filtered = plan(pages), plan(pages.filter(F.col("error").isNull() & (F.col("link_count") > 1)))
    assert filtered.count("array_distinct") <= plain.count("array_distinct")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
