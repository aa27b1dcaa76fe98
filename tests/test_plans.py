"""Physical-plan checks: pushdown, pruning, partial aggregation, and no
nested-loop joins or Python in any registered query."""

import re

import pytest

from playlens.operators import attributes as attr
from playlens.operators import timeline
from playlens.operators.ranking import dense_rank_global
from playlens.plans import dashboard, dropoff, eda
from playlens.plans.cleaning import dedup_events
from playlens.registry import QUERIES, inputs
from playlens.sources.fixture import game_events_raw

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(p):
    return [(re.search(r"PushedFilters: \[([^\]]*)\]", line), re.search(r"ReadSchema: (struct<[^>]*>)", line))
            for line in p.splitlines() if "FileScan parquet" in line]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_nested_loops_or_python(spark, key):
    p = plan(QUERIES[key](spark, SF))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "FlatMapGroupsInPandas"):
        assert bad not in p, (key, bad)


def test_metric_scans_are_pruned_and_filtered(spark):
    clean = inputs(spark, SF, "clean")
    (pushed, schema), = scans(plan(eda.fail_rate_by_level(clean)))
    assert "IsNotNull(is_success)" in pushed.group(1)
    assert schema.group(1) == "struct<level:int,is_success:string>"
    for _, schema in scans(plan(dropoff.level_dropoff(clean))):
        assert schema.group(1) == "struct<user_id:bigint,level:int>"


def test_entity_filter_reaches_the_scan(spark):
    clean = inputs(spark, SF, "clean")
    p = plan(attr.fill_mode_for_entity(clean, "user_id", 8, "batch_event_index"))
    assert any(f and "EqualTo(user_id,8)" in f.group(1) for f, _ in scans(p))


def test_dedup_aggregates_before_the_shuffle(spark):
    p = plan(dedup_events(game_events_raw(spark, SF)))
    # a partial HashAggregate below the exchange: copies collapse map-side
    lines = [ln.strip() for ln in p.splitlines()]
    ex = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    assert any("HashAggregate" in ln for ln in lines[ex + 1:])


def executed(df):
    """The plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df).partition("== Initial Plan ==")[0]


def test_level_inference_shuffles_ordinary_users_once(spark, monkeypatch):
    plans, real = [], timeline.measured_stage

    def spy(df, name, *more):
        if name == "inferred_levels":
            plans.append(executed(df))
        return real(df, name, *more)

    monkeypatch.setattr(timeline, "measured_stage", spy)
    out = timeline.infer_level(inputs(spark, "/root/testdata/sf0.01", "dedup"))
    (p,) = plans
    assert p.count("Exchange hashpartitioning") == 1 and p.count("FileScan") == 1 and "Join" not in p
    # what was decided joins the rows without a level; the others come from a scan of their own
    last = executed(out)
    assert "Window" not in last and last.count("Union") == 1 and "IsNotNull(level)" in last


def test_fails_at_highest_level_scan_once(spark):
    clean = inputs(spark, SF, "clean")
    p = plan(dropoff.dropoff_fail_at_max_level(clean))
    assert p.count("FileScan parquet") == 1 and "Join" not in p
    p = executed(dashboard.churn_profile(clean))
    assert p.count("FileScan parquet") <= 4  # with the reused scan of the shared aggregate


def test_rank_plan_does_not_grow_with_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert len(plan(dense_rank_global(df, "k", ranges=200))) < len(plan(dense_rank_global(df, "k", ranges=2))) + 200


@pytest.mark.parametrize("key", ["dataset_overview", "segment_metrics", "level_summary", "level_difficulty", "user_progression"])
def test_distinct_counts_multiply_no_row(spark, key):
    assert "Expand" not in plan(QUERIES[key](spark, SF))


def test_segments_read_the_events_once(spark):
    p = plan(dashboard.segment_metrics(inputs(spark, SF, "clean")))
    assert p.count("FileScan parquet") == 3 and "time_played" not in p  # three times the staged counts, never the events
