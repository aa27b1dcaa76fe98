"""The chain's own counts, the steps that it leaves out, and what its rewrites shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F
from rows import frame

from playlens.model import ALL14, RAW_SCHEMA
from playlens.operators import dedup as dd
from playlens.operators import identity as ident
from playlens.operators import outcomes as oc
from playlens.operators import timeline as tl
from playlens.operators.asof import nearest_by_time
from playlens.operators.ranking import dense_rank_global
from playlens.plans import cleaning
from playlens.plans.cleaning import CleanConfig, clean_events, clean_events_measured, dedup_events
from playlens.registry import CONFIG, inputs
from playlens.session import STAGE_LOG, StageScope, measured_stage
from playlens.sources.fixture import game_events_raw

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def raw_of(spark, rows):
    """Typed hand-made rows as a raw export."""
    typed = frame(spark, rows)
    text = typed.withColumns({"user_id": F.col("user_id").cast("string"), "event_timestamp": F.col("event_timestamp").cast("string")})
    raw = text.withColumns({"user_id2": F.col("user_id"), "event_timestamp2": F.col("event_timestamp")})
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])


def job_count(spark, run):
    spark.sparkContext.setJobGroup(f"count-{random.random()}", "count")
    group = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


def test_report_equals_the_checks_taken_one_by_one(spark):
    clean, report = clean_events_measured(game_events_raw(spark, SF), CONFIG)
    dedup, typed = inputs(spark, SF, "dedup"), inputs(spark, SF, "typed")
    profile = dedup.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ALL14]).first().asDict()
    assert {k: report["dedup"][k] for k in profile} == profile
    assert report["dedup"]["row_count"] == dd.row_count(dedup).first()[0] == dd.distinct_row_count(typed).first()[0]
    assert report["dedup"]["raw_rows"] == typed.count()
    assert report["dedup"]["duplicate_rows"] == dd.duplicate_report(typed).count()
    assert report["attributes"]["null_user_id"] == ident.remaining_null_users(ident.repair_user_ids(dedup)).first()[0]
    attributes, outcomes = inputs(spark, SF, "attributes"), inputs(spark, SF, "outcomes")
    assert report["attributes"]["null_level"] == tl.null_level_backup(attributes).count()
    assert report["outcomes"]["missing_time_rows"] == oc.missing_time_rows(outcomes).count()
    assert report["outcomes"]["missing_outcome_rows"] == oc.missing_outcome_rows(outcomes).count()
    assert report["outcomes"]["inconsistent_rows"] == oc.inconsistent_rows(outcomes).count()
    nulls = oc.outcome_null_counts(outcomes).first().asDict()
    assert {k: report["outcomes"][k] for k in nulls} == nulls
    assert report["clean"]["rows_kept"] == clean.count()


def test_counts_cost_no_job(spark):
    raw = game_events_raw(spark, SF)
    _, plain = job_count(spark, lambda: clean_events(raw, CONFIG))
    (_, report), measured = job_count(spark, lambda: clean_events_measured(raw, CONFIG))
    assert measured == plain <= 45 and sum(map(len, report.values())) > 40


def test_steps_without_rows_are_left_out(spark):
    whole = [dict(user_id=u, event_timestamp=t, level=1 + t // 3, session_id=u) for u in (1, 2, 3) for t in range(9)]
    STAGE_LOG.clear()
    clean, report = clean_events_measured(raw_of(spark, whole + whole[:2]))
    assert [n for n, _ in STAGE_LOG] == ["dedup", "clean"]
    assert clean.count() == 27 and report["dedup"]["duplicate_groups"] == 2 and report["attributes"]["row_count"] == 27
    assert report["outcomes"]["inconsistent_rows"] == 0 and "users" not in report and "levels" not in report
    # one gap brings back its own step alone
    for gap, stages in ((dict(user_id=None), {"user_fill", "attributes"}), (dict(level=None), {"inferred_levels", "levels"}),
                        (dict(game_mode=None), {"attribute_counts", "attributes"}), (dict(time_played=None), set())):
        STAGE_LOG.clear()
        some = raw_of(spark, [*whole, {**whole[4], "event_timestamp": 40, **gap}])
        got = clean_events(some)
        assert {n for n, _ in STAGE_LOG} == {"dedup", "clean"} | stages, gap
        assert same(got, clean_events(some, CleanConfig(stage_tables=False)))


def test_empty_export(spark):
    clean, report = clean_events_measured(raw_of(spark, []))
    assert clean.count() == 0 and report["dedup"]["row_count"] == 0 and report["clean"]["rows_kept"] == 0
    assert clean.columns == ALL14


def test_chain_with_hot_keys_gives_the_same(spark):
    raw = game_events_raw(spark, SF)
    assert same(clean_events(raw, CleanConfig(batch_index_entities=(8,), target_rows=20)), clean_events(raw, CONFIG))


def test_metrics_count_each_row_once(spark):
    df = spark.range(1000).repartition(7)
    out, seen = measured_stage(df, "numbers", {"n": F.count("*"), "sum": F.sum("id")})
    assert seen == {"n": 1000, "sum": 499500} and out.count() == 1000
    out, seen = measured_stage(df.where("id < 0"), "none", {"n": F.count("*"), "sum": F.sum("id")})
    assert seen == {"n": 0, "sum": 0} and out.count() == 0
    with StageScope(spark, False):
        assert measured_stage(df, "off", {"n": F.count("*")}, ["id"])[1] is None


def test_duplicate_report_has_one_scan_and_no_join(spark):
    report = dd.duplicate_report(inputs(spark, SF, "typed"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_duplicate_report_spreads_a_hot_group(spark):
    hot = frame(spark, [dict(user_id=7)])
    rest = frame(spark, [dict(user_id=u, event_timestamp=u % 5) for u in range(300)])
    df = hot.crossJoin(spark.range(600)).drop("id").unionByName(rest).unionByName(rest)
    report = dd.duplicate_report(df, chunk=10, partition_rows=100)
    sizes = [r.n for r in report.where("duplicate_count = 600").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 200
    rows = report.collect()
    assert [r.duplicate_count for r in rows] == sorted((r.duplicate_count for r in rows), reverse=True) and len(rows) == 1200
    assert same(report.drop("duplicate_count"), df)
    with StageScope(spark, False):
        assert same(dd.duplicate_report(df, chunk=7), report)


def test_duplicate_report_without_copies(spark):
    assert dd.duplicate_report(frame(spark, [dict(user_id=1), dict(user_id=2)])).count() == 0


def exchanged(df):
    """Bytes that a run of ``df`` shuffled, from its plan's metrics."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleBytesWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_level_inference_shuffles_half_of_what_whole_rows_take(spark, monkeypatch):
    rows = measured_stage(tl.with_row_id(inputs(spark, "/root/testdata/sf0.01", "dedup")), "rows")[0]
    narrow = []
    real = tl.measured_stage

    def spy(df, name, *more):
        if name == "inferred_levels":
            narrow.append(exchanged(df))
        return real(df, name, *more)

    monkeypatch.setattr(tl, "measured_stage", spy)
    out = tl.infer_level(rows)
    after = exchanged(out)
    wide = exchanged(tl._infer_wide(rows.drop(tl.ROW), None, False, None))
    assert narrow and narrow[0] + after <= wide / 2, (narrow, after, wide)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Union", plan)


def timeline_rows(seed, users, n, times):
    rng = random.Random(seed)
    return [dict(user_id=rng.choice(users), event_timestamp=rng.choice([None, *range(times)]), batch_event_index=rng.choice([None, 0, 1]),
                 event_name=rng.choice(["level_start", "level_end"]), session_id=rng.choice([1, 2]), time_played=rng.choice([None, 1.0, 2.0]),
                 level=rng.choice([None, None, 1, 2, 5, 9]), is_success=rng.choice([None, "TRUE", "FALSE"]),
                 country=f"c{i}") for i in range(n)]


@pytest.mark.parametrize("times", [3, 12, 400])
@pytest.mark.parametrize("target", [None, 40])
def test_narrow_inference_equals_whole_rows_with_ties(spark, times, target):
    df = dd.exact_dedup(frame(spark, timeline_rows(times, [1, 2, 3, 4, None], 300, times)
                              + [dict(user_id=1000 + i, level=None) for i in range(5)])).cache()
    for drop in (False, True):
        want = tl._infer_wide(df, None, drop, None)
        got = tl.infer_level(df, target, drop)
        keys = [c for c in ALL14 if c != "level"]
        # rows equal in all order columns are interchangeable
        assert same(got.select(*keys, "level"), want.select(*keys, "level"))


def test_known_sizes_change_no_result(spark):
    df = inputs(spark, SF, "dedup").cache()
    n = df.count()
    assert same(ident.repair_user_ids(df, rows=n), ident.repair_user_ids(df))
    assert same(dense_rank_global(df, "session_id", rows=n), dense_rank_global(df, "session_id"))
    assert same(oc.median_by_level_outcome(df, rows=n), oc.median_by_level_outcome(df))
    assert same(oc.repair_outcomes(df, n), oc.drop_inconsistent(oc.infer_is_success(oc.fill_time_played_median(df))))
    assert same(tl.infer_level(df, rows=n), tl._infer_wide(df, None, False, None))
    assert same(cleaning.typed_events_with_losses(game_events_raw(spark, SF)).select(*ALL14).distinct(), dedup_events(game_events_raw(spark, SF)))


@pytest.fixture
def shuffled_joins(spark):
    """No side is small enough to broadcast, and partitions stay as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_burst_at_one_instant_is_spread(spark, shuffled_joins):
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("session_id"), F.when(F.col("id") < 30_000, F.lit(500).cast("long")).otherwise(
        F.col("id")).alias("ts"), F.col("id").alias("u"))
    known = rows.where("u % 3 = 0")
    out = nearest_by_time(rows.where("u % 3 = 1"), known.withColumnRenamed("u", "v"), "session_id", "ts", "v", "near", hot_rows=500)
    assert out.count() == rows.where("u % 3 = 1").count()
    assert out.where("ts = 500 and near != 0").count() == 0 and out.where("ts > 500 and near is null").count() == 0
    assert out.where("ts > 500 and abs(near - ts) > 1 and u > 30001").count() == 0
    sizes = [r.n for r in out.where("ts = 500").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 4_000 and len(sizes) >= 4


@pytest.mark.parametrize("seed", range(4))
def test_nearest_equals_brute_force_with_bursts(spark, seed):
    rng = random.Random(seed)
    evs = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, None, 3, 4, 5]), rng.choice([0, 7, 7, 7, 9, 20, 31])) for _ in range(120)]
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(evs)], "i int, k long, u long, ts long")
    for hot, target in ((1, None), (3, 2), (10**6, 2)):
        got = nearest_by_time(rows.where("u is null").drop("u"), rows.where("u is not null"), "k", "ts", "u", "near", target, hot_rows=hot)
        got = {r.i: r.near for r in got.collect()}
        for i, (k, u, t) in enumerate(evs):
            if u is None:
                cands = [(abs(t - s), v) for (j, v, s) in evs if j == k and v is not None]
                assert got[i] == (min(cands)[1] if cands else None)
        assert len(got) == sum(u is None for _, u, _ in evs)
