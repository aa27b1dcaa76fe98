"""Named queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Inputs are built once per session and data folder: ``raw`` (the 16-column
export), ``typed`` (repaired, typed), ``dedup`` (identical copies removed)
and ``clean`` (the whole cleaning pipeline, materialised as a stage table,
as the reference materialises ``game_events_clean`` before its marts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playlens.operators import attributes as attr
from playlens.operators import dedup as dd
from playlens.operators import identity as ident
from playlens.operators import outcomes as oc
from playlens.operators import profile as prof
from playlens.operators import repair as rp
from playlens.operators import timeline as tl
from playlens.plans import dashboard as dash
from playlens.plans import difficulty as dif
from playlens.plans import dropoff as dro
from playlens.plans import eda
from playlens.plans import marts
from playlens.plans.cleaning import (CleanConfig, attributes_events, clean_events, clean_events_measured,
                                     infer_levels_stage, report_frame)
from playlens.session import stage_table
from playlens.sources.fixture import game_events_raw

_CACHE: dict = {}
# The fixture's analogue of the player whose batch index the reference fills.
CONFIG = CleanConfig(batch_index_entities=(8,))


def inputs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _CACHE:
        if name == "raw":
            df = game_events_raw(spark, sf_dir)
        elif name == "typed":
            df = rp.typed_events(inputs(spark, sf_dir, "raw"))
        elif name == "dedup":
            df = dd.exact_dedup(inputs(spark, sf_dir, "typed"))
        elif name == "attributes":
            df = attributes_events(inputs(spark, sf_dir, "raw"), CONFIG)
        elif name == "levels":
            df = infer_levels_stage(inputs(spark, sf_dir, "attributes"), CONFIG)
        elif name == "outcomes":
            # The table after the reference's first C32 / C34 pass, before
            # the inconsistent rows are dropped (where it checks them).
            df = oc.infer_is_success(oc.fill_time_played_median(inputs(spark, sf_dir, "levels")))
        elif name == "clean":
            df = stage_table(oc.repair_outcomes(inputs(spark, sf_dir, "levels")), "clean")
        else:
            raise KeyError(name)
        _CACHE[key] = df
    return _CACHE[key]


def _on(stage: str, fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(inputs(spark, sf_dir, stage))


def _cascade(col: str, level: str):
    return lambda df: attr.fill_cascade(df, [col], [level])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # 2.1 cleaning and reconstruction
    "sci_notation_repair": _on("raw", rp.sci_notation_repair),
    "typed_events": _on("raw", rp.typed_events),
    "cast_failures": _on("raw", rp.count_cast_failures),
    "distinct_row_count": _on("typed", dd.distinct_row_count),
    "duplicate_report": _on("typed", dd.duplicate_report),
    "exact_dedup": _on("typed", dd.exact_dedup),
    "row_count": _on("dedup", dd.row_count),
    "key_dedup": _on("typed", dd.key_dedup),
    "null_user_matches": _on("dedup", ident.null_user_matches),
    "ambiguous_sessions": _on("dedup", ident.ambiguous_sessions),
    "fill_user_single_session": _on("dedup", ident.fill_user_single_session),
    "fill_user_nearest": _on("dedup", ident.fill_user_nearest),
    "fill_user_surrogate": _on("dedup", ident.fill_user_surrogate),
    "remaining_null_users": _on("dedup", lambda df: ident.remaining_null_users(ident.repair_user_ids(df))),
    "null_profile": _on("dedup", prof.null_profile),
    "fill_mode_for_entity": _on("dedup", lambda df: attr.fill_mode_for_entity(
        df, "user_id", 8, "batch_event_index")),
    "fill_app_version_session": _on("dedup", _cascade("app_version", "session")),
    "fill_app_version_user": _on("dedup", _cascade("app_version", "user")),
    "fill_app_version_global": _on("dedup", _cascade("app_version", "global")),
    "fill_game_mode_session": _on("dedup", _cascade("game_mode", "session")),
    "fill_game_mode_user": _on("dedup", _cascade("game_mode", "user")),
    "fill_game_mode_global": _on("dedup", _cascade("game_mode", "global")),
    "fill_brand_session": _on("dedup", _cascade("mobile_brand_name", "session")),
    "fill_brand_user": _on("dedup", _cascade("mobile_brand_name", "user")),
    "fill_brand_global": _on("dedup", _cascade("mobile_brand_name", "global")),
    "null_level_backup": _on("dedup", tl.null_level_backup),
    "drop_isolated_null_level": _on("dedup", tl.drop_isolated_null_level),
    "level_timeline": _on("dedup", tl.level_timeline),
    "infer_level": _on("dedup", tl.infer_level),
    "infer_level_preview": _on("dedup", tl.infer_level_preview),
    "median_by_level_outcome": _on("dedup", oc.median_by_level_outcome),
    "fill_time_played_median": _on("dedup", oc.fill_time_played_median),
    "success_fail_medians": _on("dedup", oc.success_fail_medians),
    "infer_is_success": _on("dedup", oc.infer_is_success),
    "missing_time_rows": _on("dedup", oc.missing_time_rows),
    "missing_outcome_rows": _on("dedup", oc.missing_outcome_rows),
    "inconsistent_rows": _on("dedup", oc.inconsistent_rows),
    "outcome_null_counts": _on("dedup", oc.outcome_null_counts),
    "drop_inconsistent": _on("dedup", oc.drop_inconsistent),
    "clean_events": lambda spark, sf_dir: clean_events(inputs(spark, sf_dir, "raw"), CONFIG),
    # the reference's checks at their place in the chain: their counts from one run, and the rows
    "chain_report": lambda spark, sf_dir: report_frame(
        spark, clean_events_measured(inputs(spark, sf_dir, "raw"), CONFIG)[1]),
    "chain_null_level_backup": _on("attributes", tl.null_level_backup),
    "chain_missing_time_rows": _on("outcomes", oc.missing_time_rows),
    "chain_missing_outcome_rows": _on("outcomes", oc.missing_outcome_rows),
    "chain_inconsistent_rows": _on("outcomes", oc.inconsistent_rows),
    "chain_outcome_null_counts": _on("outcomes", oc.outcome_null_counts),
    # 2.2 exploratory metrics
    "dataset_overview": _on("clean", eda.dataset_overview),
    "event_distribution": _on("clean", eda.event_distribution),
    "success_rate": _on("clean", eda.success_rate),
    "playtime_stats": _on("clean", eda.playtime_stats),
    "top_countries": _on("clean", eda.top_countries),
    "device_distribution": _on("clean", eda.device_distribution),
    "level_distribution": _on("clean", eda.level_distribution),
    "retries_per_level": _on("clean", eda.retries_per_level),
    "fail_rate_by_level": _on("clean", eda.fail_rate_by_level),
    "playtime_by_level": _on("clean", eda.playtime_by_level),
    "fail_and_playtime": _on("clean", eda.fail_and_playtime),
    # 2.3 drop-off
    "dropoff_next_level": _on("clean", dro.dropoff_next_level),
    "dropoff_last_event": _on("clean", dro.dropoff_last_event),
    "dropoff_fail_at_max_level": _on("clean", dro.dropoff_fail_at_max_level),
    # 2.4 difficulty
    "difficulty_fail_rate": _on("clean", dif.difficulty_fail_rate),
    "difficulty_avg_retries": _on("clean", dif.difficulty_avg_retries),
    "difficulty_avg_playtime": _on("clean", dif.difficulty_avg_playtime),
    "difficulty_score": _on("clean", dif.difficulty_score),
    "difficulty_combined": _on("clean", dif.difficulty_combined),
    # 2.5 output tables
    "game_events_clean": _on("clean", marts.game_events_clean),
    "level_dropoff": _on("clean", marts.level_dropoff),
    "level_difficulty": _on("clean", marts.level_difficulty),
    "user_progression": _on("clean", marts.user_progression),
    "level_summary": _on("clean", marts.level_summary),
    **{f"mart_preview_{name}": _on("clean", lambda df, name=name: marts.preview({name: marts.build_marts(df)[name]})[name])
       for name in marts.TABLE_KEYS},
    # 2.6 dashboard datasets
    "retention_funnel": _on("clean", dash.retention_funnel),
    "churn_profile": _on("clean", dash.churn_profile),
    "fail_rate_trend": _on("clean", dash.fail_rate_trend),
    "difficulty_spikes": _on("clean", dash.difficulty_spikes),
    "segment_metrics": _on("clean", dash.segment_metrics),
    "progression_overview": _on("clean", dash.progression_overview),
    "missingness_patterns": _on("dedup", prof.missingness_patterns),
}
