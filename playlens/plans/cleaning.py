"""The cleaning pipeline (C40): raw gameplay export -> clean event table.

Stages in the reference's order:

1. repair ids, type, drop shadows (C01-C03); drop identical copies (C06)
2. player ids: single-user session, nearest event, surrogate (C11-C13),
   read through (its heavy parts are small staged sets)
3. batch index of one entity (C16); app_version, game_mode,
   mobile_brand_name by session -> user mode -> global mode (C17-C25)
4. null-level snapshot (C26); drop isolated null levels (C27); infer
   levels (C29) - one timeline pass
5. durations (C32), outcomes (C34), drop inconsistent rows (C39)

The second median/outcome pass of the reference changes nothing and is not
repeated (a test asserts that it is a no-op).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playlens.model import ALL14
from playlens.operators.attributes import ATTRIBUTES, fill_cascade, fill_mode_for_entity
from playlens.operators.dedup import counted_dedup, exact_dedup
from playlens.operators.identity import measured_user_ids
from playlens.operators.outcomes import drop_inconsistent, fill_outcomes, outcome_checks
from playlens.operators.repair import REPAIRED, typed_events, typed_events_with_losses
from playlens.operators.timeline import ROW, infer_level, null_level_backup, with_row_id
from playlens.session import StageScope, measured_stage, stage_table
from playlens.sources.readers import write_table


@dataclass
class CleanConfig:
    # Entities whose NULL batch index takes their own mode (C16); the
    # reference names one player id in its statement.
    batch_index_entities: tuple = ()
    attributes: tuple = ATTRIBUTES
    # Rows above which one user or session is cut into ranges; None: the default.
    target_rows: int | None = None
    # Where C26 writes its snapshot; None skips the write.
    null_level_backup_path: str | None = None
    # Materialise stage outputs (lineage cut); off only for tiny tests, where
    # then no step writes anything.
    stage_tables: bool = True


def dedup_events(raw: DataFrame) -> DataFrame:
    return exact_dedup(typed_events(raw))


def _nulls(cols) -> dict:
    return {f"null_{c}": F.count_if(F.col(c).isNull()) for c in cols}


class Chain:
    """One run of the chain: its tables, and the counts that their writes collected.

    Every full table is written once and the write counts its rows (see
    ``measured_stage``). Those counts are the reference's own checks along the way
    (:meth:`report`), and they plan the rest: a step whose rows do not exist is
    left out with its stages, and a table known to be small needs no job that looks
    for hot keys, no staged ranges for ranks and medians. Without stage tables nothing
    is known, and every step runs.
    """

    def __init__(self, spark: SparkSession, cfg: CleanConfig):
        self.cfg = cfg
        self.scope = StageScope(spark, cfg.stage_tables)
        self.counts: dict[str, dict] = {}

    def __enter__(self) -> Chain:
        self.scope.__enter__()
        return self

    def __exit__(self, *exc) -> None:
        self.scope.__exit__(*exc)

    def cut(self, df: DataFrame, name: str, metrics: dict, columns: list | None = None) -> DataFrame:
        """End a stage: what earlier stages wrote is read for the last time here."""
        out, seen = measured_stage(df, name, metrics, columns)
        if seen is not None:
            self.counts[name] = seen
            self.scope.drop_all_but_last()
        return out

    def latest(self, metric: str) -> int | None:
        """The metric as the last table that counted it has it."""
        return next((c[metric] for c in reversed(self.counts.values()) if metric in c), None)

    def missing(self, column: str) -> bool:
        """Whether the column may have NULLs now."""
        return self.latest(f"null_{column}") != 0

    def dedup(self, raw: DataFrame) -> DataFrame:
        """C01-C06, with row numbers for the steps that look rows up again."""
        lost = [f"{col}_lost" for col, _ in REPAIRED]
        rows = with_row_id(counted_dedup(typed_events_with_losses(raw), ALL14, lost))
        again = F.col("_copies") > 1
        metrics = {"raw_rows": F.sum("_copies"), "duplicate_groups": F.count_if(again),
                   "duplicate_rows": F.sum(F.when(again, F.col("_copies"))), "row_count": F.count("*"),
                   **{c: F.sum(c) for c in lost}, **_nulls(ALL14)}
        return self.cut(rows, "dedup", metrics, [*ALL14, ROW])

    def attributes(self, df: DataFrame) -> DataFrame:
        """C11-C25."""
        rows, before = self.latest("row_count"), df
        if self.missing("user_id"):
            df, seen = measured_user_ids(df, self.cfg.target_rows, rows)
            if seen is not None:
                self.counts["users"] = seen
        if self.missing("batch_event_index"):
            for entity in self.cfg.batch_index_entities:
                df = fill_mode_for_entity(df, "user_id", entity, "batch_event_index")
        # Filled ids may give a row a session or user to take a value from, but never a new NULL.
        if gaps := [c for c in self.cfg.attributes if self.missing(c)]:
            df = fill_cascade(df, gaps)
        if df is before:
            return df
        return self.cut(df, "attributes", {"row_count": F.count("*"), **_nulls(ALL14)})

    def levels(self, df: DataFrame) -> DataFrame:
        """C26, C27, C29."""
        if self.cfg.null_level_backup_path:
            write_table(null_level_backup(df.select(*ALL14)), self.cfg.null_level_backup_path)
        if not self.missing("level"):
            return df
        return infer_level(df, self.cfg.target_rows, drop_isolated=True, rows=self.latest("row_count"))

    def staged_levels(self, raw: DataFrame) -> DataFrame:
        """Everything up to C29 as one table, which the outcome step reads several times."""
        before = self.attributes(self.dedup(raw))
        after = self.levels(before)
        return before if after is before else self.cut(
            after, "levels", {"row_count": F.count("*"), **_nulls(["level", "time_played", "is_success"])}, ALL14)

    def clean(self, df: DataFrame) -> DataFrame:
        """C32, C34 and C39 on a stage table; the checks are counted before the deletion."""
        gaps = self.missing("time_played") or self.missing("is_success")
        filled = fill_outcomes(df, self.latest("row_count")) if gaps else df
        return self.cut(drop_inconsistent(self._checked(filled)), "clean", {"rows_kept": F.count("*")}, ALL14)

    def _checked(self, df: DataFrame) -> DataFrame:
        if not self.scope.enabled:
            return df
        self.checks = Observation(f"checks-{uuid.uuid4().hex}")
        return df.observe(self.checks, *[c.alias(k) for k, c in outcome_checks().items()])

    def report(self) -> dict[str, dict]:
        """Counts by place in the chain: ``dedup`` (after C06), ``users`` (C11-C13), ``attributes``
        (before C26), ``levels`` (after C29), ``outcomes`` (before C39), ``clean``."""
        out = dict(self.counts)
        out.setdefault("attributes", {k: v for k, v in out["dedup"].items() if k == "row_count" or k.startswith("null_")})
        out["outcomes"] = {k: self.checks.get.get(k) or 0 for k in outcome_checks()}
        return out


def attributes_events(raw: DataFrame, cfg: CleanConfig | None = None) -> DataFrame:
    """Stages 1-3: the table as it is before the level steps (C26 reads it)."""
    with Chain(raw.sparkSession, cfg or CleanConfig()) as chain:
        return chain.attributes(chain.dedup(raw)).select(*ALL14)


def infer_levels_stage(df: DataFrame, cfg: CleanConfig) -> DataFrame:
    """Stage 4 on the output of stage 3."""
    with StageScope(df.sparkSession, cfg.stage_tables) as scope:
        out = stage_table(infer_level(df, cfg.target_rows, drop_isolated=True), "levels")
        if scope.enabled:
            scope.drop_all_but_last()
        return out


def clean_events_measured(raw: DataFrame, cfg: CleanConfig | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """The whole chain and the counts of its checks (:meth:`Chain.report`), from the same run."""
    cfg = cfg or CleanConfig()
    if not cfg.stage_tables:
        raise ValueError("counts come from the writes of stage tables, which are off")
    with Chain(raw.sparkSession, cfg) as chain:
        out = chain.clean(chain.staged_levels(raw))
        return out, chain.report()


def report_frame(spark: SparkSession, report: dict[str, dict]) -> DataFrame:
    """A report as rows (place, metric, value)."""
    rows = [F.struct(F.lit(place).alias("place"), F.lit(k).alias("metric"), F.lit(v).cast("long").alias("value"))
            for place, counts in report.items() for k, v in counts.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def clean_events(raw: DataFrame, cfg: CleanConfig | None = None) -> DataFrame:
    """The whole chain. Jobs run while it is built; of the tables that it writes
    only the clean one is left at the end."""
    with Chain(raw.sparkSession, cfg or CleanConfig()) as chain:
        return chain.clean(chain.staged_levels(raw))
