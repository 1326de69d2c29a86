"""Scoring of all submissions on all cells in one job: three tasks that don't sink each other, and the actual arm."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import family
from shelfwise.operators import counterfactual, elasticity, forecast, validity
from shelfwise.sources.submissions import duplicate_entries
from shelfwise.staging import staged

KEYS = ("cell_slug", "submission_name")
HEADLINE = "pooled_own_wmpe_substitution_wape"


def with_header(keys: DataFrame, config: DataFrame, weeks: DataFrame, arm: str) -> DataFrame:
    """Submission and cell with schema version, benchmark version, family, evaluation weeks and arm."""
    listed = weeks.groupBy("cell_slug").agg(F.sort_array(F.collect_set(F.col("week").cast("long"))).alias("evaluation_weeks"))
    return keys.join(config.select("cell_slug", "benchmark_version", "family"), "cell_slug", "left").join(listed, "cell_slug", "left").select(
        *KEYS, F.lit(2).alias("schema_version"), F.coalesce("benchmark_version", F.lit("unversioned")).alias("benchmark_version"), (F.lit("actual") if arm == "actual" else F.coalesce("family", family("cell_slug"))).alias("family"),
        "evaluation_weeks", F.lit(HEADLINE).alias("headline_statistic"), F.lit(arm).alias("data_arm"),
    )


def _task(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return rows.select(*KEYS, F.struct(F.lit("scored").alias("status"), *columns).alias(name))


def _status(out: DataFrame, name: str, absent: str = "not_submitted") -> DataFrame:
    """Where the task has no result: why."""
    return out.withColumn(name, F.when(F.col(name).isNull(), F.from_json(F.lit(f'{{"status": "{absent}"}}'), out.schema[name].dataType)).otherwise(F.col(name)))


#: The payload's block of each task.
BLOCKS = {"forecast": "sales_forecasting", "elasticity": "elasticity_recovery", "counterfactual": "counterfactual_prediction"}


def with_problems(payloads: DataFrame, told: DataFrame) -> DataFrame:
    """Payloads in which the tasks that ``told`` (submission_name, cell_slug, task, status, ...) calls ``invalid_format`` have that status; other tasks keep their scores."""
    bad = told.where("status = 'invalid_format'").groupBy(*KEYS).agg(F.collect_set("task").alias("__bad"))
    out = payloads.join(bad, list(KEYS), "left")
    for task, block in BLOCKS.items():
        invalid = F.from_json(F.lit('{"status": "invalid_format"}'), out.schema[block].dataType)
        out = out.withColumn(block, F.when(F.array_contains("__bad", task), invalid).otherwise(F.col(block)))
    return out.drop("__bad")


def scored_apart(cells: Iterable[str], score: Callable[[str], DataFrame]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Payloads of the cells that can be scored, written one cell at a time, and (cell_slug, reason) of those that fail: for a run whose one job over all cells broke off."""
    done, failed = [], []
    for slug in cells:
        try:
            done.append(staged(score(slug), "payloads"))
        except Exception as e:  # whatever a cell's files do, the others are scored
            failed.append((slug, f"scoring error: {str(e)[:500]}"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done) if done else None, failed


def evaluate(keys: DataFrame, config: DataFrame, panel: DataFrame, weeks: DataFrame, elasticity_truth: DataFrame, sweep_truth: DataFrame, sweep_context: DataFrame, forecasts: DataFrame, matrices: DataFrame, deltas: DataFrame) -> DataFrame:
    """A payload for each of ``keys`` (cell_slug, submission_name). A task that a submission hasn't is ``not_submitted``, a matrix with doubled entries ``invalid_format``."""
    by = ("submission_name",)
    training, _ = forecast.split_weeks(panel, weeks)
    weights = forecast.revenue_weights(training)
    truth = forecast.demand_truth(panel, weeks, forecast.support_pairs(training))
    scored = forecast.demand_scores(forecasts, truth, weights, by=by)
    out = with_header(keys, config, weeks, "synthetic").join(_task(scored, "sales_forecasting", [c for c in scored.columns if c not in KEYS]), list(KEYS), "left")

    doubled = duplicate_entries(matrices)
    matrix = elasticity.elasticity_scores(matrices.join(doubled, list(KEYS), "left_anti"), elasticity_truth, weights, by=by)
    out = out.join(_task(matrix, "elasticity_recovery", ["n_products", "n_matrix_entries_missing_in_submission", "submission_complete", "own_price", "cross_price"]), list(KEYS), "left")
    out = _status(out.join(doubled.withColumn("__doubled", F.lit(True)), list(KEYS), "left"), "elasticity_recovery")
    invalid = F.from_json(F.lit('{"status": "invalid_format"}'), out.schema["elasticity_recovery"].dataType)
    out = out.withColumn("elasticity_recovery", F.when(F.col("__doubled"), invalid).otherwise(F.col("elasticity_recovery"))).drop("__doubled", "n_duplicates")

    scenes = counterfactual.score_scenarios(sweep_truth, deltas, sweep_context, by=by)
    top = counterfactual.flagship(scenes).select(
        *KEYS, F.struct(
            F.col("intervention_id").alias("scenario"), F.struct("own_price_wmpe", "own_price_status", "n_store_weeks_focal_missing", "n_stores_focal_carrying", "n_stores_total").alias("own_price"),
            F.struct("substitution_wape", "substitution_status", "n_store_weeks_scored").alias("substitution"),
        ).alias("headline"),
    )
    each = scenes.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("intervention_id", "own_price_wmpe", "substitution_wape"))).alias("interventions"))
    both = each.join(top, list(KEYS), "left")
    out = out.join(_task(both, "counterfactual_prediction", ["headline", "interventions"]), list(KEYS), "left")
    return _status(_status(out, "sales_forecasting"), "counterfactual_prediction")


def evaluate_actual(keys: DataFrame, config: DataFrame, panel: DataFrame, weeks: DataFrame, sweep: DataFrame, forecasts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Payloads of the actual arm: forecasts and coherence; the other tasks don't apply to it."""
    by = ("submission_name",)
    training, _ = forecast.split_weeks(panel, weeks)
    truth = forecast.demand_truth(panel, weeks, forecast.support_pairs(training))
    scored = forecast.demand_scores(forecasts, truth, forecast.revenue_weights(training), by=by)
    out = with_header(keys, config, weeks, "actual").join(_task(scored, "sales_forecasting", [c for c in scored.columns if c not in KEYS]), list(KEYS), "left")
    v = validity.score_validity(sweep, deltas, by=by)
    checks = v.select(
        *KEYS, F.struct(
            F.lit("scored").alias("status"), F.struct(F.col("own_price_sign").alias("frac_correct_sign")).alias("own_price_sign"),
            F.struct(F.col("substitution_mass").alias("frac_redistribution_mass_correct"), F.col("substitution_count").alias("frac_competitors_correct_count")).alias("substitution_sign"),
            F.struct("n_products", "frac_in_band", "frac_correct_sign", "frac_wrong_sign", "frac_extreme").alias("own_elasticity_range"), F.struct(F.col("monotonicity").alias("frac_consistent")).alias("monotonicity"),
            "n_focals", F.struct("gate.verdict", "gate.fail_reasons", "gate.warn_reasons").alias("gate"),
        ).alias("validity_checks_actual"),
    )
    out = _status(_status(out.join(checks, list(KEYS), "left"), "sales_forecasting"), "validity_checks_actual")
    absent = F.struct(F.lit("not_applicable_actual_data").alias("status"))
    return out.withColumns({"elasticity_recovery": absent, "counterfactual_prediction": absent})


#: Why a cell isn't scored.
NOT_SENT, NO_TRUTH = "no submission subdirectory", "hidden truth absent (eval cell?)"


def skipped(cells: DataFrame, with_truth: DataFrame, submitted: DataFrame) -> DataFrame:
    """(cell_slug, reason) of cells that aren't scored: no submission, or no truth."""
    no_submission = cells.join(submitted.select("cell_slug").distinct(), "cell_slug", "left_anti").select("cell_slug", F.lit(NOT_SENT).alias("reason"))
    no_truth = cells.join(submitted.select("cell_slug").distinct(), "cell_slug", "left_semi").join(with_truth.select("cell_slug").distinct(), "cell_slug", "left_anti")
    return no_submission.unionByName(no_truth.select("cell_slug", F.lit(NO_TRUTH).alias("reason")))
