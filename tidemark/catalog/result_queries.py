"""Result reconciliation, design bookkeeping, calibration and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog.registry import query, r, rounded
from tidemark.catalog.sweep_queries import DESIGN_SQL, cells
from tidemark.operators import calibration as C
from tidemark.operators import checks as V
from tidemark.operators import design as D
from tidemark.operators import joins as J
from tidemark.operators import results as R
from tidemark.plans import publish as PB

K6 = "experiment_id, model, seed, draw, n, k"
BEST_SQL = f"""{views.CKPT_SQL}, best AS (SELECT * FROM ckpt QUALIFY row_number() OVER (PARTITION BY {K6}
  ORDER BY (status IN ('ok', 'skipped')) DESC, seq DESC) = 1)"""
ROW = f"{K6}, status, seq, rmse, fit_seconds, best_rounds, converged"
CELLS = ["model", "seed", "draw", "n", "k"]


@query("dedupe_prefer_completed", f"WITH {BEST_SQL} SELECT {ROW} FROM best")
def dedupe_prefer_completed(spark, d):
    return R.prefer_completed(views.ckpt(spark, d))


@query("completed_keys", f"WITH {BEST_SQL} SELECT {K6} FROM best WHERE status IN ('ok', 'skipped')")
def completed_keys(spark, d):
    return R.completed_keys(R.prefer_completed(views.ckpt(spark, d)))


@query("rows_for_experiment", f"WITH {views.CKPT_SQL} SELECT {ROW} FROM ckpt")
def rows_for_experiment(spark, d):
    rows = views.ckpt(spark, d)
    other = rows.withColumn("experiment_id", F.lit("other"))
    return R.rows_for_experiment(rows.unionByName(other), "exp")


@query("add_metadata", f"WITH {views.CKPT_SQL} SELECT {ROW}, 'v1' AS data_version FROM ckpt")
def add_metadata(spark, d):
    return R.add_metadata(views.ckpt(spark, d), {"data_version": "v1", "status": "never"})


@query("publish_projection", f"WITH {views.CKPT_SQL} SELECT {K6}, status, seq, rmse, converged FROM ckpt")
def publish_projection(spark, d):
    return R.publish_projection(views.ckpt(spark, d))


@query("order_results", f"WITH {BEST_SQL} SELECT {K6}, rmse FROM best ORDER BY {K6}")
def order_results(spark, d):
    return R.ordered(R.prefer_completed(views.ckpt(spark, d)).select(*R.RESULT_KEYS, "rmse"))


@query("verify_sorted_unique", f"""WITH {views.CKPT_SQL}, p AS (SELECT seq + seq // 7 AS seq, ROW({K6}) AS here, lag(ROW({K6})) OVER (ORDER BY seq) AS before FROM ckpt)
SELECT CASE WHEN here = before THEN 'duplicate' ELSE 'unordered' END AS kind, count(*)::BIGINT AS n, min(seq) AS first_pos FROM p WHERE here <= before GROUP BY 1""")
def verify_sorted_unique(spark, d):
    gaps = F.col("seq") + F.floor(F.col("seq") / 7)  # positions need not follow each other
    return R.order_violations(views.ckpt(spark, d).withColumn("seq", gaps), "seq")


EXPECT_SQL = "expect AS (SELECT DISTINCT model, seed FROM ckpt), want AS (SELECT model, seed, 24::BIGINT AS expected FROM expect)"


@query("completion_status", f"""WITH {BEST_SQL}, {EXPECT_SQL}, c AS (SELECT model, seed, count_if(status = 'ok')::BIGINT AS ok, count_if(status = 'skipped')::BIGINT AS skipped,
  count_if(status = 'failed')::BIGINT AS failed, count(*)::BIGINT AS materialized FROM best GROUP BY ALL)
SELECT model, seed, expected, ok, skipped, failed, materialized, ok + skipped AS completed,
 CASE WHEN materialized <> expected THEN 'incomplete' WHEN failed > 0 THEN 'complete_with_failures' ELSE 'complete' END AS status FROM want JOIN c USING (model, seed)""")
def completion_status(spark, d):
    rows = views.ckpt(spark, d)
    expected = rows.select("model", "seed").distinct().withColumn("expected", F.lit(24).cast("bigint"))
    return R.completion_status(R.prefer_completed(rows), expected, ["model", "seed"])


POLICY_SQL = """SELECT {by}, ok, skipped, failed, ok + failed AS denominator, {ratio} AS failed_ratio,
 CASE WHEN ok + failed = 0 THEN 'empty_denominator' WHEN failed > 50 THEN 'failed_count' WHEN failed / (ok + failed) > 0.05 THEN 'failed_ratio' END AS violation,
 NOT coalesce(ok + failed = 0 OR failed > 50 OR failed / (ok + failed) > 0.05, false) AS passed
 FROM (SELECT {by}, count_if(status = 'ok')::BIGINT AS ok, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed')::BIGINT AS failed FROM {source} GROUP BY ALL)"""


def policy(by: str, source: str) -> str:
    return POLICY_SQL.format(by=by, source=source, ratio=r("failed / nullif(ok + failed, 0)"))


@query("failure_policy", f"WITH {views.CKPT_SQL} {policy('model, seed', 'ckpt')}")
def failure_policy(spark, d):
    return rounded(R.failure_policy(views.ckpt(spark, d), ["model", "seed"]))


@query("diagnostics_flags", f"""WITH {views.CKPT_SQL} SELECT model, count(*)::BIGINT AS ok_rows, count_if(rmse > 50)::BIGINT AS constant_prediction,
 count_if(coalesce(lower(converged), '') <> 'true')::BIGINT AS nonconverged FROM ckpt WHERE status = 'ok' GROUP BY model""")
def diagnostics_flags(spark, d):
    rows = views.ckpt(spark, d).withColumn("constant_prediction", (F.col("rmse") > 50).cast("string"))
    return R.diagnostics_flags(rows, ["model"])


def numeric_sql(field: str) -> str:
    return f"""SELECT model, '{field}' AS field, count({field})::BIGINT AS count, {r(f'sum({field})', 3)} AS total, {r(f'min({field})')} AS min,
 {r(f'max({field})')} AS max, {r(f'quantile_cont({field}, 0.5)')} AS median FROM ckpt GROUP BY model"""


@query("diagnostics_numeric", f"WITH {views.CKPT_SQL} {numeric_sql('fit_seconds')} UNION ALL {numeric_sql('best_rounds')}")
def diagnostics_numeric(spark, d):
    return rounded(R.diagnostics_numeric(views.ckpt(spark, d), ["model"], ["fit_seconds", "best_rounds"]), total=3)


@query("distinct_ids", f"WITH {views.CKPT_SQL} SELECT DISTINCT experiment_id, model FROM ckpt ORDER BY 1, 2")
def distinct_ids(spark, d):
    return views.ckpt(spark, d).select("experiment_id", "model").distinct().orderBy("experiment_id", "model")


@query("materialize", f"WITH {BEST_SQL} SELECT {K6}, status, seq, rmse, converged FROM best")
def materialize(spark, d):
    rows = views.ckpt(spark, d)
    return R.materialize([rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")], "exp")


@query("verify_materialized", f"""WITH {BEST_SQL}, fin AS (SELECT * FROM best WHERE status <> 'failed'), want AS (SELECT DISTINCT {K6} FROM ckpt)
SELECT 'missing' AS kind, (SELECT count(*) FROM want) - (SELECT count(*) FROM fin) AS n UNION ALL SELECT 'extra', 0 UNION ALL SELECT 'duplicate', 0 UNION ALL SELECT 'unfinished', 0""")
def verify_materialized(spark, d):
    rows = views.ckpt(spark, d)
    final = R.prefer_completed(rows).where("status <> 'failed'")
    return R.verify_materialized(final, rows.select(*R.RESULT_KEYS).distinct())


# A run per (model, seed): seeds are successive runs of a model.
RUNS_SQL = f"""{BEST_SQL}, runs AS (SELECT model, draw, seed AS run_id, max(seq) AS modified, count(*)::BIGINT AS matched, count_if(status <> 'failed')::BIGINT AS completed, 6::BIGINT AS wanted FROM best GROUP BY ALL)"""


def runs_table(spark, d):
    best = R.prefer_completed(views.ckpt(spark, d))
    return best.groupBy("model", "draw", F.col("seed").alias("run_id")).agg(
        F.max("seq").alias("modified"), F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("status") != "failed").alias("completed"), F.lit(6).cast("bigint").alias("wanted"))


@query("reuse_decision", f"""WITH {RUNS_SQL}, latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model, draw ORDER BY modified DESC, run_id DESC) = 1)
SELECT model, draw, CASE WHEN completed < wanted THEN 'resume' ELSE 'reuse' END AS decision, run_id FROM latest""")
def reuse_decision(spark, d):
    return R.reuse_decision(runs_table(spark, d), ["model", "draw"], rerun_completed=False)


@query("latest_run", f"WITH {RUNS_SQL} SELECT model, max(modified) AS modified, arg_max(run_id, modified) AS run_id FROM runs GROUP BY model")
def latest_run(spark, d):
    return runs_table(spark, d).groupBy("model").agg(
        F.max("modified").alias("modified"), F.max_by("run_id", "modified").alias("run_id"))


PANEL_SQL = f"""{views.CKPT_SQL}, prow AS (SELECT CASE WHEN seed < 3 THEN 'early' ELSE 'late' END AS panel, * FROM ckpt),
 one AS (SELECT * FROM prow QUALIFY row_number() OVER (PARTITION BY panel, model, seed, draw, n, k ORDER BY (status IN ('ok', 'skipped')) DESC, seq DESC) = 1),
 want AS (SELECT DISTINCT panel, model, seed, draw, n, k FROM prow), fin AS (SELECT * FROM one WHERE (status <> 'failed' OR seed <> 3) AND NOT (panel = 'late' AND model = (SELECT min(model) FROM ckpt))),
 fault AS (SELECT panel, model, count(*) AS missing FROM want ANTI JOIN fin USING (panel, model, seed, draw, n, k) GROUP BY ALL),
 pol AS ({policy('panel, model', 'fin')}),
 final AS (SELECT w.panel, w.model, coalesce(ok, 0)::BIGINT AS ok, coalesce(skipped, 0)::BIGINT AS skipped, coalesce(failed, 0)::BIGINT AS failed,
   coalesce(denominator, 0)::BIGINT AS denominator, failed_ratio, CASE WHEN pol.model IS NULL THEN 'empty_denominator' ELSE violation END AS violation,
   coalesce(passed, false) AS passed, coalesce(missing, 0)::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS duplicate,
   coalesce(missing, 0) = 0 AND coalesce(passed, false) AS publishable
   FROM (SELECT DISTINCT panel, model FROM want) w LEFT JOIN pol USING (panel, model) LEFT JOIN fault USING (panel, model))"""


def finals(spark, d):
    panel = F.when(F.col("seed") < 3, "early").otherwise("late")
    rows = views.ckpt(spark, d).withColumn("panel", panel)
    keys = ["panel", *CELLS]
    first = rows.agg(F.min("model").alias("model"), F.lit("late").alias("panel"))  # planted: no row of one model
    best = R.prefer_completed(rows, keys).where("status <> 'failed' or seed <> 3").join(first, ["panel", "model"], "left_anti")
    return R.finalize_model(best, rows.select(*keys).distinct())


@query("finalize_model", f"WITH {PANEL_SQL} SELECT * FROM final")
def finalize_model(spark, d):
    return rounded(finals(spark, d))


@query("publish_panel", f"WITH {PANEL_SQL} SELECT panel, count(*)::BIGINT AS n_models, bool_and(publishable) AS passed, sum(ok)::BIGINT AS ok, sum(failed)::BIGINT AS failed FROM final GROUP BY panel")
def publish_panel(spark, d):
    return R.publish_panel(finals(spark, d))


SHARD_SQL = f"""{views.CKPT_SQL}, job AS (SELECT model, seed, count(*) AS rows_expected, model || '-v1' AS expected_identity FROM ckpt GROUP BY ALL),
 man AS (SELECT model, seed, CASE WHEN seed = 1 AND model = (SELECT min(model) FROM ckpt) THEN 'other' ELSE model || '-v1' END AS identity, count(*) AS rows_written
   FROM ckpt WHERE seed <> 4 AND (seed <> 2 OR status = 'ok') GROUP BY ALL)"""


@query("diagnose_shards", f"""WITH {SHARD_SQL} SELECT model, seed, CASE WHEN identity IS NULL THEN 'missing' WHEN identity <> expected_identity THEN 'invalid'
 WHEN rows_written < rows_expected THEN 'incomplete' ELSE 'complete' END AS state FROM job LEFT JOIN man USING (model, seed)""")
def diagnose_shards(spark, d):
    rows = views.ckpt(spark, d)
    identity = F.concat(F.col("model"), F.lit("-v1"))
    jobs = rows.groupBy("model", "seed").agg(F.count(F.lit(1)).alias("rows_expected")).withColumn("expected_identity", identity)
    first = rows.agg(F.min("model").alias("_m"))
    kept = rows.where("seed <> 4 and (seed <> 2 or status = 'ok')").groupBy("model", "seed").agg(
        F.count(F.lit(1)).alias("rows_written"))
    found = kept.join(F.broadcast(first), (F.col("model") == F.col("_m")) & (F.col("seed") == 1), "left").select(
        "model", "seed", "rows_written", F.when(F.col("_m").isNotNull(), "other").otherwise(identity).alias("identity"))
    return R.diagnose_shards(jobs, found, ["model", "seed"])


@query("carry_forward", f"""WITH {views.CKPT_SQL}, cur AS (SELECT model, count(*)::BIGINT AS n_rows, CASE WHEN min(best_rounds) > 1 OR model < 'f' THEN NULL ELSE sum(fit_seconds) END AS fit_total FROM ckpt GROUP BY model),
 old AS (SELECT model, sum(fit_seconds) * 2 AS fit_total FROM ckpt GROUP BY model)
SELECT model, n_rows, {r('coalesce(cur.fit_total, old.fit_total)', 3)} AS fit_total FROM cur JOIN old USING (model)""")
def carry_forward(spark, d):
    rows = views.ckpt(spark, d)
    total = F.sum("fit_seconds")
    current = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.when((F.min("best_rounds") > 1) | (F.col("model") < "f"), None).otherwise(total).alias("fit_total"))
    prior = rows.groupBy("model").agg((total * 2).alias("fit_total"))
    return rounded(R.carry_forward(current, prior, "model", ["fit_total"]), 3)


PANELS = """panels AS (SELECT 'panel_' || s_suppkey AS panel, CASE s_suppkey % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'medium' WHEN 2 THEN 'timing_full' ELSE 'production' END AS preset,
  CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::INT END AS seed, CASE WHEN s_suppkey % 5 = 0 THEN 2 END AS n_draws FROM supplier),
 presets AS (SELECT * FROM (VALUES ('dev', 3, 3, 100), ('medium', 8, 8, 100), ('timing_full', 1, 1, 0), ('production', 100, 50, 0)) AS t(preset, pseeds, pdraws, pmax))"""


@query("resolve_panels", f"""WITH {PANELS} SELECT panel, preset, coalesce(seed, 777)::INT AS seed, pmax::INT AS max_n, 20::INT AS batch_size,
 (pseeds * coalesce(n_draws, pdraws))::BIGINT AS n_repeats, (coalesce(seed, 777) + pseeds - 1)::INT AS last_seed FROM panels JOIN presets USING (preset)""")
def resolve_panels(spark, d):
    key = F.col("s_suppkey")
    preset = F.when(key % 4 == 0, "dev").when(key % 4 == 1, "medium").when(key % 4 == 2, "timing_full").otherwise("production")
    panels = views.table(spark, d, "supplier").select(
        F.concat(F.lit("panel_"), key.cast("string")).alias("panel"), preset.alias("preset"),
        F.when(key % 3 == 0, key.cast("int")).alias("seed"), F.when(key % 5 == 0, 2).alias("n_draws"))
    resolved = R.resolve_panels(spark, panels, {"seed": 777})
    reps = R.panel_repeats(resolved).groupBy("panel").agg(
        F.count(F.lit(1)).alias("n_repeats"), F.max("seed").alias("last_seed"))
    return resolved.select("panel", "preset", "seed", "max_n", "batch_size").join(reps, "panel")


DONE_SQL = f"{DESIGN_SQL}, done AS (SELECT DISTINCT seed, draw, (['ols', 'ridge', 'xgboost', 'super_learner'])[1 + seq % 4] AS model, ([10, 100, 1000])[1 + k % 3]::INT AS n, ([1, 3, 5])[1 + k % 3]::INT AS k FROM ckpt WHERE status <> 'failed' AND rmse < 60)"


def done(spark, d):
    rows = views.ckpt(spark, d).where("status <> 'failed' and rmse < 60")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    return rows.select(
        "seed", "draw", pick(["ols", "ridge", "xgboost", "super_learner"], (F.col("seq") % 4).cast("int")).alias("model"),
        pick([10, 100, 1000], F.col("k") % 3).alias("n"), pick([1, 3, 5], F.col("k") % 3).alias("k")).distinct()


@query("pending_cells", f"WITH {DONE_SQL} SELECT model, seed, draw, n, k FROM design ANTI JOIN done USING (model, seed, draw, n, k)")
def pending_cells(spark, d):
    return J.pending(cells(spark, d), done(spark, d), CELLS).select(*CELLS)


@query("limit_pending", f"""WITH {DONE_SQL} SELECT model, seed, draw, n, k FROM design ANTI JOIN done USING (model, seed, draw, n, k)
 ORDER BY seed, draw, k, n, CASE model WHEN 'ols' THEN 0 WHEN 'ridge' THEN 1 WHEN 'xgboost' THEN 2 ELSE 3 END LIMIT 25""")
def limit_pending(spark, d):
    """``max_jobs``: the first 25 open cells in design order."""
    return J.pending(cells(spark, d), done(spark, d), CELLS).orderBy("design_pos").limit(25).select(*CELLS)


TASK_SQL = f"""{DONE_SQL}, tasks AS (SELECT seed, draw, n, k, CASE WHEN model = 'xgboost' THEN 'passthrough' ELSE 'imputed' END AS grp, list_sort(list(model)) AS models FROM design GROUP BY ALL)"""


def tasks(spark, d):
    t = D.execution_groups(cells(spark, d))
    return t.withColumn("row_id", D.row_digest("seed", "draw", "n", "k", "group"))


@query("expected_keys", f"WITH {TASK_SQL} SELECT unnest(models) AS model, seed, draw, n, k FROM tasks")
def expected_keys(spark, d):
    return J.expected_keys(tasks(spark, d))


@query("pending_groups", f"""WITH {TASK_SQL}, open AS (SELECT DISTINCT seed, draw, n, k, grp FROM (SELECT seed, draw, n, k, grp, unnest(models) AS model FROM tasks) ANTI JOIN done USING (model, seed, draw, n, k))
SELECT seed, draw, n, k, grp AS "group", models FROM tasks SEMI JOIN open USING (seed, draw, n, k, grp)""")
def pending_groups(spark, d):
    return J.pending_groups(tasks(spark, d), done(spark, d)).drop("row_id")


DIFF_SQL = f"""{DONE_SQL}, twice AS (SELECT model, seed, draw, n, k FROM done UNION ALL SELECT model, seed, draw, n, k FROM done WHERE seed = 1
  UNION ALL SELECT 'forest', seed, draw, n, k FROM done WHERE seed = 2 AND model = 'ols'),
 got AS (SELECT model, seed, draw, n, k, count(*) AS c FROM twice GROUP BY ALL),
 diff AS (SELECT model, seed, draw, n, k, 'missing' AS kind FROM design ANTI JOIN got USING (model, seed, draw, n, k)
  UNION ALL SELECT model, seed, draw, n, k, 'extra' FROM got ANTI JOIN design USING (model, seed, draw, n, k)
  UNION ALL SELECT model, seed, draw, n, k, 'duplicate' FROM got WHERE c > 1)"""


def twice(spark, d):
    x = done(spark, d).select(*CELLS)
    forest = x.where("seed = 2 and model = 'ols'").withColumn("model", F.lit("forest"))
    return x.unionByName(x.where("seed = 1")).unionByName(forest)


@query("design_completeness", f"WITH {DIFF_SQL} SELECT model, seed, draw, n, k, kind FROM diff")
def design_completeness(spark, d):
    return J.key_differences(cells(spark, d), twice(spark, d), CELLS)


@query("merge_shards", f"WITH {DIFF_SQL} SELECT kind, count(*)::BIGINT AS n FROM diff GROUP BY kind")
def merge_shards(spark, d):
    return R.merge_shards(twice(spark, d), cells(spark, d), CELLS)


@query("error_examples", f"WITH {DIFF_SQL} SELECT model, seed, draw, n, k, kind FROM diff ORDER BY kind, model, seed, draw, n, k LIMIT 3")
def error_examples(spark, d):
    """Three examples for an error message."""
    return J.key_differences(cells(spark, d), twice(spark, d), CELLS).orderBy("kind", *CELLS).limit(3)


@query("except_keys", f"WITH {DONE_SQL} SELECT model, seed, draw, n, k FROM design EXCEPT SELECT model, seed, draw, n, k FROM done")
def except_keys(spark, d):
    return cells(spark, d).select(*CELLS).subtract(done(spark, d).select(*CELLS))


@query("run_size", f"""WITH {DESIGN_SQL}, c AS (SELECT seed, count(*) AS cells, 24 * count_if(model = 'super_learner') AS stack_fits FROM design GROUP BY seed),
 w AS (SELECT *, ceil(cells / 20)::BIGINT AS wr FROM c)
SELECT seed, cells::BIGINT AS cells, stack_fits::BIGINT AS stack_fits, wr AS checkpoint_writes, wr // 50 + wr % 50 AS stable_parts,
 greatest(wr // 50 + wr % 50, CASE WHEN wr // 50 > 0 THEN wr // 50 + 50 ELSE wr END) AS peak_parts, least(20, cells)::BIGINT AS max_uncheckpointed FROM w""")
def run_size(spark, d):
    return R.run_size(cells(spark, d), ["seed"])


# ---- calibration: a timing per event, with n and k from the event ----------------
MEAS_SQL = """meas AS (SELECT event_id, event_type AS model, (10 * (1 + user_id % 5))::INT AS n, (1 + CAST(floor(value) AS INT) % 6)::INT AS k,
  0.01::DOUBLE * pow(1 + CAST(floor(value) AS INT) % 6, 1.2) * pow(10 * (1 + user_id % 5), 0.8) * (1 + (event_id % 7) / 100.0::DOUBLE) AS seconds,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS converged, CASE WHEN event_id % 2 = 0 THEN 'svd' ELSE 'cd' END AS solver, event_id % 50 AS n_iter FROM events)"""


def measures(spark, d):
    eid, v = F.col("event_id"), F.floor("value").cast("int")
    e = views.table(spark, d, "events").select(
        eid, F.col("event_type").alias("model"), (10 * (1 + F.col("user_id") % 5)).cast("int").alias("n"),
        (1 + v % 6).cast("int").alias("k"),
        F.when(eid % 4 == 0, None).otherwise(eid % 4 != 1).alias("converged"),
        F.when(eid % 2 == 0, "svd").otherwise("cd").alias("solver"), (eid % 50).alias("n_iter"))
    return e.withColumn("seconds", F.lit(0.01) * F.pow("k", F.lit(1.2)) * F.pow("n", F.lit(0.8)) * (1 + (eid % 7) / 100.0))


POINTS_SQL = "points AS (SELECT model, n, k, quantile_cont(seconds, 0.5) AS t FROM meas GROUP BY ALL)"
FITLAW_SQL = """logs AS (SELECT model, ln(t) AS y, ln(k::DOUBLE) AS u, ln(n::DOUBLE) AS w FROM points),
 mom AS (SELECT model, var_pop(u) AS uu, var_pop(w) AS ww, covar_pop(u, w) AS uw, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, var_pop(y) AS yy, avg(u) AS mu, avg(w) AS mw, avg(y) AS my, count(*) AS n_points FROM logs GROUP BY model),
 fit AS (SELECT *, my - a * mu - b * mw AS log_c FROM (SELECT *, (uy * ww - wy * uw) / (uu * ww - uw * uw) AS a, (wy * uu - uy * uw) / (uu * ww - uw * uw) AS b FROM mom WHERE n_points >= 3))"""


@query("rep_summary", f"WITH {MEAS_SQL} SELECT model, n, k, {r('min(seconds)')} AS min, {r('max(seconds)')} AS max, count(*)::BIGINT AS n_reps, {r('quantile_cont(seconds, 0.5)')} AS median FROM meas GROUP BY ALL")
def rep_summary(spark, d):
    return rounded(C.rep_summary(measures(spark, d), ["model", "n", "k"], "seconds"))


@query("telemetry_by_model_k", f"""WITH {MEAS_SQL} SELECT model, k, count(*)::BIGINT AS n_measurements, count(converged)::BIGINT AS converged_observed, count_if(converged)::BIGINT AS converged_true,
 count_if(NOT converged)::BIGINT AS converged_false, {r('count_if(converged) / count(converged)')} AS true_fraction, min(n_iter)::DOUBLE AS n_iter_min, {r('quantile_cont(n_iter, 0.5)')} AS n_iter_median, max(n_iter)::DOUBLE AS n_iter_max FROM meas GROUP BY ALL""")
def telemetry_by_model_k(spark, d):
    m = measures(spark, d)
    dist = C.telemetry(m, ["n_iter"]).select(
        "model", "k", F.col("min").alias("n_iter_min"), F.col("median").alias("n_iter_median"), F.col("max").alias("n_iter_max"))
    return rounded(C.convergence(m).join(dist, ["model", "k"]))


@query("telemetry_values", f"WITH {MEAS_SQL} SELECT model, k, 'solver' AS field, solver AS value, count(*)::BIGINT AS n FROM meas GROUP BY ALL UNION ALL SELECT model, k, 'n_iter', CAST(n_iter AS VARCHAR), count(*) FROM meas GROUP BY ALL")
def telemetry_values(spark, d):
    return C.telemetry_values(measures(spark, d), ["solver", "n_iter"])


@query("power_law_fit", f"""WITH {MEAS_SQL}, {POINTS_SQL}, {FITLAW_SQL}, res AS (SELECT model, y - (log_c + a * u + b * w) AS e FROM logs JOIN fit USING (model))
SELECT model, {r('any_value(log_c)')} AS log_c, {r('any_value(a)')} AS a, {r('any_value(b)')} AS b, any_value(n_points)::BIGINT AS n_points, {r('1 - avg(e * e) / any_value(yy)')} AS r2, {r('min(e)')} AS residual_min, {r('max(e)')} AS residual_max
FROM res JOIN fit USING (model) GROUP BY model""")
def power_law_fit(spark, d):
    return rounded(C.fit_power_law(measures(spark, d), ["model"], "seconds"))


@query("power_law_predict", f"WITH {MEAS_SQL}, {POINTS_SQL}, {FITLAW_SQL} SELECT model, n, k, {r('exp(log_c) * pow(k, a) * pow(n, b)')} AS predicted FROM (SELECT DISTINCT model, n, k FROM meas) JOIN fit USING (model)")
def power_law_predict(spark, d):
    m = measures(spark, d)
    pts = m.select("model", "n", "k").distinct()
    return rounded(C.predict_power_law(pts, C.fit_power_law(m, ["model"], "seconds"), ["model"]))


VALID_SQL = f"""{MEAS_SQL}, {POINTS_SQL}, {FITLAW_SQL}, pts AS (SELECT DISTINCT model, n, k, k <> 6 AS planned FROM meas),
 actual AS (SELECT model, n, k, CASE WHEN k = 1 THEN 3 * s ELSE s END AS seconds, n = 50 AS censored FROM (SELECT model, n, k, max(seconds) AS s FROM meas WHERE k <> 5 OR n <> 20 GROUP BY model, n, k)),
 val AS (SELECT model, n, k, exp(log_c) * pow(k, a) * pow(n, b) AS predicted, seconds, CASE WHEN NOT planned THEN 'not_measured' WHEN coalesce(censored, false) THEN 'censored' WHEN seconds IS NULL THEN 'missing' ELSE 'measured' END AS status
   FROM pts JOIN fit USING (model) LEFT JOIN actual USING (model, n, k))"""


def validated(spark, d):
    m = measures(spark, d)
    pts = m.select("model", "n", "k").distinct()
    predicted = C.predict_power_law(pts, C.fit_power_law(m, ["model"], "seconds"), ["model"])
    actual = m.where("k <> 5 or n <> 20").groupBy("model", "n", "k").agg(F.max("seconds").alias("s")).select(
        "model", "n", "k", F.when(F.col("k") == 1, F.col("s") * 3).otherwise(F.col("s")).alias("seconds"),
        (F.col("n") == 50).alias("censored"))
    return J.validation_rows(pts.withColumn("planned", F.col("k") != 6), predicted, actual, ["model", "n", "k"])


@query("validation_rows", f"WITH {VALID_SQL} SELECT model, n, k, {r('predicted')} AS predicted, CASE WHEN status = 'measured' THEN {r('seconds')} END AS actual, status, CASE WHEN status = 'measured' THEN {r('predicted / seconds')} END AS ratio FROM val")
def validation_rows(spark, d):
    return rounded(validated(spark, d))


@query("validation_band", f"WITH {VALID_SQL} SELECT model, count_if(status = 'measured')::BIGINT AS checked, count_if(status = 'measured' AND NOT predicted / seconds BETWEEN 0.5 AND 2.0)::BIGINT AS failing FROM val GROUP BY model")
def validation_band(spark, d):
    return C.validation_band(validated(spark, d), ["model"])


LAWS = "laws AS (SELECT * FROM (VALUES ('ols', -6.0, 1.0, 1.0), ('ridge', -5.0, 1.1, 1.0), ('xgboost', -4.0, 0.9, 0.7), ('super_learner', -2.0, 1.0, 1.1)) AS t(model, log_c, a, b))"


@query("task_cost_rollup", f"""WITH {TASK_SQL}, {LAWS}, x AS (SELECT seed, draw, n, k, grp, unnest(models) AS model FROM tasks),
 c AS (SELECT seed, draw, n, k, grp, sum(exp(log_c) * pow(k, a) * pow(n, b)) AS fits, max(exp(log_c + 10) * pow(k, a) * pow(n, b)) AS mem FROM x JOIN laws USING (model) GROUP BY ALL)
SELECT seed, draw, n, k, grp AS "group", {r("fits + CASE WHEN grp = 'passthrough' THEN exp(-8) * k * n ELSE exp(-7) * k * n END", 4)} AS cost_seconds, {r('mem', 2)} AS peak_bytes FROM c""")
def task_cost_rollup(spark, d):
    laws = spark.createDataFrame([("ols", -6.0, 1.0, 1.0), ("ridge", -5.0, 1.1, 1.0), ("xgboost", -4.0, 0.9, 0.7),
                                  ("super_learner", -2.0, 1.0, 1.1)], "model string, log_c double, a double, b double")
    pre = spark.createDataFrame([("passthrough", -8.0, 1.0, 1.0), ("imputed", -7.0, 1.0, 1.0)],
                                "mode string, log_c double, a double, b double")
    t = tasks(spark, d)
    cost = C.task_cost(t, laws, pre, laws.withColumn("log_c", F.col("log_c") + 10))
    return rounded(t.join(cost, "row_id").drop("row_id", "models"), 4, peak_bytes=2)


@query("load_balance", f"""WITH t AS (SELECT CASE WHEN event_id % 500 = 0 THEN -event_id ELSE user_id END AS chunk_id, CASE WHEN event_id % 500 = 0 THEN value * 100 ELSE value END AS est_cost FROM events),
 ch AS (SELECT chunk_id, sum(est_cost) AS cost, count(*) AS rows FROM t GROUP BY 1), per AS (SELECT ch.*, budget FROM ch, (SELECT unnest([600.0, 5000.0])::DOUBLE AS budget)),
 pk AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY cost) AS rn, count(*) OVER (PARTITION BY budget) AS c FROM per WHERE NOT (rows = 1 AND cost > budget)),
 q AS (SELECT budget, quantile_cont(cost, 0.5) AS p50, max(cost) FILTER (rn = ceil(c * 0.95)) AS p95 FROM pk GROUP BY budget)
SELECT budget, count(*)::BIGINT AS chunk_count, count_if(rows = 1 AND cost > budget)::BIGINT AS oversized_chunk_count, {r('any_value(p50)', 4)} AS p50, {r('any_value(p95)', 4)} AS p95, {r('any_value(p95 / p50)', 4)} AS p95_over_p50, any_value(p95 / p50) < 3 AS balanced
FROM per JOIN q USING (budget) GROUP BY budget""")
def load_balance(spark, d):
    eid, v = F.col("event_id"), F.col("value")
    big = eid % 500 == 0
    t = views.table(spark, d, "events").select(
        F.when(big, -eid).otherwise(F.col("user_id")).alias("chunk_id"), F.when(big, v * 100).otherwise(v).alias("est_cost"))
    return rounded(C.load_balance(t, [600.0, 5000.0]), 4)


@query("cv_argmin", f"""WITH s AS (SELECT event_type AS model, (event_id % 5) AS fold, CAST(user_id % 20 AS INT) AS alpha, floor(value / 25) AS score FROM events), m AS (SELECT model, alpha, round(avg(score), 12) AS mean_score FROM s GROUP BY ALL)
SELECT model, alpha, {r('mean_score')} AS mean_score FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_score, alpha) = 1""")
def cv_argmin(spark, d):
    s = views.table(spark, d, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 20).cast("int").alias("alpha"),
        F.floor(F.col("value") / 25).cast("double").alias("score"))
    return rounded(R.cv_argmin(s, ["model"], "alpha", "score"))


SKIP_SQL = f"""{views.CKPT_SQL}, g AS (SELECT model, seed, draw, n, k, count(*) AS n_train, count_if(rmse < 20) AS lo, count_if(rmse >= 20) AS hi, count_if(converged IS NULL) AS nulls FROM ckpt GROUP BY ALL),
 x AS (SELECT *, CASE seed WHEN 0 THEN 'ridge' WHEN 1 THEN 'super_learner' ELSE 'ols' END AS m, least(lo, hi) AS mc, (lo > 0)::INT + (hi > 0)::INT AS nc FROM g)"""


@query("skip_reasons", f"""WITH {SKIP_SQL} SELECT model, seed, draw, n, k,
 CASE WHEN nulls >= n_train THEN 'all_sources_unobserved' WHEN n_train < CASE m WHEN 'ridge' THEN 2 WHEN 'super_learner' THEN 5 ELSE 1 END THEN 'below_cv_floor' END AS regression,
 CASE WHEN nulls >= n_train THEN 'all_sources_unobserved' WHEN nc < 2 THEN 'single_class_training' WHEN m = 'super_learner' AND mc < 2 THEN 'class_too_small_for_stacking' END AS classification FROM x""")
def skip_reasons(spark, d):
    g = views.ckpt(spark, d).groupBy(*CELLS).agg(
        F.count(F.lit(1)).alias("n_train"), F.count_if(F.col("rmse") < 20).alias("lo"),
        F.count_if(F.col("rmse") >= 20).alias("hi"), F.count_if(F.col("converged").isNull()).alias("nulls"))
    m = F.when(F.col("seed") == 0, "ridge").when(F.col("seed") == 1, "super_learner").otherwise("ols")
    classes = (F.col("lo") > 0).cast("int") + (F.col("hi") > 0).cast("int")
    args = (F.col("n_train"), F.col("n_train"), F.col("nulls"), m, F.least("lo", "hi"), classes)
    return g.select(*CELLS, R.skip_reason(*args, "regression").alias("regression"),
                    R.skip_reason(*args, "classification").alias("classification"))


# ---- contracts -------------------------------------------------------------------
def viol(check: str, subject: str, example: str, n: str, source: str) -> str:
    return (f"SELECT '{check}' AS check_id, {subject} AS subject, CAST({example} AS VARCHAR) AS example, CAST({n} AS BIGINT) AS n FROM {source}")


@query("check_numeric", f"WITH {views.ARD_SQL} " + viol("infinite_value", "'x_acctbal'", "NULL", "count(*)", "ard WHERE row_id % 70 = 1 AND x_acctbal IS NOT NULL")
       + " UNION ALL " + viol("all_missing", "'o_month'", "NULL", "count(*)", "ard"))
def check_numeric(spark, d):
    rows = views.ard(spark, d)
    bad = rows.withColumn("x_acctbal", F.when((F.col("row_id") % 70 == 1) & F.col("x_acctbal").isNotNull(), float("inf")).otherwise(F.col("x_acctbal"))).withColumn(
        "o_month", F.lit(None).cast("double"))
    return V.check_numeric(bad, ["x_acctbal", "x_custkey", "o_month", "seg_0"])


@query("check_numeric_clean", f"WITH {views.ARD_SQL} SELECT 'x' AS check_id, 'x' AS subject, 'x' AS example, 1::BIGINT AS n, 1::BIGINT AS rows_checked FROM ard WHERE false UNION ALL SELECT 'clean', 'all', NULL, 0, count(*) FROM ard")
def check_numeric_clean(spark, d):
    rows = views.ard(spark, d)
    found = V.combine([V.check_numeric(rows, views.ARD_FEATURES), V.check_onehot(rows, views.ARD_SOURCES, "row_id"),
                       V.check_ordinal(rows, views.ARD_SOURCES)]).withColumn("rows_checked", F.lit(0).cast("bigint"))
    return found.unionByName(rows.agg(
        F.lit("clean").alias("check_id"), F.lit("all").alias("subject"), F.lit(None).cast("string").alias("example"),
        F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("rows_checked")))


@query("check_onehot", f"WITH {views.ARD_SQL} " + viol("illegal_onehot_state", "'segment'", "min(row_id)", "count(*)", "ard WHERE (row_id % 10 = 0 AND seg_0 IS NOT NULL) OR (row_id % 10 = 1 AND seg_0 = 0)")
       + " UNION ALL " + viol("illegal_onehot_state", "'priority'", "min(row_id)", "count(*)", "ard WHERE row_id % 10 = 2 AND pri_0 = 1"))
def check_onehot(spark, d):
    k = F.col("row_id") % 10
    bad = views.ard(spark, d).withColumn("seg_0", F.when(k == 0, None).when((k == 1) & F.col("seg_0").isNotNull(), 1.0).otherwise(F.col("seg_0"))).withColumn(
        "pri_1", F.when((k == 2) & (F.col("pri_0") == 1), 1.0).otherwise(F.col("pri_1")))
    return V.check_onehot(bad, views.ARD_SOURCES, "row_id")


@query("check_ordinal", f"WITH {views.ARD_SQL} " + viol("undeclared_ordinal_level", "'month'", "min(o_month + 12)", "count(*)", "ard WHERE o_month > 9"))
def check_ordinal(spark, d):
    m = F.col("o_month")
    return V.check_ordinal(views.ard(spark, d).withColumn("o_month", F.when(m > 9, m + 12).otherwise(m)), views.ARD_SOURCES)


@query("check_ids", "WITH a AS (SELECT CASE WHEN o_orderkey % 500 = 3 THEN NULL ELSE o_custkey END AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P') "
       + " UNION ALL ".join([
           viol("ids", "'null_train'", "NULL", "1", "(SELECT 1) WHERE EXISTS (SELECT 1 FROM a WHERE id IS NULL)"),
           viol("ids", "'duplicate_train'", "min(id)", "count(*)", "(SELECT id FROM a WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)"),
           viol("ids", "'duplicate_test'", "min(id)", "count(*)", "(SELECT id FROM b GROUP BY id HAVING count(*) > 1)"),
           viol("ids", "'overlap'", "min(id)", "count(*)", "(SELECT id FROM a INTERSECT SELECT id FROM b)")]))
def check_ids(spark, d):
    o = views.table(spark, d, "orders")
    train = o.where("o_orderstatus = 'F'").select(F.when(F.col("o_orderkey") % 500 != 3, F.col("o_custkey")).alias("id"))
    return V.check_ids(train, o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "id")


@query("outcome_missing_ratio", f"WITH {views.ARD_SQL} SELECT y_bin, count(*)::BIGINT AS n_rows, count(y)::BIGINT AS n_observed, {r('avg((y IS NULL)::INT)')} AS missing_ratio FROM ard GROUP BY y_bin")
def outcome_missing_ratio(spark, d):
    return rounded(V.outcome_stats(views.ard(spark, d), "y", ["y_bin"]).select("y_bin", "n_rows", "n_observed", "missing_ratio"))


@query("class_counts", "SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def class_counts(spark, d):
    return views.table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("check_outcome", f"WITH {views.ARD_SQL} " + viol("outcome", "'missing_ratio'", "round(avg((y IS NULL OR row_id % 3 <> 0)::INT), 9)", "count_if(y IS NULL OR row_id % 3 <> 0)", "ard")
       + " UNION ALL " + viol("outcome", "'n_not_binary'", "NULL", "count_if(y IS NOT NULL AND row_id % 3 = 0)", "ard"))
def check_outcome(spark, d):
    rows = views.ard(spark, d).withColumn("y", F.when(F.col("row_id") % 3 == 0, F.col("y")))
    return V.check_outcome(rows, "y", "classification")


@query("check_category_coverage", f"WITH {views.ARD_SQL} " + viol("category_coverage", "'month'", "min(m)", "count(*)", "(SELECT o_month AS m FROM ard WHERE x_custkey >= 500 AND (o_month = 12 OR o_month = 1))"))
def check_category_coverage(spark, d):
    rows = views.ard(spark, d).select(F.lit("month").alias("source"), F.col("o_month").alias("state"), "x_custkey")
    train = rows.where("x_custkey < 500 and state not in (1, 12)")
    return V.check_coverage(train, rows.where("x_custkey >= 500"), "source", "state", "category_coverage")


@query("check_class_coverage", viol("class_coverage", "'quality'", "0", "count(*)", "labels WHERE doc_id % 2 = 1 AND quality = 0"))
def check_class_coverage(spark, d):
    rows = views.table(spark, d, "labels").select(F.lit("quality").alias("outcome"), F.col("quality").alias("cls"), "doc_id")
    train = rows.where("doc_id % 2 = 0 and cls = 1")
    return V.check_coverage(train, rows.where("doc_id % 2 = 1"), "outcome", "cls", "class_coverage")


FLOOR_SQL = f"""{views.CKPT_SQL}, g AS (SELECT CAST(model AS VARCHAR) || '/' || seed AS s, count(*) AS c, count_if(status = 'ok') AS o, count_if(status <> 'ok') AS nok FROM ckpt GROUP BY model, seed)"""


@query("check_row_floor", f"WITH {FLOOR_SQL} " + viol("row_floor", "s", "c", "450 - c", "g WHERE c < 450") + " UNION ALL "
       + viol("class_floor", "s", "least(o, nok)", "5 - least(o, nok)", "g WHERE least(o, nok) < 5"))
def check_row_floor(spark, d):
    rows = views.ckpt(spark, d).withColumn("label", (F.col("status") == "ok").cast("int"))
    return V.check_row_floor(rows, ["model", "seed"], ["ridge", "super_learner"], 450, "label")


# Manifest of one source per customer with planted faults.
MAN_SQL = """man AS (SELECT 'c' || c_custkey AS source_column, CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey END AS source_order, f AS feature_order,
  CASE WHEN c_custkey % 60 = 7 AND f = 1 THEN 'ordinal' ELSE 'onehot_group' END AS unit_type, f = 0 AND c_custkey % 40 <> 9 AS is_reference,
  CASE WHEN c_custkey % 70 = 5 THEN 'same' ELSE 'l' || f END AS level_value FROM customer, (SELECT unnest([0, 1]) AS f))"""


def planted_manifest(spark, d):
    key, f = F.col("c_custkey"), F.col("feature_order")
    rows = views.table(spark, d, "customer").select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("feature_order"))
    return rows.select(
        F.concat(F.lit("c"), key).alias("source_column"), F.when(key % 50 == 0, 0).otherwise(key).cast("int").alias("source_order"),
        "feature_order", F.when((key % 60 == 7) & (f == 1), "ordinal").otherwise("onehot_group").alias("unit_type"),
        F.lit(False).alias("drop_first"), ((f == 0) & (key % 40 != 9)).alias("is_reference"),
        F.when(key % 70 == 5, "same").otherwise(F.concat(F.lit("l"), f)).alias("level_value"), F.lit("l0").alias("reference_level"))


def fault(name: str, cond: str) -> str:
    return viol("manifest", f"'{name}'", "min('c' || c_custkey)", "count(*)", f"customer WHERE {cond}")


@query("check_manifest", f"WITH {MAN_SQL} " + " UNION ALL ".join([
    fault("unit_type_differs", "c_custkey % 60 = 7"), fault("single_feature_expected", "c_custkey % 60 = 7"),
    fault("reference_count", "c_custkey % 40 = 9"), fault("level_repeated", "c_custkey % 70 = 5"),
    fault("reference_mismatch", "c_custkey % 70 = 5 AND c_custkey % 40 <> 9"),
    viol("manifest", "'source_order_shared'", "min('c' || c_custkey)", "1", "customer WHERE c_custkey % 50 = 0")]))
def check_manifest(spark, d):
    return V.check_manifest(planted_manifest(spark, d))


@query("check_disjoint_features", viol("shared_feature", "'f' || (c_custkey % 700)", "min('c' || c_custkey)", "count(*)", "customer GROUP BY c_custkey % 700 HAVING count(*) > 1"))
def check_disjoint_features(spark, d):
    m = views.table(spark, d, "customer").select(
        F.concat(F.lit("f"), F.col("c_custkey") % 700).alias("feature_name"), F.concat(F.lit("c"), F.col("c_custkey")).alias("source_column"))
    return V.check_disjoint_features(m)


@query("check_universe", "WITH a AS (SELECT DISTINCT o_custkey AS s, o_orderpriority AS f FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT DISTINCT o_custkey AS s, o_orderpriority AS f FROM orders WHERE o_orderstatus <> 'F') "
       + viol("universe", "'missing'", "min(s || '/' || f)", "count(*)", "(SELECT * FROM a EXCEPT SELECT * FROM b)") + " UNION ALL "
       + viol("universe", "'extra'", "min(s || '/' || f)", "count(*)", "(SELECT * FROM b EXCEPT SELECT * FROM a)"))
def check_universe(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("f"), "o_orderstatus")
    return V.check_universe(o.where("o_orderstatus <> 'P'").select("s", "f").distinct(),
                            o.where("o_orderstatus <> 'F'").select("s", "f").distinct(), ["s", "f"])


@query("check_checkpoint_rows", f"WITH {views.CKPT_SQL} " + " UNION ALL ".join([
    viol("checkpoint_row", "'unknown_status'", "min(seq)", "count(*)", "ckpt WHERE seq % 11 = 0"),
    viol("checkpoint_row", "'not_integer_seed'", "min(seq)", "count(*)", "ckpt WHERE seq % 13 = 0"),
    viol("checkpoint_row", "'empty_model'", "min(seq)", "count(*)", "ckpt WHERE seq % 17 = 0")]))
def check_checkpoint_rows(spark, d):
    s = F.col("seq")
    bad = views.ckpt(spark, d).withColumn("status", F.when(s % 11 == 0, "done").otherwise(F.col("status"))).withColumn(
        "seed", F.when(s % 13 == 0, "1.5").otherwise(F.col("seed").cast("string"))).withColumn(
        "model", F.when(s % 17 == 0, " ").otherwise(F.col("model")))
    return V.check_checkpoint_rows(bad)


@query("check_repeat_plan", f"WITH {views.CKPT_SQL} SELECT 'repeat_plan' AS check_id, 'repeated' AS subject, min(seed || '/' || draw) AS example, count(*)::BIGINT AS n FROM (SELECT seed, draw FROM ckpt GROUP BY ALL HAVING count(*) > 1)"
       + " UNION ALL " + viol("repeat_plan", "'incomplete_seed'", "min(seed)", "count(*)", "(SELECT seed FROM ckpt GROUP BY seed HAVING count(DISTINCT draw) < 5)"))
def check_repeat_plan(spark, d):
    return V.check_repeat_plan(views.ckpt(spark, d).select("seed", "draw"), 5)


@query("contract_diff", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'identity.code.version' ELSE 'rows' END AS path,
 CASE WHEN event_id % 3 = 0 THEN 'v1' ELSE CAST(user_id AS VARCHAR) END AS left_value, CASE WHEN event_id % 3 = 0 THEN 'v2' ELSE CAST(user_id + 1 AS VARCHAR) END AS right_value,
 ((event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT)::BIGINT AS n_paths FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0""")
def contract_diff(spark, d):
    e = views.table(spark, d, "events")

    def document(version, rows):
        return e.select("event_id", F.to_json(F.struct(
            F.struct(F.col("event_type").alias("model"), F.struct(version.alias("version")).alias("code")).alias("identity"),
            rows.cast("string").alias("rows"))).alias("doc"))

    eid, user = F.col("event_id"), F.col("user_id")
    left = V.flatten_paths(document(F.lit("v1"), user), "event_id", "doc")
    right = V.flatten_paths(document(F.when(eid % 3 == 0, "v2").otherwise("v1"), F.when(eid % 5 == 0, user + 1).otherwise(user)), "event_id", "doc")
    return V.contract_diff(left, right, "event_id")


@query("manifest_faults", f"""WITH {views.CKPT_SQL}, s AS (SELECT DISTINCT CASE WHEN seed < 3 THEN 'early' ELSE 'late' END AS panel, model, seed FROM ckpt), f AS (SELECT min(model) AS first FROM ckpt)
SELECT panel, model, 'missing_shard' AS fault, '4' AS example FROM s WHERE seed = 4
UNION ALL SELECT 'early', first, 'contract', 'code.version' FROM f
UNION ALL SELECT 'early', NULL, 'panel_contract', 'code.version'
UNION ALL SELECT 'late', NULL, 'header', 'model,rmse'""")
def manifest_faults(spark, d):
    """Planted: no shard of seed 4, another version in one shard of a model, another header in one panel."""
    panel = F.when(F.col("seed") < 3, "early").otherwise("late")
    rows = views.ckpt(spark, d).withColumn("panel", panel)
    expected = rows.select("panel", "model", "seed").distinct()
    first = rows.agg(F.min("model").alias("_first"))  # one row
    odd = (F.col("model") == F.col("_first")) & (F.col("seed") == 1)
    version = F.when(odd, "v2").otherwise("v1")
    grid = F.struct(F.lit("10,100").alias("n_grid"), F.lit("1,3").alias("k_grid"))
    contract = F.to_json(F.struct(F.col("model").alias("model"), F.struct(version.alias("version")).alias("code"), grid.alias("design")))
    header = F.when((F.col("panel") == "late") & (F.col("model") == F.col("_first")), F.array(F.lit("model"), F.lit("rmse"))).otherwise(F.array(F.lit("model"), F.lit("rmse"), F.lit("seed")))
    shards = expected.where("seed <> 4").join(F.broadcast(first)).select("panel", "model", "seed", contract.alias("contract"), header.alias("header"))
    return PB.manifest_faults(shards, expected)
