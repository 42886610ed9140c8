"""Sampling, imputation and sweep queries over ``ard``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog.registry import query, r, rounded
from tidemark.functions.ordered import seed_hash
from tidemark.operators import design as D
from tidemark.operators import impute as I
from tidemark.plans import sweep as S

SEEDS, DRAWS, TEST_SIZE, N_SIZES, MIN_N = [11, 22], [0, 1], 0.2, 4, 10
K_GRID = [1, 3, 5]
BY = S.BY

SPLIT_SQL = f"""{views.ARD_SQL},
 obs AS (SELECT * FROM ard WHERE y IS NOT NULL),
 tot AS (SELECT count(*) AS n_all, ceil(count(*) * {TEST_SIZE})::BIGINT AS n_test FROM obs),
 seeds AS (SELECT unnest([11, 22])::INT AS seed), draws AS (SELECT unnest([0, 1])::INT AS draw),
 split AS (SELECT o.*, seed, CASE WHEN row_number() OVER (PARTITION BY seed
     ORDER BY md5(concat_ws('|', seed, 't', row_id)), row_id) <= n_test THEN 'test' ELSE 'train' END AS role
   FROM obs o, seeds, tot)"""
CELLS_SQL = f"""{SPLIT_SQL},
 ranked AS (SELECT split.*, draw, row_number() OVER (PARTITION BY seed, draw
     ORDER BY md5(concat_ws('|', seed, draw, 'r', row_id)), row_id) AS rk
   FROM split, draws WHERE role = 'train'),
 grid AS (SELECT DISTINCT greatest({MIN_N}, least(n_all - n_test, CAST(round_even(round(
     pow(2, log2({MIN_N}) + (log2(n_all - n_test) - log2({MIN_N})) * i / {N_SIZES - 1}.0::DOUBLE), 9), 0) AS BIGINT)))::INT AS n
   FROM tot, (SELECT unnest(range(0, {N_SIZES})) AS i)),
 cells AS (SELECT ranked.*, n FROM ranked JOIN grid ON rk <= n)"""


def sample(spark, d, columns=None) -> S.Sample:
    rows = views.ard(spark, d)
    rows = rows.select("row_id", "y", *(columns or views.ARD_FEATURES))
    return S.sample_rows(rows, "y", SEEDS, DRAWS, TEST_SIZE, N_SIZES, MIN_N)


def array_sample(spark, d, sources=views.ARD_SOURCES) -> S.Sample:
    """Rows of all sources, or of those that a query reads."""
    features = D.feature_names(sources)
    rows = I.assemble(views.ard(spark, d).select("row_id", "y", *features), features)
    return S.sample_rows(rows, "y", SEEDS, DRAWS, TEST_SIZE, N_SIZES, MIN_N)


@query("sweep_baseline", f"""WITH {CELLS_SQL},
 fills AS (SELECT seed, draw, n, quantile_cont(x_acctbal, 0.5) AS fill FROM cells GROUP BY ALL),
 fit AS (SELECT seed, draw, n, regr_slope(y, coalesce(x_acctbal, fill)) AS slope,
   regr_intercept(y, coalesce(x_acctbal, fill)) AS intercept, avg(y) AS tm, max(fill) AS fill
   FROM cells JOIN fills USING (seed, draw, n) GROUP BY ALL),
 p AS (SELECT seed, draw, n, y, intercept + slope * coalesce(x_acctbal, fill) AS yhat, tm, slope, intercept
   FROM split JOIN fit USING (seed) WHERE role = 'test')
SELECT seed, draw, n, count(*)::BIGINT AS n_test, {r('max(slope)', 4)} AS slope, {r('max(intercept)', 2)} AS intercept,
 {r('1 - avg(pow(y - yhat, 2)) / avg(pow(y - tm, 2))')} AS r2_test, {r('sqrt(avg(pow(y - yhat, 2)))', 3)} AS rmse,
 {r('avg(abs(y - yhat))', 3)} AS mae FROM p GROUP BY ALL""")
def sweep_baseline(spark, d):
    df = S.baseline_sweep(views.ard(spark, d), "y", "x_acctbal", SEEDS, DRAWS,
                          test_size=TEST_SIZE, n_sizes=N_SIZES, min_n=MIN_N)
    return rounded(df, slope=4, intercept=2, rmse=3, mae=3)


@query("ols_univariate", f"""WITH {CELLS_SQL},
 fills AS (SELECT seed, draw, n, quantile_cont(x_acctbal, 0.5) AS fill FROM cells GROUP BY ALL)
SELECT seed, draw, n, {r('max(fill)', 4)} AS fill, {r('avg(y)', 2)} AS train_mean,
 {r('regr_slope(y, coalesce(x_acctbal, fill))', 4)} AS slope,
 {r('regr_intercept(y, coalesce(x_acctbal, fill))', 2)} AS intercept
FROM cells JOIN fills USING (seed, draw, n) GROUP BY ALL""")
def ols_univariate(spark, d):
    s = sample(spark, d, ["x_acctbal"])
    return rounded(S.univariate_fit(s.train, BY, "y", "x_acctbal", s.n_cells),
                   4, train_mean=2, intercept=2)


@query("split_random", f"WITH {SPLIT_SQL} SELECT seed, role, row_id FROM split")
def split_random(spark, d):
    rows = views.ard(spark, d).where(F.col("y").isNotNull())
    return D.split_random(rows, SEEDS, TEST_SIZE).select("seed", "role", "row_id")


@query("split_stratified", f"""WITH {views.ARD_SQL},
 cls AS (SELECT y_bin, count(*) AS c FROM ard GROUP BY y_bin),
 quota AS (SELECT y_bin, floor(c * {TEST_SIZE}) + CASE WHEN row_number() OVER (ORDER BY round(c * {TEST_SIZE} - floor(c * {TEST_SIZE}), 9) DESC, y_bin)
   <= ceil(sum(c) OVER () * {TEST_SIZE}) - sum(floor(c * {TEST_SIZE})) OVER () THEN 1 ELSE 0 END AS q FROM cls),
 seeds AS (SELECT unnest([11, 22])::INT AS seed)
SELECT seed, y_bin, row_id, CASE WHEN row_number() OVER (PARTITION BY seed, y_bin
  ORDER BY md5(concat_ws('|', seed, 't', row_id)), row_id) <= q THEN 'test' ELSE 'train' END AS role
FROM ard JOIN quota USING (y_bin), seeds""")
def split_stratified(spark, d):
    rows = views.ard(spark, d)
    return D.split_stratified(rows, SEEDS, TEST_SIZE, "y_bin").select("seed", "y_bin", "row_id", "role")


@query("split_external", f"""WITH {views.ARD_SQL}
SELECT row_id, CASE WHEN x_custkey < 500 THEN 'train' ELSE 'test' END AS role, {r('y', 2)} AS y FROM ard WHERE y IS NOT NULL""")
def split_external(spark, d):
    rows = views.ard(spark, d)
    early = F.col("x_custkey") < 500
    out = D.split_external(rows.where(early), rows.where(~early), "y")
    return rounded(out.select("row_id", "role", "y"), 2)


@query("row_permutation", f"""WITH {CELLS_SQL} SELECT seed, draw, row_id, rk FROM ranked""")
def row_permutation(spark, d):
    rows = views.ard(spark, d).where(F.col("y").isNotNull())
    train = D.split_random(rows, SEEDS, TEST_SIZE).where(F.col("role") == "train")
    return D.row_ranks(train, DRAWS).select("seed", "draw", "row_id", "rk")


@query("nested_prefix_sample", f"""WITH {CELLS_SQL}
SELECT seed, draw, n, count(*)::BIGINT AS n_rows, sum(row_id)::BIGINT AS id_sum, {r('avg(y)', 3)} AS mean_y
FROM cells GROUP BY ALL""")
def nested_prefix_sample(spark, d):
    s = sample(spark, d)
    return rounded(s.train.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("id_sum"), F.avg("y").alias("mean_y")), 3)


@query("band_accumulate", f"""WITH {CELLS_SQL}
SELECT seed, draw, n, count(x_acctbal)::BIGINT AS seen, {r('sum(x_acctbal)', 2)} AS total FROM cells GROUP BY ALL""")
def band_accumulate(spark, d):
    """Additive statistics of nested samples without repeating a row per N."""
    rows = views.ard(spark, d).where(F.col("y").isNotNull())
    grid = sample(spark, d, ["x_acctbal"]).n_grid
    train = D.split_random(rows, SEEDS, TEST_SIZE).where(F.col("role") == "train")
    banded = D.band(D.row_ranks(train, DRAWS, limit=max(grid)), grid)
    return rounded(S.accumulate_bands(
        banded.groupBy("seed", "draw", "band").agg(
            F.count("x_acctbal").alias("seen"), F.sum("x_acctbal").alias("total")),
        ["seed", "draw"], ["seen", "total"]), 2)


NAMES = "['acctbal', 'custkey', 'month', 'segment', 'priority']"
PAIRS_SQL = f"""{views.CKPT_SQL}, pairs AS (SELECT DISTINCT seed, draw FROM ckpt),
 srank AS (SELECT seed, draw, source, row_number() OVER (PARTITION BY seed, draw
   ORDER BY md5(concat_ws('|', seed, draw, 's', source)), source) AS srk
  FROM pairs, (SELECT unnest({NAMES}) AS source))"""


def pairs(spark, d):
    return views.ckpt(spark, d).select("seed", "draw").distinct()


def ranked_sources(spark, d):
    return D.source_ranks(pairs(spark, d), [s.name for s in views.ARD_SOURCES])


@query("source_permutation", f"WITH {PAIRS_SQL} SELECT seed, draw, source, srk FROM srank")
def source_permutation(spark, d):
    return ranked_sources(spark, d)


FEATURES_SQL = "(VALUES ('acctbal', 'x_acctbal'), ('custkey', 'x_custkey'), ('month', 'o_month'), ('segment', 'seg_0'), ('segment', 'seg_1'), ('segment', 'seg_2'), ('priority', 'pri_0'), ('priority', 'pri_1')) AS f(source, feature)"


def manifest_sources(spark):
    return spark.createDataFrame([(s.name, s.features) for s in views.ARD_SOURCES],
                                 "source string, features array<string>")


@query("expand_sources", f"""WITH {PAIRS_SQL} SELECT seed, draw, k, source, srk, feature FROM srank JOIN {FEATURES_SQL} USING (source)
 JOIN (SELECT unnest([1, 3, 5])::INT AS k) ON srk <= k""")
def expand_sources(spark, d):
    return D.expand_sources(ranked_sources(spark, d), manifest_sources(spark), K_GRID)


@query("repeat_pairs", f"WITH {views.CKPT_SQL} SELECT DISTINCT seed, draw FROM ckpt")
def repeat_pairs(spark, d):
    return pairs(spark, d)


@query("repeats_by_seed", f"WITH {views.CKPT_SQL} SELECT seed, list_sort(list(DISTINCT draw)) AS draws FROM ckpt GROUP BY seed")
def repeats_by_seed(spark, d):
    return D.repeats_by_seed(pairs(spark, d))


MODELS = ["ols", "ridge", "xgboost", "super_learner"]
DESIGN_SQL = f"""{views.CKPT_SQL}, pairs AS (SELECT DISTINCT seed, draw FROM ckpt),
 design AS (SELECT seed, draw, model, n, k FROM pairs, (SELECT unnest([10, 100, 1000])::INT AS n),
  (SELECT unnest([1, 3, 5])::INT AS k), (SELECT unnest(['ols', 'ridge', 'xgboost', 'super_learner']) AS model))"""


def cells(spark, d):
    return D.design_cells(pairs(spark, d), MODELS, [10, 100, 1000], K_GRID)


@query("design_cross", f"WITH {DESIGN_SQL} SELECT * FROM design")
def design_cross(spark, d):
    return cells(spark, d).drop("design_pos")


@query("execution_groups", f"""WITH {DESIGN_SQL}
SELECT seed, draw, n, k, CASE WHEN model = 'super_learner' AND k >= 3 THEN model WHEN model = 'xgboost' THEN 'passthrough' ELSE 'imputed' END AS "group",
 list_sort(list(model)) AS models FROM design GROUP BY ALL""")
def execution_groups(spark, d):
    return D.execution_groups(cells(spark, d), 3)


GRID_SQL = """SELECT nation, CAST(total AS BIGINT) AS total, list_sort(list(DISTINCT greatest(1, least(total, CAST(round_even(round(pow(2, log2(total) * i / 9.0::DOUBLE), 9), 0) AS BIGINT))))) AS sizes
FROM (SELECT c_nationkey AS nation, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), (SELECT unnest(range(0, 10)) AS i) GROUP BY ALL"""


@query("log2_grid", GRID_SQL)
def log2_grid(spark, d):
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    totals = (o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"))
              .agg(F.count(F.lit(1)).alias("total")))
    return totals.withColumn("sizes", D.log2_grid(F.col("total"), 10))


KEY5 = "seed, draw, n, k"


@query("cell_seed", f"WITH {views.CKPT_SQL} SELECT DISTINCT {KEY5}, CAST(('0x' || substr(md5(concat_ws(',', {KEY5})), 1, 8)) AS BIGINT) AS model_seed FROM ckpt")
def cell_seed(spark, d):
    keys = ["seed", "draw", "n", "k"]
    df = views.ckpt(spark, d).select(*keys).distinct()
    return df.withColumn("model_seed", D.cell_seed(*[F.col(c) for c in keys]))


@query("row_id_hash", f"WITH {views.CKPT_SQL} SELECT seq, substr(sha256(concat_ws(',', {KEY5}, model)), 1, 24) AS row_hash FROM ckpt")
def row_id_hash(spark, d):
    df = views.ckpt(spark, d)
    return df.select("seq", D.row_digest("seed", "draw", "n", "k", "model").alias("row_hash"))


FOLD = """CASE WHEN pos - 1 < (c % 5) * (c // 5 + 1) THEN (pos - 1) // (c // 5 + 1)
  ELSE c % 5 + (pos - 1 - (c % 5) * (c // 5 + 1)) // (c // 5) END"""


@query("kfold_contiguous", f"""WITH {views.ARD_SQL}, p AS (SELECT y_bin, row_id,
 row_number() OVER (PARTITION BY y_bin ORDER BY row_id) AS pos, count(*) OVER (PARTITION BY y_bin) AS c FROM ard)
SELECT y_bin, row_id, CAST({FOLD} AS INT) AS fold FROM p""")
def kfold_contiguous(spark, d):
    rows = views.ard(spark, d).select("y_bin", "row_id")
    return D.kfold_contiguous(rows, ["y_bin"], "row_id", 5)


@query("kfold_shuffled", f"""WITH {views.ARD_SQL}, p AS (SELECT y_bin, row_id,
 row_number() OVER (PARTITION BY y_bin ORDER BY md5(concat_ws('|', 7, 'f', row_id)), row_id) AS pos, count(*) OVER (PARTITION BY y_bin) AS c FROM ard)
SELECT y_bin, row_id, CAST({FOLD} AS INT) AS fold FROM p""")
def kfold_shuffled(spark, d):
    rows = views.ard(spark, d).select("y_bin", "row_id")
    return D.kfold_shuffled(rows, ["y_bin"], seed_hash(7, "f", F.col("row_id")), "row_id", 5)


def _units(spark, d, kind):
    """Units of the sources of one kind, in rows that hold no others; ``src`` counts all sources."""
    own = [i for i, s in enumerate(views.ARD_SOURCES) if s.unit_type == kind]
    sources = [views.ARD_SOURCES[i] for i in own]
    long = I.units(array_sample(spark, d, sources).train, BY, sources)
    return long.withColumn("src", F.element_at(F.array(*[F.lit(i) for i in own]), F.col("src") + 1))


def _named(df):
    names = F.array(*[F.lit(s.name) for s in views.ARD_SOURCES])
    return df.withColumn("source", F.element_at(names, F.col("src") + 1)).drop("src")


def _cont_sql(stat: str) -> str:
    one = "SELECT seed, draw, n, '{name}' AS source, " + r(stat, 4) + " AS fill FROM cells GROUP BY ALL"
    parts = [one.format(name=n).replace("COL", c) for n, c in (("acctbal", "x_acctbal"), ("custkey", "x_custkey"))]
    return f"WITH {CELLS_SQL} " + " UNION ALL ".join(parts)


@query("impute_median", _cont_sql("quantile_cont(COL, 0.5)"))
def impute_median(spark, d):
    return rounded(_named(I.fit_continuous(_units(spark, d, "continuous"), BY)), 4)


@query("impute_mean", _cont_sql("avg(COL)"))
def impute_mean(spark, d):
    return rounded(_named(I.fit_continuous(_units(spark, d, "continuous"), BY, "mean")), 4)


ORD_SQL = """SELECT seed, draw, n, o_month AS v, count(*) AS c FROM cells WHERE o_month IS NOT NULL GROUP BY ALL"""
MODE_SQL = f"SELECT seed, draw, n, v AS fill FROM ({ORD_SQL}) QUALIFY row_number() OVER (PARTITION BY seed, draw, n ORDER BY c DESC, v) = 1"


@query("ordinal_mode", f"WITH {CELLS_SQL} {MODE_SQL}")
def ordinal_mode(spark, d):
    return I.fit_ordinal(_units(spark, d, "ordinal"), BY, views.ARD_SOURCES).drop("src")


@query("ordinal_median_snap", f"""WITH {CELLS_SQL}, med AS (SELECT seed, draw, n, quantile_cont(o_month, 0.5) AS m FROM cells GROUP BY ALL)
SELECT seed, draw, n, v AS fill FROM ({ORD_SQL}) JOIN med USING (seed, draw, n)
 QUALIFY row_number() OVER (PARTITION BY seed, draw, n ORDER BY abs(v - m), v) = 1""")
def ordinal_median_snap(spark, d):
    return I.fit_ordinal(_units(spark, d, "ordinal"), BY, views.ARD_SOURCES, "median").drop("src")


SEG_STATE = "CASE WHEN seg_0 IS NULL AND seg_1 IS NULL AND seg_2 IS NULL THEN NULL WHEN seg_0 = 1 THEN 0 WHEN seg_1 = 1 THEN 1 ELSE 2 END"
PRI_STATE = "CASE WHEN pri_0 IS NULL AND pri_1 IS NULL THEN NULL WHEN pri_0 = 1 THEN 0 WHEN pri_1 = 1 THEN 1 ELSE -1 END"


def _state_mode(name: str, state: str) -> str:
    return f"""SELECT seed, draw, n, '{name}' AS source, CAST(st AS DOUBLE) AS fill FROM (SELECT seed, draw, n, {state} AS st, count(*) AS c FROM cells GROUP BY ALL)
 WHERE st IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seed, draw, n ORDER BY c DESC, st) = 1"""


@query("onehot_mode", f"WITH {CELLS_SQL} {_state_mode('segment', SEG_STATE)} UNION ALL {_state_mode('priority', PRI_STATE)}")
def onehot_mode(spark, d):
    return _named(I.fit_onehot(_units(spark, d, "onehot_group"), BY))


FITS = [("acctbal", "x_acctbal"), ("custkey", "x_custkey")]
FIT_SQL = " UNION ALL ".join(
    [f"SELECT seed, draw, n, '{n}' AS source, quantile_cont({c}, 0.5) AS fill FROM cells GROUP BY ALL" for n, c in FITS]
    + [f"SELECT seed, draw, n, 'month' AS source, fill FROM ({MODE_SQL})",
       f"SELECT * FROM ({_state_mode('segment', SEG_STATE)})", f"SELECT * FROM ({_state_mode('priority', PRI_STATE)})"])


@query("impute_fit", f"WITH {CELLS_SQL}, fit AS ({FIT_SQL}) SELECT seed, draw, n, source, {r('fill', 4)} AS fill, fill IS NOT NULL AS observed FROM fit")
def impute_fit(spark, d):
    s = array_sample(spark, d)
    return rounded(_named(I.fit_fills(s.train, BY, views.ARD_SOURCES)), 4)


FILLS_CTE = f"""fit AS ({FIT_SQL}),
 f AS (SELECT seed, draw, n, {', '.join(f"max(fill) FILTER (source = '{s}') AS f_{s}" for s in ('acctbal', 'custkey', 'month', 'segment', 'priority'))} FROM fit GROUP BY ALL)"""


def _wide(df):
    return df.select(*[c for c in df.columns if c != "x"],
                     *[F.col("x")[i].alias(c) for i, c in enumerate(views.ARD_FEATURES)])


def _oh(feature: str, state: int, group: str, cols: list[str]) -> str:
    missing = " AND ".join(f"{c} IS NULL" for c in cols)
    return f"CASE WHEN {missing} THEN CASE WHEN f_{group} = {state} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {feature} END AS {feature}"


SEG, PRI = ["seg_0", "seg_1", "seg_2"], ["pri_0", "pri_1"]
APPLY_COLS = ", ".join(
    ["coalesce(x_acctbal, f_acctbal) AS x_acctbal", "coalesce(x_custkey, f_custkey) AS x_custkey",
     "coalesce(o_month, f_month) AS o_month"]
    + [_oh(c, i, "segment", SEG) for i, c in enumerate(SEG)]
    + [_oh(c, i, "priority", PRI) for i, c in enumerate(PRI)])


def _filled(s, rows, passthrough=False):
    fit = I.fit_seen if passthrough else I.fit_fills  # what passes through takes no fills
    packed = I.pack_fills(fit(s.train, BY, views.ARD_SOURCES), BY)
    return I.apply_fills(rows, packed, BY, views.ARD_SOURCES, passthrough, s.n_cells)


@query("impute_apply", f"""WITH {CELLS_SQL}, {FILLS_CTE},
 sides AS (SELECT seed, draw, n, row_id, 'train' AS role, {', '.join(views.ARD_FEATURES)} FROM cells
   UNION ALL SELECT seed, draw, n, row_id, 'test', {', '.join(views.ARD_FEATURES)} FROM split, draws, grid WHERE role = 'test')
SELECT seed, draw, n, role, row_id, {APPLY_COLS} FROM sides JOIN f USING (seed, draw, n)""")
def impute_apply(spark, d):
    s = array_sample(spark, d)
    cols = [*BY, "row_id", "x"]
    rows = s.train.select(*cols, F.lit("train").alias("role")).unionByName(
        S.test_cells(s).select(*cols, F.lit("test").alias("role")))
    return _wide(_filled(s, rows))


# The source `custkey` is blanked in every training row, so it is never observed.
def _blanked(spark, d):
    s = array_sample(spark, d)
    s.train = s.train.withColumn("x", F.transform("x", lambda v, i: F.when(i != 1, v)))
    return s, S.test_cells(s).select(*BY, "row_id", "x")


@query("impute_prior", f"""WITH {CELLS_SQL}, {FILLS_CTE} SELECT seed, draw, n, row_id, {APPLY_COLS.replace('coalesce(x_custkey, f_custkey)', '0.0::DOUBLE')}
 FROM split JOIN f USING (seed) WHERE role = 'test'""")
def impute_prior(spark, d):
    s, rows = _blanked(spark, d)
    return _wide(_filled(s, rows))


@query("impute_passthrough", f"""WITH {CELLS_SQL} SELECT seed, draw, n, row_id, x_acctbal, NULL::DOUBLE AS x_custkey, o_month, {', '.join(SEG + PRI)}
 FROM split, draws, grid WHERE role = 'test'""")
def impute_passthrough(spark, d):
    s, rows = _blanked(spark, d)
    return _wide(_filled(s, rows, passthrough=True))


def _selected(spark):
    """(seed, draw, k, src) for the sample's own repeats."""
    grid = D.repeat_pairs(spark, pairs=[(a, b) for a in SEEDS for b in DRAWS])
    names = [x.name for x in views.ARD_SOURCES]
    ranks = D.source_ranks(grid, names)
    ks = F.filter(F.array(*[F.lit(k) for k in K_GRID]), lambda k: k >= F.col("srk"))
    return ranks.select("seed", "draw", F.explode(ks).alias("k"),
                        (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")) - 1)
                        .cast("int").alias("src"), "source")


SELECTED_SQL = f"""sel AS (SELECT seed, draw, k, source FROM (SELECT seed, draw, source, row_number() OVER (PARTITION BY seed, draw
   ORDER BY md5(concat_ws('|', seed, draw, 's', source)), source) AS srk FROM seeds, draws, (SELECT unnest({NAMES}) AS source))
   JOIN (SELECT unnest([1, 3, 5])::INT AS k) ON srk <= k)"""


@query("k_unobserved", f"""WITH {CELLS_SQL}, {SELECTED_SQL},
 seen AS (SELECT seed, draw, n, unnest({NAMES}) AS source, unnest([count(x_acctbal), 0, count(o_month), count(seg_0), count(pri_0)]) AS c FROM cells GROUP BY seed, draw, n)
SELECT seed, draw, n, k, count_if(c = 0)::BIGINT AS k_unobserved, count(*)::BIGINT AS k_sources FROM sel JOIN seen USING (seed, draw, source) GROUP BY ALL""")
def k_unobserved(spark, d):
    s, _ = _blanked(spark, d)
    seen = I.observed_sources(I.units(s.train, BY, views.ARD_SOURCES), BY)
    return I.k_unobserved(seen, _selected(spark), BY)


VARY_SQL = f"""{CELLS_SQL}, {SELECTED_SQL}, {FILLS_CTE},
 filled AS (SELECT seed, draw, n, {APPLY_COLS} FROM cells JOIN f USING (seed, draw, n)),
 vary AS (SELECT seed, draw, n, count(*) AS n_rows, unnest({NAMES}) AS source, unnest([
   (min(x_acctbal) <> max(x_acctbal))::INT, (min(x_custkey) <> max(x_custkey))::INT, (min(o_month) <> max(o_month))::INT,
   (min(seg_0) <> max(seg_0))::INT + (min(seg_1) <> max(seg_1))::INT + (min(seg_2) <> max(seg_2))::INT,
   (min(pri_0) <> max(pri_0))::INT + (min(pri_1) <> max(pri_1))::INT]) AS cols FROM filled GROUP BY seed, draw, n)"""


@query("k_varying", f"""WITH {VARY_SQL} SELECT seed, draw, n, k, count_if(cols > 0)::BIGINT AS k_varying FROM sel JOIN vary USING (seed, draw, source) GROUP BY ALL""")
def k_varying(spark, d):
    s = array_sample(spark, d)
    ranges = I.feature_ranges(_filled(s, s.train), BY, views.ARD_SOURCES)
    return I.k_varying(ranges, _selected(spark), BY).select(*BY, "k", "k_varying")


@query("underdetermined", f"""WITH {VARY_SQL} SELECT seed, draw, n, k, sum(cols)::BIGINT AS varying_columns, sum(cols) >= max(n_rows) AS underdetermined
 FROM sel JOIN vary USING (seed, draw, source) GROUP BY ALL""")
def underdetermined(spark, d):
    s = array_sample(spark, d)
    ranges = I.feature_ranges(_filled(s, s.train), BY, views.ARD_SOURCES)
    return I.k_varying(ranges, _selected(spark), BY).drop("k_varying")


@query("constant_prediction", f"""WITH {views.PREDS_SQL}, flat AS (SELECT * REPLACE (CASE WHEN model = 'c' THEN 5.0 ELSE y_pred END AS y_pred) FROM preds)
SELECT model, seed, draw, n, k, count(DISTINCT y_pred) < 2 AS constant_prediction FROM flat GROUP BY ALL""")
def constant_prediction(spark, d):
    p = views.preds(spark, d)
    p = p.withColumn("y_pred", F.when(F.col("model") == "c", 5.0).otherwise(F.col("y_pred")))
    return I.constant_prediction(p, views.CELL)


STD_COLS = ", ".join(
    f"{r(f'({c} - avg({c}) OVER w) / CASE WHEN min({c}) OVER w = max({c}) OVER w THEN 1 ELSE stddev_pop({c}) OVER w END')} AS {c}"
    for c in views.ARD_FEATURES)


@query("standardize", f"""WITH {CELLS_SQL}, {FILLS_CTE}, filled AS (SELECT seed, draw, n, row_id, {APPLY_COLS} FROM cells JOIN f USING (seed, draw, n))
SELECT seed, draw, n, row_id, {STD_COLS} FROM filled WINDOW w AS (PARTITION BY seed, draw, n)""")
def standardize(spark, d):
    s = array_sample(spark, d)
    scaled = I.standardize(_filled(s, s.train.select(*BY, "row_id", "x")), BY, n_cells=s.n_cells)
    return rounded(_wide(scaled))


@query("null_model", f"""WITH {CELLS_SQL}, m AS (SELECT seed, draw, n, avg(y) AS tm FROM cells GROUP BY ALL)
SELECT seed, draw, n, {r('max(tm)', 3)} AS train_mean, {r('avg(pow(y - tm, 2))', 1)} AS null_mse FROM split JOIN m USING (seed) WHERE role = 'test' GROUP BY ALL""")
def null_model(spark, d):
    s = sample(spark, d, ["x_acctbal"])
    means = s.train.groupBy(*BY).agg(F.avg("y").alias("train_mean"))
    joined = I.join_cells(S.test_cells(s), means, BY, s.n_cells)
    return rounded(joined.groupBy(*BY).agg(
        F.max("train_mean").alias("train_mean"),
        F.avg((F.col("y") - F.col("train_mean")) ** 2).alias("null_mse")), 1, train_mean=3)
