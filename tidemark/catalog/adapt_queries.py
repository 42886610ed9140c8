"""Cleaning, profiling, encoding and outcome-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog.registry import query, r, rounded
from tidemark.functions import scalars as X
from tidemark.operators import design as D
from tidemark.operators import encode as E
from tidemark.operators import impute as I
from tidemark.operators import joins as J
from tidemark.operators import profile as P

RAW = views.RAW_SQL
TOKENS = "('', 'NA', 'NaN', 'nan', 'NAN', 'Na', 'na', '<NA>')"
CODED = r"regexp_full_match({}, '-[1-9](\.0+)?')"
LONG_SQL = RAW + ", long AS (SELECT *, raw IN " + TOKENS + " AS blank, " + CODED.format("raw") + """ AS coded FROM (
  SELECT unit_id, pool, c AS "column", p AS "position", trim(coalesce(v, '')) AS raw FROM (""" + " UNION ALL ".join(
    f"SELECT unit_id, pool, '{c}' AS c, {i} AS p, {c} AS v FROM raw_survey" for i, c in enumerate(views.RAW_COLUMNS)
) + """))), num AS (SELECT *, CASE WHEN NOT blank AND NOT coded AND NOT isnan(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS number FROM long)"""
COLS = '"column", "position"'


def raw_long(spark, d, pool=None):
    raw = views.raw_survey(spark, d)
    if pool:
        raw = raw.where(F.col("pool") == pool)
    return P.melt(raw, views.RAW_COLUMNS)


def answers(spark, d):
    """Every raw answer with its unit."""
    raw = views.raw_survey(spark, d)
    e = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in views.RAW_COLUMNS])
    return raw.select("unit_id", F.explode(e).alias("e")).select("unit_id", "e.column", "e.v")


@query("string_normalize", f'WITH {LONG_SQL} SELECT unit_id, "column", raw FROM long')
def string_normalize(spark, d):
    return answers(spark, d).select("unit_id", "column", X.normalize(F.col("v")).alias("raw"))


@query("blank_mask", f'WITH {LONG_SQL} SELECT unit_id, "column", blank FROM long')
def blank_mask(spark, d):
    return answers(spark, d).select("unit_id", "column", X.is_blank(F.col("v")).alias("blank"))


@query("coded_mask", f'WITH {LONG_SQL} SELECT unit_id, "column", coded FROM long')
def coded_mask(spark, d):
    return answers(spark, d).select("unit_id", "column", X.is_coded(F.col("v")).alias("coded"))


@query("numeric_coerce", f'WITH {LONG_SQL} SELECT unit_id, "column", number FROM num')
def numeric_coerce(spark, d):
    return answers(spark, d).select("unit_id", "column", X.to_number(F.col("v")).alias("number"))


@query("parse_bool_strict", f"WITH {views.CKPT_SQL} SELECT seq, lower(trim(converged)) = 'true' AS flag FROM ckpt WHERE converged IS NOT NULL")
def parse_bool_strict(spark, d):
    df = views.ckpt(spark, d).where(F.col("converged").isNotNull())
    return df.select("seq", X.strict_boolean(F.col("converged"), "converged").alias("flag"))


@query("replace_sentinels", f"SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (1, 12) THEN NULL ELSE CAST(month(o_orderdate) AS DOUBLE) END AS m FROM orders")
def replace_sentinels(spark, d):
    o = views.table(spark, d, "orders")
    return o.select("o_orderkey", X.without_sentinels(F.month("o_orderdate").cast("double"), [1.0, 12.0]).alias("m"))


SAFE = """CASE WHEN s = '' THEN 'value' WHEN regexp_matches(s, '^[0-9]') THEN 'v_' || s ELSE s END"""


@query("safe_identifier", f"SELECT o_orderkey, {SAFE} AS safe FROM (SELECT o_orderkey, trim(regexp_replace(o_orderpriority, '[^0-9A-Za-z_]+', '_', 'g'), '_') AS s FROM orders)")
def safe_identifier(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", X.safe_identifier(F.col("o_orderpriority")).alias("safe"))


@query("unique_names", "SELECT event_id, [event_type, 'value', event_type || '_2', event_type || '_2_2', event_type || '_3'] AS names FROM events")
def unique_names(spark, d):
    t = F.col("event_type")
    header = F.array(t, F.lit("value"), t, F.concat(t, F.lit("_2")), t)
    return views.table(spark, d, "events").select("event_id", X.unique_names(header).alias("names"))


@query("feature_names", f"""SELECT c_custkey, 'C_nation__' || c_nationkey || CASE WHEN s <> '' THEN '__' || s ELSE '' END AS feature, 'neg_' || (c_custkey % 9 + 1) AS negative
FROM (SELECT c_custkey, c_nationkey, trim(regexp_replace(n_name, '[^0-9A-Za-z_]+', '_', 'g'), '_') AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def feature_names(spark, d):
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    named = J.label_vocabulary(n, "n_nationkey", "n_name")
    df = X.lookup_labels(c.select("c_custkey", "c_nationkey"), "c_nationkey", named)
    token = X.level_token(F.col("c_nationkey").cast("double"))
    code = F.concat(F.lit("-"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(".0"))
    return df.select("c_custkey", F.concat(F.lit("C_nation__"), X.feature_suffix(token, F.col("label"))).alias("feature"),
                     X.negative_token(code).alias("negative"))


@query("label_lookup", """SELECT c_custkey, coalesce(trim(regexp_replace(n_name, '[^0-9A-Za-z_]+', '_', 'g'), '_'), '') AS label
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 11 <> 0""")
def label_lookup(spark, d):
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    vocab = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    code = F.when(F.col("c_custkey") % 11 == 0, "unlisted").when(
        F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")))
    return X.lookup_labels(c.select("c_custkey", code.alias("code")), "code", vocab).select("c_custkey", "label")


@query("label_vocabulary", "SELECT DISTINCT n_nationkey AS code, n_name AS label FROM nation JOIN customer ON c_nationkey = n_nationkey")
def label_vocabulary(spark, d):
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    answers_ = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name")).alias("text"))
    return J.label_vocabulary(answers_, "n_nationkey", "text")


@query("level_value_parse", """WITH v AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN CAST(c_nationkey AS VARCHAR) || '.5' ELSE c_mktsegment END AS t FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN 'int' WHEN regexp_full_match(t, '-?[0-9]+\\.[0-9]+') THEN 'float' ELSE 'string' END AS kind, t AS value FROM v""")
def level_value_parse(spark, d):
    key = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    text = F.when(key % 3 == 0, nation).when(key % 3 == 1, F.concat(nation, F.lit(".5"))).otherwise(F.col("c_mktsegment"))
    return views.table(spark, d, "customer").select("c_custkey", X.level_value(text).alias("v")).select("c_custkey", "v.*")


@query("drop_missing_outcome", f"WITH {views.ARD_SQL} SELECT row_id, {r('y', 2)} AS y FROM ard WHERE y IS NOT NULL")
def drop_missing_outcome(spark, d):
    return rounded(views.ard(spark, d).dropna(subset=["y"]).select("row_id", "y"), 2)


@query("finite_float", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def finite_float(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "inf").otherwise("n/a")).otherwise(
        F.col("value").cast("string"))
    return views.table(spark, d, "events").select("event_id", X.finite(text).alias("v"))


@query("truthy", f"WITH {views.CKPT_SQL} SELECT seq, CASE WHEN lower(converged) = 'true' THEN 1 ELSE 0 END AS t FROM ckpt")
def truthy(spark, d):
    return views.ckpt(spark, d).select("seq", X.truthy(F.col("converged")).alias("t"))


PROFILE_SQL = f"""prof AS (SELECT {COLS}, count(*)::BIGINT AS n_rows, avg(CASE WHEN NOT blank AND NOT coded THEN 1.0 ELSE 0.0 END) AS raw_valid_rate,
  coalesce(count(number) / nullif(count_if(NOT blank AND NOT coded), 0)::DOUBLE, 0.0) AS numeric_fraction, count(DISTINCT number)::BIGINT AS distinct_numeric,
  coalesce(bool_and(abs(number - floor(number)) <= 1e-8), true) AS all_integer, bool_or(blank) AS has_blank
  FROM num WHERE pool = 'train' GROUP BY {COLS}),
 screened AS (SELECT *, CASE WHEN raw_valid_rate < 0.5 OR numeric_fraction < 0.95 OR distinct_numeric <= 1 THEN 'dropped'
   WHEN distinct_numeric <= 15 AND all_integer THEN 'categorical' ELSE 'numeric' END AS status,
  CASE WHEN raw_valid_rate < 0.5 THEN 'below_min_valid_rate' WHEN numeric_fraction < 0.95 THEN 'below_min_numeric_fraction'
   WHEN distinct_numeric <= 1 THEN 'constant_after_missing' ELSE 'kept' END AS reason FROM prof),
 lev AS (SELECT num."column", number AS level, count(*) / max(n_rows)::DOUBLE AS prevalence FROM num JOIN screened s ON s."column" = num."column"
   WHERE pool = 'train' AND status = 'categorical' AND number IS NOT NULL GROUP BY ALL)"""
PCOLS = f'{COLS}, n_rows, {r("raw_valid_rate")} AS raw_valid_rate, {r("numeric_fraction")} AS numeric_fraction, distinct_numeric, all_integer, has_blank'


def screened(spark, d):
    long = raw_long(spark, d, "train")
    return long, P.screen_columns(P.profile_columns(long))


@query("profile_columns", f"WITH {LONG_SQL}, {PROFILE_SQL} SELECT {PCOLS} FROM prof")
def profile_columns(spark, d):
    return rounded(P.profile_columns(raw_long(spark, d, "train")))


@query("screen_columns", f"WITH {LONG_SQL}, {PROFILE_SQL} SELECT {PCOLS}, status, reason FROM screened")
def screen_columns(spark, d):
    return rounded(screened(spark, d)[1])


@query("all_integer", f"""SELECT 'acctbal' AS "column", bool_and(abs(c_acctbal - floor(c_acctbal)) <= 1e-8) AS all_integer FROM customer
UNION ALL SELECT 'nation', bool_and(abs(c_nationkey - floor(c_nationkey)) <= 1e-8) FROM customer""")
def all_integer(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return P.profile_columns(P.melt(c, c.columns)).select("column", "all_integer")


@query("level_vocabulary", f"""WITH {LONG_SQL}, {PROFILE_SQL} SELECT "column", (row_number() OVER (PARTITION BY "column" ORDER BY level) - 1)::INT AS level_index, level FROM lev""")
def level_vocabulary(spark, d):
    return P.level_vocabulary(*screened(spark, d)).select("column", "level_index", "level")


@query("binary_prevalence", f"""WITH {LONG_SQL}, {PROFILE_SQL} SELECT "column", level, {r('prevalence')} AS prevalence, least(prevalence, 1 - prevalence) >= 0.01 AS keep FROM lev""")
def binary_prevalence(spark, d):
    return rounded(P.level_vocabulary(*screened(spark, d)).select("column", "level", "prevalence", "keep"))


@query("missing_code_vocab", f"""WITH {LONG_SQL}, {PROFILE_SQL}, m AS (SELECT num."column", CASE WHEN coded THEN raw ELSE 'blank' END AS token,
  CASE WHEN coded THEN try_cast(try_cast(raw AS DOUBLE) AS INT) ELSE 0 END AS "rank", count(*) / max(n_rows)::DOUBLE AS prevalence
  FROM num JOIN screened s ON s."column" = num."column" WHERE pool = 'train' AND status <> 'dropped' AND (coded OR blank) GROUP BY ALL)
SELECT "column", token, "rank", {r('prevalence')} AS prevalence, least(prevalence, 1 - prevalence) >= 0.01 AS keep FROM m""")
def missing_code_vocab(spark, d):
    return rounded(P.missing_code_vocabulary(*screened(spark, d)))


@query("categorical_eligible", f"""WITH {LONG_SQL}, {PROFILE_SQL} SELECT "column", bool_or(least(prevalence, 1 - prevalence) >= 0.01) AS eligible, count(*)::BIGINT AS n_levels FROM lev GROUP BY 1""")
def categorical_eligible(spark, d):
    return P.categorical_eligible(P.level_vocabulary(*screened(spark, d)))


def raw_sources(spark, d, columns=("balance", "grp", "mixed", "constant")):
    pool = views.raw_survey(spark, d).where(F.col("pool") == "train")
    return P.collect_sources(pool, list(columns))


BAL = "CASE WHEN NOT (trim(balance) IN " + TOKENS + ") AND NOT " + CODED.format("trim(balance)") + " THEN try_cast(trim(balance) AS DOUBLE) END"
GRP = "CASE WHEN NOT " + CODED.format("trim(grp)") + " THEN try_cast(trim(grp) AS DOUBLE) END"
LEVELS = [0, 1, 2, 3, 7]
HOT = ", ".join(f"CASE WHEN g IS NULL THEN NULL WHEN g = {v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS C_grp__{v}" for v in LEVELS)


@query("onehot_atomic", f"WITH {RAW} SELECT unit_id, b AS X_balance, {HOT} FROM (SELECT unit_id, {BAL} AS b, {GRP} AS g FROM raw_survey)")
def onehot_atomic(spark, d):
    return E.encode_median_mode(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d)).features


@query("missing_indicators", f"""WITH {RAW} SELECT unit_id, b AS X_balance, (bt = '-9')::INT::DOUBLE AS M_balance__neg_9, (bt = '-6.0')::INT::DOUBLE AS M_balance__neg_6,
 (bt IN ('', 'NA'))::INT::DOUBLE AS M_balance__blank, {HOT}, (gt = '-1')::INT::DOUBLE AS M_grp__neg_1
FROM (SELECT unit_id, {BAL} AS b, {GRP} AS g, trim(balance) AS bt, trim(grp) AS gt FROM raw_survey)""")
def missing_indicators(spark, d):
    return E.encode_missing_indicator(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d)).features


@query("ordinal_encode", f"WITH {RAW} SELECT unit_id, b AS X_balance, CASE g WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 7 THEN 4 END AS C_grp FROM (SELECT unit_id, {BAL} AS b, {GRP} AS g FROM raw_survey)")
def ordinal_encode(spark, d):
    return E.encode_tree_ordinal(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d)).features


@query("numeric_encode", f"WITH {RAW} SELECT unit_id, {BAL} AS X_balance FROM raw_survey")
def numeric_encode(spark, d):
    return E.encode_median_mode(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d, ["balance"])).features


# Test units give an answer, 9, that the training pool never gives.
def late_survey(spark, d):
    late = (F.col("pool") == "test") & (F.col("unit_id") % 7 == 0)
    return views.raw_survey(spark, d).withColumn("grp", F.when(late, "9").otherwise(F.col("grp")))


LATE_SQL = RAW + ", late AS (SELECT * REPLACE (CASE WHEN pool = 'test' AND unit_id % 7 = 0 THEN '9' ELSE grp END AS grp) FROM raw_survey)"


@query("categorical_state", f"""WITH {LATE_SQL}, g AS (SELECT unit_id, trim(grp) AS t, {GRP} AS number FROM late)
SELECT unit_id, number, coalesce(number IN (0, 1, 2, 3, 7), false) AS known, number IS NOT NULL AND number NOT IN (0, 1, 2, 3, 7) AS unknown, {CODED.format('t')} AS missing FROM g""")
def categorical_state(spark, d):
    source = raw_sources(spark, d, ["grp"])[0]
    s = E.states(F.col("grp"), source.levels)
    return late_survey(spark, d).select("unit_id", *[c.alias(n) for n, c in s.items()])


@query("unknown_category_qa", f"""WITH {LATE_SQL}, g AS (SELECT {GRP} AS number FROM late WHERE pool = 'test')
SELECT 'grp' AS source_column, count_if(number NOT IN (0, 1, 2, 3, 7))::BIGINT AS unknown_count, count(number)::BIGINT AS denominator,
 {r('count_if(number NOT IN (0, 1, 2, 3, 7)) / count(number)')} AS unknown_rate, count_if(number NOT IN (0, 1, 2, 3, 7)) / count(number) > 0.95 AS exceeds FROM g""")
def unknown_category_qa(spark, d):
    frame = late_survey(spark, d)
    ids = frame.where(F.col("pool") == "test").select("unit_id")
    return rounded(E.unknown_category_qa(frame, ids, "unit_id", raw_sources(spark, d, ["grp"])))


MISSING_SQL = """missing AS (SELECT num."column", s."position", CASE WHEN coded THEN raw ELSE 'blank' END AS token,
  CASE WHEN coded THEN try_cast(try_cast(raw AS DOUBLE) AS INT) ELSE 0 END AS rk, count(*) / max(n_rows)::DOUBLE AS prevalence
  FROM num JOIN screened s ON s."column" = num."column" WHERE pool = 'train' AND status <> 'dropped' AND (coded OR blank) GROUP BY ALL)"""
ORDER_SQL = f"""WITH {LONG_SQL}, {PROFILE_SQL}, {MISSING_SQL},
 parts AS (SELECT "column" AS source_column, "position" AS p, 0 AS t, 0 AS rk FROM screened WHERE status <> 'dropped'
  UNION ALL SELECT "column" || '__missing__' || CASE WHEN token = 'blank' THEN 'blank' ELSE 'code_' || token END, "position", 1, rk FROM missing
   WHERE least(prevalence, 1 - prevalence) >= 0.01)"""


@query("kept_source_order", f"{ORDER_SQL} SELECT source_column, (row_number() OVER (ORDER BY p, t, rk) - 1)::INT AS source_order FROM parts")
def kept_source_order(spark, d):
    enc = E.encode_missing_indicator(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d))
    return E.kept_source_order(enc.manifest())


@query("cross_strategy_sources", f"WITH {LONG_SQL}, {PROFILE_SQL} SELECT true AS same, count(*)::BIGINT AS n_sources FROM screened WHERE status <> 'dropped'")
def cross_strategy_sources(spark, d):
    frame, sources = views.raw_survey(spark, d), raw_sources(spark, d)
    return E.same_sources(E.encode_median_mode(frame, "unit_id", sources).manifest(),
                          E.encode_tree_ordinal(frame, "unit_id", sources).manifest())


@query("feature_universe", f"""WITH {LONG_SQL}, {PROFILE_SQL}, kept AS (SELECT *, (row_number() OVER (ORDER BY "position") - 1)::INT AS source_order FROM screened WHERE status <> 'dropped')
SELECT "column" AS source_column, source_order, 'continuous' AS unit_type, 0 AS feature_order, 'X_' || "column" AS feature_name, NULL AS level_value FROM kept WHERE status = 'numeric'
 UNION ALL SELECT kept."column", source_order, 'onehot_group', (row_number() OVER (PARTITION BY kept."column" ORDER BY level) - 1)::INT,
  'C_' || kept."column" || '__' || CAST(level AS INT), CAST(CAST(level AS INT) AS VARCHAR) FROM lev JOIN kept ON kept."column" = lev."column" """)
def feature_universe(spark, d):
    enc = E.encode_median_mode(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d))
    u = E.feature_universe(enc.manifest())
    return u.select("source_column", "source_order", "unit_type", F.explode("features").alias("f")).select(
        "source_column", "source_order", "unit_type", "f.feature_order", "f.feature_name", "f.level_value")


# For outcome `price`, training rows of December or of the third segment have no
# outcome, so those states are unseen; outcome `raw` sees every state.
ROLE = "CASE WHEN x_custkey < 500 THEN 'train' ELSE 'test' END"
MASK_SQL = f"""{views.ARD_SQL}, base AS (SELECT *, {ROLE} AS role FROM ard),
 o AS (SELECT 'price' AS outcome, * REPLACE (CASE WHEN role = 'train' AND (o_month = 12 OR seg_2 = 1) THEN NULL ELSE y END AS y) FROM base
  UNION ALL SELECT 'raw' AS outcome, * FROM base)"""


def masked_rows(spark, d):
    rows = I.assemble(views.ard(spark, d).drop("y_bin"), views.ARD_FEATURES)
    role = F.when(F.col("x")[1] < 500, "train").otherwise("test")
    gone = (role == "train") & (F.coalesce(F.col("x")[2] == 12, F.lit(False)) | F.coalesce(F.col("x")[5] == 1, F.lit(False)))
    outcomes = F.array(F.struct(F.lit("price").alias("outcome"), F.when(~gone, F.col("y")).alias("y")),
                       F.struct(F.lit("raw").alias("outcome"), F.col("y").alias("y")))
    rows = rows.select(role.alias("role"), "row_id", "x", F.explode(outcomes).alias("o")).select(
        "o.outcome", "role", "row_id", "o.y", "x")
    return E.mask_unseen(rows, views.ARD_SOURCES)


@query("mask_unseen_categories", f"""WITH {MASK_SQL}, m AS (SELECT *, outcome = 'price' AND role = 'test' AND y IS NOT NULL AS hit FROM o)
SELECT outcome, row_id, role, CASE WHEN hit AND o_month = 12 THEN NULL ELSE o_month END AS o_month,
 CASE WHEN hit AND seg_2 = 1 THEN NULL ELSE seg_0 END AS seg_0, CASE WHEN hit AND seg_2 = 1 THEN NULL ELSE seg_2 END AS seg_2, pri_0 FROM m""")
def mask_unseen_categories(spark, d):
    x = F.col("x")
    return masked_rows(spark, d)[0].select("outcome", "row_id", "role", x[2].alias("o_month"), x[3].alias("seg_0"),
                                           x[5].alias("seg_2"), x[6].alias("pri_0"))


@query("mask_unseen_qa", f"""WITH {MASK_SQL}, t AS (SELECT *, outcome = 'price' AS p FROM o WHERE role = 'test' AND y IS NOT NULL),
 q AS (SELECT outcome, 'month' AS source_column, 'ordinal' AS unit_type, count_if(p AND o_month = 12) AS u, count(o_month) AS c FROM t GROUP BY outcome
  UNION ALL SELECT outcome, 'segment', 'onehot_group', count_if(p AND seg_2 = 1), count(seg_2) FROM t GROUP BY outcome
  UNION ALL SELECT outcome, 'priority', 'onehot_group', 0, count(pri_0) FROM t GROUP BY outcome)
SELECT outcome, source_column, unit_type, u::BIGINT AS unknown_count, c::BIGINT AS denominator, {r('u / c')} AS unknown_rate, false AS exceeds FROM q""")
def mask_unseen_qa(spark, d):
    return rounded(masked_rows(spark, d)[1])


@query("predictors_by_prefix", f"""WITH {views.ARD_SQL} SELECT 'x_acctbal' AS feature, 0 AS pos, count(x_acctbal)::BIGINT AS seen FROM ard
 UNION ALL SELECT 'x_custkey', 1, count(x_custkey) FROM ard UNION ALL SELECT 'o_month', 2, count(o_month) FROM ard""")
def predictors_by_prefix(spark, d):
    from tidemark.sources.tables import resolve_predictors
    rows = views.ard(spark, d)
    names = resolve_predictors(rows.columns, prefixes=["x_", "o_"])
    return _counts(rows, names)


def _counts(rows, names):
    e = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(i).alias("pos"), F.col(n).isNotNull().alias("s"))
                  for i, n in enumerate(names)])
    return rows.select(F.explode(e).alias("e")).groupBy("e.feature", "e.pos").agg(F.count_if("e.s").alias("seen"))


@query("manifest_order", f"""WITH {views.ARD_SQL} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS pos, count({c})::BIGINT AS seen FROM ard" for i, c in enumerate(views.ARD_FEATURES)))
def manifest_order(spark, d):
    from tidemark.sources.tables import resolve_predictors
    rows = views.ard(spark, d)
    manifest = E.manifest_frame(spark, views.ARD_SOURCES)
    return _counts(rows, resolve_predictors(rows.columns, manifest=manifest))


OUT_SQL = RAW + """, feats AS (SELECT unit_id, grp FROM raw_survey WHERE unit_id % 41 <> 0)"""


@query("join_one_to_one", f"""WITH {OUT_SQL} SELECT c_custkey AS unit_id, c_acctbal, grp, unit_id IS NOT NULL AS matched FROM customer LEFT JOIN feats ON c_custkey = unit_id""")
def join_one_to_one(spark, d):
    feats = views.raw_survey(spark, d).where("unit_id % 41 <> 0").select("unit_id", "grp")
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), "c_acctbal")
    return J.join_one_to_one(c, feats, "unit_id").withColumnRenamed("_matched", "matched")


@query("join_one_to_one_violations", f"""SELECT 'unmatched' AS kind, count(*)::BIGINT AS n, min(CAST(c_custkey AS VARCHAR)) AS example FROM customer WHERE c_custkey % 41 = 0
 UNION ALL SELECT 'duplicate_right', count(*)::BIGINT, min(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 97 = 0 AND c_custkey % 41 <> 0""")
def join_one_to_one_violations(spark, d):
    feats = views.raw_survey(spark, d).where("unit_id % 41 <> 0").select("unit_id")
    again = feats.where("unit_id % 97 = 0")
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"))
    return J.one_to_one_violations(c, feats.unionByName(again), "unit_id")


@query("join_left_semi", f"WITH {RAW} SELECT unit_id, grp FROM raw_survey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = unit_id AND o_orderstatus = 'F')")
def join_left_semi(spark, d):
    ids = views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("unit_id"))
    return P.pool_rows(views.raw_survey(spark, d), ids, "unit_id").select("unit_id", "grp")


@query("id_overlap", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def id_overlap(spark, d):
    o = views.table(spark, d, "orders").withColumn("id", F.col("o_custkey"))
    return J.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "id")


@query("outcome_summary", f"""WITH {RAW}, o AS (SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS pool, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey AS nat FROM customer),
 l AS (SELECT pool, 'bal' AS outcome, bal IS NOT NULL AS seen FROM o UNION ALL SELECT pool, 'nat', nat IS NOT NULL FROM o)
SELECT pool, outcome, count(*)::BIGINT AS rows_in_outcome_file, count(*)::BIGINT AS rows_after_feature_merge, count_if(seen)::BIGINT AS rows_with_observed_outcome, 6 AS predictor_columns FROM l GROUP BY ALL""")
def outcome_summary(spark, d):
    key = F.col("c_custkey")
    o = views.table(spark, d, "customer").select(
        key.alias("unit_id"), F.when(key % 10 < 8, "train").otherwise("test").alias("pool"),
        F.when(key % 5 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").alias("nat"))
    enc = E.encode_median_mode(views.raw_survey(spark, d), "unit_id", raw_sources(spark, d))
    return J.outcome_summary(o, enc.features, "unit_id", "pool", ["bal", "nat"], len(enc.features.columns) - 1)


@query("adapt_pipeline", f"""WITH {RAW}, o AS (SELECT c_custkey AS unit_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS bal, CAST(c_nationkey AS DOUBLE) AS nat FROM customer),
 f AS (SELECT unit_id, pool, {BAL} AS b, {GRP} AS g FROM raw_survey), j AS (SELECT 'bal' AS outcome, pool AS role, bal AS y, b, g FROM f JOIN o USING (unit_id) UNION ALL SELECT 'nat', pool, nat, b, g FROM f JOIN o USING (unit_id))
SELECT outcome, role, count(*)::BIGINT AS n_rows, count(y)::BIGINT AS n_observed, {r('sum(b)', 2)} AS sum_balance, count(g)::BIGINT AS group_seen, {r('sum((g = 3)::INT)', 1)} AS sum_level_3 FROM j GROUP BY ALL""")
def adapt_pipeline(spark, d):
    """Raw answers to analysis-ready rows of two outcomes."""
    from tidemark.plans.adapt import adapt
    key = F.col("c_custkey")
    outcomes = views.table(spark, d, "customer").select(
        key.alias("unit_id"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))
    result = adapt(views.raw_survey(spark, d), outcomes, "unit_id", "pool", views.RAW_COLUMNS, ["bal", "nat"])
    x = F.col("x")
    return rounded(result.rows.groupBy("outcome", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("n_observed"), F.sum(x[0]).alias("sum_balance"),
        F.count(x[1]).alias("group_seen"), F.sum(x[4]).alias("sum_level_3")), 2)
