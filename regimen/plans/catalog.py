"""Registered queries over the driver tables and their SQL oracles.

Each query is ``(spark, sf_dir) -> DataFrame`` over WHOLE tables; each
oracle is a DuckDB-runnable SQL string producing the same columns.  Floats
are rounded to 6 decimals on both sides (see ``r6``; ``+ 0.0`` so that a
negative zero never differs from a positive one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimen.operators import clean, metrics, profile, ranking, sampling, synth
from regimen.operators.order import global_rank, hash_order
from regimen.plans import baseline, experiments
from regimen.session import compact, deal_up, materialize
from regimen.sources import tables, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round to ``digits`` decimals as ``round(x * 10^d) / 10^d``: the scaled
    double is rounded the same way by both engines (a decimal-string tie
    such as 27.4671705 is not), and ``+ 0.0`` turns -0.0 into 0.0.

    Aggregates of large values (prices ~1e4) carry summation-order error
    ~1e-11, so those outputs use fewer digits (``digits=2`` or 4)."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(col.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def R6(expr: str, digits: int = 6) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round(({expr})::DOUBLE * {scale}) / {scale} + 0.0)"


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.read_table(spark, sf, name)


LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_KEYS_SQL = ", ".join(LI_KEYS)


def r2_sql(y: str, e: str) -> str:
    """R^2 from a nulled label ``y`` and nulled error ``e`` (same rules as Spark)."""
    return (f"CASE WHEN count({y}) < 2 THEN NULL "
            f"WHEN var_pop({y}) * count({y}) = 0 THEN CASE WHEN sum({e}*{e}) = 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE 1 - sum({e}*{e}) / (var_pop({y}) * count({y})) END")


def metric_cols_sql(y: str = "yv", e: str = "ev") -> str:
    return (f"count({y}) AS n, {R6(r2_sql(y, e))} AS r2, {R6(f'avg(abs({e}))')} AS mae, "
            f"{R6(f'sqrt(avg({e}*{e}))')} AS rmse")


def nulled_sql(y: str, p: str) -> str:
    ok = f"({y} IS NOT NULL AND NOT isnan({y}) AND {p} IS NOT NULL AND NOT isnan({p}))"
    return f"CASE WHEN {ok} THEN {y} END AS yv, CASE WHEN {ok} THEN {y} - {p} END AS ev"


def round_metrics(df: DataFrame, cols=("r2", "mae", "rmse")) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# =====================================================================
# Flagship: events -> impute -> exact hold-out -> mean predictor -> metrics

def events_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    ev = T(spark, sf, "events")
    return ev.select("event_id", "user_id", "event_type",
                     F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double"))
                     .otherwise(F.col("value")).alias("value"))


EVENTS_NULLS_SQL = ("SELECT event_id, user_id, event_type, "
                    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")


def holdout_sql(src: str, key: str, seed: int = 42, frac: float = 0.2) -> str:
    return (f"SELECT *, CASE WHEN pos_ < ceil({frac}::DOUBLE * n_) THEN 'test' ELSE 'train' END AS split "
            f"FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', {key}, {seed})), {key}) - 1 AS pos_, "
            f"count(*) OVER () AS n_ FROM ({src}) s0) s1")


@register("flagship_mean_predictor", f"""
WITH imp AS (
  SELECT event_id, coalesce(value, (SELECT avg(value) FROM ({EVENTS_NULLS_SQL}) a)) AS label
  FROM ({EVENTS_NULLS_SQL}) b),
s AS ({holdout_sql('SELECT * FROM imp', 'event_id')}),
m AS (SELECT avg(label) AS mu FROM s WHERE split = 'train'),
p AS (SELECT split, {nulled_sql('label', 'mu')} FROM s CROSS JOIN m)
SELECT split, {metric_cols_sql()} FROM p GROUP BY split
""")
def q_flagship(spark: SparkSession, sf: str) -> DataFrame:
    ev = clean.impute_mean(events_with_nulls(spark, sf).select("event_id", "value"), ["value"])
    split = materialize(sampling.holdout_split(ev.withColumnRenamed("value", "label"), ["event_id"], 0.2, 42))
    means = baseline.fit_means(split.where(F.col("split") == "train"), "label")
    preds = baseline.predict_means(split, means)
    return round_metrics(metrics.regression_metrics(preds, ["split"]))


# =====================================================================
# Order, splits, folds, samples

@register("global_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('-', o_orderkey, 7)), o_orderkey) - 1 AS pos
FROM orders
""")
def q_global_rank(spark, sf):
    b, order = hash_order(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], salt=[F.lit(7)])
    return global_rank(b, order).select("o_orderkey", "pos")


@register("holdout_split", f"""
SELECT event_id, split FROM ({holdout_sql('SELECT event_id FROM events', 'event_id')}) h
""")
def q_holdout(spark, sf):
    return sampling.holdout_split(T(spark, sf, "events").select("event_id"), ["event_id"], 0.2, 42)


@register("shuffle_splits", """
WITH ex AS (SELECT o_orderkey, r.round, s.split FROM orders,
            (SELECT range AS round FROM range(2)) r, (SELECT range AS split FROM range(5)) s),
k AS (SELECT *, row_number() OVER (PARTITION BY round, split
                                   ORDER BY md5(concat_ws('-', o_orderkey, 42, round, split)), o_orderkey) - 1 AS pos,
             count(*) OVER (PARTITION BY round, split) AS n FROM ex)
SELECT o_orderkey, round::INTEGER AS round, split::INTEGER AS split, pos < ceil(0.2::DOUBLE * n) AS is_test FROM k
""")
def q_shuffle_splits(spark, sf):
    return sampling.shuffle_splits(deal_up(T(spark, sf, "orders").select("o_orderkey")), ["o_orderkey"],
                                   n_splits=5, test_size=0.2, seed=42, n_rounds=2)


def kfold_sql(src: str, order: str, k: int) -> str:
    return (f"SELECT *, (CASE WHEN pos_ < (n_ % {k}) * (n_ // {k} + 1) THEN pos_ // (n_ // {k} + 1) "
            f"ELSE (n_ % {k}) + (pos_ - (n_ % {k}) * (n_ // {k} + 1)) // (n_ // {k}) END)::INTEGER AS fold "
            f"FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos_, count(*) OVER () AS n_ "
            f"FROM ({src}) s0) s1")


@register("kfold_contiguous", f"""
SELECT p_partkey, fold FROM ({kfold_sql('SELECT p_partkey FROM part', 'p_partkey', 5)}) f
""")
def q_kfold(spark, sf):
    return sampling.kfold_contiguous(T(spark, sf, "part").select("p_partkey"), ["p_partkey"], 5)


@register("kfold_after_split", f"""
WITH h AS ({holdout_sql('SELECT event_id FROM events', 'event_id')})
SELECT event_id, split, fold FROM ({kfold_sql('SELECT event_id, split FROM h',
                                              "split = 'test', md5(concat_ws('-', event_id, 42)), event_id", 5)}) f
""")
def q_kfold_after_split(spark, sf):
    return sampling.kfold_after_split(T(spark, sf, "events").select("event_id"), ["event_id"], 5, 0.2, 42)


@register("bounded_sample", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('-', o_orderkey, 42)), o_orderkey LIMIT 1000
""")
def q_bounded_sample(spark, sf):
    return sampling.bounded_sample(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                                   ["o_orderkey"], 1000, 42)


def _fractions_sql() -> str:
    return ", ".join(f"{f!r}::DOUBLE" for f in sampling.linspace_fractions())


@register("growing_prefixes", f"""
WITH f AS ({kfold_sql('SELECT p_partkey FROM part', 'p_partkey', 5)}),
c AS (SELECT max(n_) AS n, max(n_) // 5 AS q, max(n_) % 5 AS r FROM f),
sz AS (SELECT DISTINCT least(greatest(floor(fr * (n - (q + CASE WHEN r > 0 THEN 1 ELSE 0 END))), 1),
                             n - (q + CASE WHEN r > 0 THEN 1 ELSE 0 END))::BIGINT AS m
       FROM c, (SELECT unnest([{_fractions_sql()}]) AS fr) x),
cv AS (SELECT range::INTEGER AS cv_fold FROM range(5)),
mem AS (SELECT f.p_partkey, f.fold, cv.cv_fold, sz.m,
               row_number() OVER (PARTITION BY cv.cv_fold, sz.m ORDER BY f.pos_) AS rn
        FROM f, cv, sz WHERE f.fold <> cv.cv_fold)
SELECT p_partkey, fold, cv_fold, m AS train_size FROM mem WHERE rn <= m
""")
def q_growing_prefixes(spark, sf):
    return sampling.growing_prefixes(T(spark, sf, "part").select("p_partkey"), ["p_partkey"], 5)


# =====================================================================
# Imputation and scaling

@register("impute_mean", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT event_id, {R6('coalesce(value, (SELECT avg(value) FROM e))')} AS value,
       NULL::DOUBLE AS empty FROM e
""")
def q_impute_mean(spark, sf):
    e = events_with_nulls(spark, sf).select("event_id", "value", F.lit(None).cast("double").alias("empty"))
    out = clean.impute_mean(e, ["value", "empty"])
    return out.select("event_id", r6("value").alias("value"), "empty")


ORDERS_TARGET_SQL = ("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, "
                     "NULL::DOUBLE AS qty, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS cust "
                     "FROM orders")


def orders_target(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("o_totalprice")).alias("price"),
                    F.lit(None).cast("double").alias("qty"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("o_custkey").cast("double")).alias("cust"))


@register("impute_from_reference", f"""
WITH t AS ({ORDERS_TARGET_SQL}),
ref AS (SELECT avg(l_extendedprice) AS price, avg(l_quantity) AS qty FROM lineitem)
SELECT o_orderkey, {R6('coalesce(t.price, ref.price)', 4)} AS price, {R6('coalesce(t.qty, ref.qty)', 4)} AS qty,
       {R6('coalesce(t.cust, (SELECT avg(cust) FROM t))')} AS cust
FROM t CROSS JOIN ref
""")
def q_impute_from_reference(spark, sf):
    ref = T(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"),
                                          F.col("l_quantity").alias("qty"))
    out = clean.impute_from_reference(orders_target(spark, sf), ref, ["price", "qty", "cust"])
    return out.select("o_orderkey", r6("price", 4).alias("price"), r6("qty", 4).alias("qty"), r6("cust").alias("cust"))


@register("zero_if_all_missing_label", f"""
WITH t AS ({ORDERS_TARGET_SQL})
SELECT o_orderkey, CASE WHEN (SELECT count(qty) FROM t) = 0 THEN 0.0 ELSE qty END::DOUBLE AS qty,
       CASE WHEN (SELECT count(price) FROM t) = 0 THEN 0.0 ELSE price END::DOUBLE AS price FROM t
""")
def q_zero_label(spark, sf):
    t = orders_target(spark, sf).select("o_orderkey", "qty", "price")
    return clean.zero_if_all_missing(clean.zero_if_all_missing(t, "qty"), "price")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_num(spark, sf) -> DataFrame:
    return T(spark, sf, "lineitem").select(*LI_KEYS, *LI_NUM, F.lit(5.0).alias("const"))


def _minmax_sql(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / "
            f"(max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END")


@register("minmax_features", f"""
SELECT {LI_KEYS_SQL}, {', '.join(f"{R6(_minmax_sql(c))} AS {c}" for c in LI_NUM + ['const'])}
FROM (SELECT *, 5.0::DOUBLE AS const FROM lineitem) l
""")
def q_minmax(spark, sf):
    cols = LI_NUM + ["const"]
    out = clean.minmax_features(lineitem_num(spark, sf), cols)
    return out.select(*LI_KEYS, *[r6(c).alias(c) for c in cols])


@register("minmax_target", f"""
SELECT {LI_KEYS_SQL}, {R6(_minmax_sql('l_extendedprice'))} AS l_extendedprice FROM lineitem
""")
def q_minmax_target(spark, sf):
    li = T(spark, sf, "lineitem").select(*LI_KEYS, "l_extendedprice")
    return clean.minmax_target(li, "l_extendedprice").select(*LI_KEYS, r6("l_extendedprice").alias("l_extendedprice"))


def _minmax_rounded_sql(c: str) -> str:
    rng = f"round_even(max({c}) OVER () - min({c}) OVER (), 5)"
    return f"round_even(({c} - min({c}) OVER ()) / NULLIF({rng}, 0), 5)"


@register("minmax_rounded", f"""
SELECT {LI_KEYS_SQL}, {', '.join(f"{R6(_minmax_rounded_sql(c))} AS {c}" for c in LI_NUM + ['const'])}
FROM (SELECT *, 5.0::DOUBLE AS const FROM lineitem) l
""")
def q_minmax_rounded(spark, sf):
    cols = LI_NUM + ["const"]
    out = clean.minmax_rounded(lineitem_num(spark, sf), cols)
    return out.select(*LI_KEYS, *[r6(c).alias(c) for c in cols])


@register("minmax_target_rounded", f"""
SELECT {LI_KEYS_SQL}, {R6("round_even((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 5)")}
       AS l_tax FROM lineitem
""")
def q_minmax_target_rounded(spark, sf):
    li = T(spark, sf, "lineitem").select(*LI_KEYS, "l_tax")
    return clean.minmax_target_rounded(li, "l_tax").select(*LI_KEYS, r6("l_tax").alias("l_tax"))


STD_COLS = ["o_totalprice", "cust", "const"]


@register("standardize", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS cust, 1.0::DOUBLE AS const FROM orders),
h AS ({holdout_sql('SELECT * FROM o', 'o_orderkey')}),
st AS (SELECT {', '.join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                         for c in STD_COLS)} FROM h WHERE split = 'train')
SELECT o_orderkey, split, {', '.join(f"{R6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in STD_COLS)}
FROM h CROSS JOIN st
""")
def q_standardize(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"),
                                      F.lit(1.0).alias("const"))
    h = sampling.holdout_split(o, ["o_orderkey"], 0.2, 42)
    stats = clean.standardize_fit(h.where(F.col("split") == "train"), STD_COLS)
    out = clean.standardize_apply(h, stats, STD_COLS)
    return out.select("o_orderkey", "split", *[r6(c).alias(c) for c in STD_COLS])


@register("broadcast_stats", f"""
SELECT {LI_KEYS_SQL}, {R6('l_extendedprice - avg(l_extendedprice) OVER ()', 4)} AS deviation FROM lineitem
""")
def q_broadcast_stats(spark, sf):
    li = T(spark, sf, "lineitem").select(*LI_KEYS, "l_extendedprice")
    stats = li.agg(F.avg("l_extendedprice").alias("mean"))
    return clean.broadcast_stats(li, stats).select(
        *LI_KEYS, r6(F.col("l_extendedprice") - F.col("mean"), 4).alias("deviation"))


# =====================================================================
# P ops

def events_nan_label(spark, sf) -> DataFrame:
    ev = T(spark, sf, "events")
    return ev.select("event_id", F.when(ev.event_id % 11 == 0, F.lit(float("nan")))
                     .when(ev.event_id % 7 == 0, F.lit(None).cast("double")).otherwise(ev.value).alias("value"))


@register("labelled_only", """
SELECT event_id, value FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events) e
WHERE value IS NOT NULL AND NOT isnan(value)
""")
def q_labelled_only(spark, sf):
    return clean.labelled_only(events_nan_label(spark, sf), "value")


@register("run_log", """
SELECT printf('%d    %d  %.5f    %.5f', l_orderkey, l_linenumber, 1 - l_discount, l_tax * 10) AS record,
       concat_ws('-', trunc(round_even(1 - l_discount, 2) * 100)::INTEGER, trunc(round_even(l_tax * 10, 2) * 100)::INTEGER,
                 strftime(l_shipdate, '%Y%m%d-%H%M%S')) AS name
FROM lineitem WHERE 1 - l_discount > 0.89 AND l_tax * 10 > 0.5
""")
def q_run_log(spark, sf):
    li = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("round"), F.col("l_linenumber").alias("split"),
                                         (1 - F.col("l_discount")).alias("score"),
                                         (F.col("l_tax") * 10).alias("score2"), "l_shipdate")
    acc = clean.accept_runs(li)
    stamp = F.date_format("l_shipdate", tables.STAMP_FORMAT)
    return acc.select(tables.run_record().alias("record"),
                      tables.scored_name("score", "score2", stamp, integer=True).alias("name"))


@register("clip_and_round", """
SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE greatest(v, 0.0) END AS clipped,
       round_even(v / 7.0, 5) AS rounded
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 50 END AS v FROM events) e
""")
def q_clip_round(spark, sf):
    ev = T(spark, sf, "events")
    e = ev.select("event_id", F.when(ev.event_id % 7 == 0, F.lit(None).cast("double"))
                  .otherwise(ev.value - 50).alias("v"))
    out = e.select("event_id", F.col("v").alias("clipped"), (F.col("v") / 7.0).alias("rounded"))
    out = clean.clip_columns(out, ["clipped"])
    return clean.round_columns(out, ["rounded"], 5)


# =====================================================================
# profiles

@register("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column, {R6(f'avg({c})', 4)} AS mean, {R6(f'stddev_samp({c})', 4)} AS std, "
    f"{R6(f'min({c})')} AS min, {R6(f'max({c})')} AS max, count({c}) AS count FROM lineitem" for c in LI_NUM))
def q_profile(spark, sf):
    p = profile.column_profile(T(spark, sf, "lineitem"), LI_NUM)
    return p.select("column", r6("mean", 4).alias("mean"), r6("std", 4).alias("std"),
                    r6("min").alias("min"), r6("max").alias("max"), "count")


def _corr_sql(a: str, b: str) -> str:
    return (f"covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)")


@register("corr_with_target", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R6(_corr_sql(c, 'l_extendedprice'))} AS corr "
    f"FROM (SELECT *, 5.0::DOUBLE AS const FROM lineitem) l" for c in ["l_quantity", "l_discount", "l_tax", "const"]))
def q_corr_target(spark, sf):
    c = profile.corr_with_target(lineitem_num(spark, sf), ["l_quantity", "l_discount", "l_tax", "const"],
                                 "l_extendedprice")
    return c.select("feature", r6("corr").alias("corr"))


CORR_COLS = LI_NUM + ["const"]


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + (f"{R6(f'CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END')}" if a == b else R6(_corr_sql(a, b)))
    + " AS corr FROM (SELECT *, 5.0::DOUBLE AS const FROM lineitem) l"
    for a in CORR_COLS for b in CORR_COLS))
def q_corr_matrix(spark, sf):
    m = profile.corr_matrix(lineitem_num(spark, sf), CORR_COLS)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))


@register("shape_and_nulls", f"""
WITH t AS ({ORDERS_TARGET_SQL}),
r AS (SELECT min(l_extendedprice) AS pmin, max(l_extendedprice) AS pmax, min(l_quantity) AS qmin,
             max(l_quantity) AS qmax FROM lineitem)
SELECT 'price' AS column, count(*) FILTER (WHERE price IS NULL) AS n_null,
       count(*) FILTER (WHERE price < pmin OR price > pmax) AS n_out_of_range, count(*) AS n_rows, 4::BIGINT AS n_cols
FROM t, r
UNION ALL
SELECT 'qty', count(*) FILTER (WHERE qty IS NULL), count(*) FILTER (WHERE qty < qmin OR qty > qmax), count(*), 4 FROM t, r
UNION ALL
SELECT 'cust', count(*) FILTER (WHERE cust IS NULL), NULL, count(*), 4 FROM t
""")
def q_shape(spark, sf):
    ref = T(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    s = profile.shape_and_nulls(orders_target(spark, sf), ["price", "qty", "cust"], reference=ref)
    return s.select("column", "n_null", "n_out_of_range", "n_rows", "n_cols")


# =====================================================================
# Planted predictions: long-form (dataset, model, split, label, prediction)

NAN = float("nan")


def planted_predictions(spark, sf) -> DataFrame:
    li = T(spark, sf, "lineitem")
    y1 = F.col("l_extendedprice") / 1000
    y2 = F.col("l_quantity")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    entries = [
        ("original", "Random Forest", y1, y1 + (d - 0.05) * 10),
        ("original", "Gradient Boosting", y1, y1 * (1 + t)),
        ("original", "SVR", y1, y1 + (q - 25) / 10),
        ("original", "Neural Network", y1, 0.9 * y1 + 5),
        ("original", "XGBoost", y1, F.lit(NAN)),
        ("synthetic", "Random Forest", y2, y2 + t * 10),
        ("synthetic", "Gradient Boosting", y2, y2 * (1 - d)),
        ("synthetic", "SVR", y2, y2 + 1),
    ]
    arr = F.array(*[F.struct(F.lit(ds).alias("dataset"), F.lit(m).alias("model"), y.cast("double").alias("label"),
                             p.cast("double").alias("prediction")) for ds, m, y, p in entries])
    split = F.when(F.col("l_returnflag") == "R", "val").otherwise("test")
    return li.select(*LI_KEYS, split.alias("split"), F.explode(arr).alias("e")).select(*LI_KEYS, "split", "e.*")


PLANTED_SQL = " UNION ALL ".join(
    f"SELECT {LI_KEYS_SQL}, CASE WHEN l_returnflag = 'R' THEN 'val' ELSE 'test' END AS split, "
    f"'{ds}' AS dataset, '{m}' AS model, ({y})::DOUBLE AS label, ({p})::DOUBLE AS prediction FROM lineitem"
    for ds, m, y, p in [
        ("original", "Random Forest", "l_extendedprice / 1000", "l_extendedprice / 1000 + (l_discount - 0.05) * 10"),
        ("original", "Gradient Boosting", "l_extendedprice / 1000", "l_extendedprice / 1000 * (1 + l_tax)"),
        ("original", "SVR", "l_extendedprice / 1000", "l_extendedprice / 1000 + (l_quantity - 25) / 10"),
        ("original", "Neural Network", "l_extendedprice / 1000", "0.9 * (l_extendedprice / 1000) + 5"),
        ("original", "XGBoost", "l_extendedprice / 1000", "'nan'::DOUBLE"),
        ("synthetic", "Random Forest", "l_quantity", "l_quantity + l_tax * 10"),
        ("synthetic", "Gradient Boosting", "l_quantity", "l_quantity * (1 - l_discount)"),
        ("synthetic", "SVR", "l_quantity", "l_quantity + 1"),
    ])


def evaluate_sql() -> str:
    per_split = (f"SELECT dataset, model, split, {R6(r2_sql('yv', 'ev'))} AS r2, {R6('avg(abs(ev))')} AS mae, "
                 f"{R6('sqrt(avg(ev*ev))')} AS rmse FROM (SELECT dataset, model, split, "
                 f"{nulled_sql('label', 'prediction')} FROM ({PLANTED_SQL}) pp) x GROUP BY dataset, model, split")
    cols = ", ".join(f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}"
                     for s in ("test", "val") for m in ("r2", "mae", "rmse"))
    return f"SELECT dataset, model, {cols} FROM ({per_split}) ps GROUP BY dataset, model"


def q_evaluate_df(spark, sf) -> DataFrame:
    ev = metrics.evaluate(planted_predictions(spark, sf), ["dataset", "model"])
    return round_metrics(ev, [c for c in ev.columns if c not in ("dataset", "model")])


register("evaluate", evaluate_sql())(q_evaluate_df)


@register("regression_metrics", f"""
SELECT dataset, model, split, {metric_cols_sql()}
FROM (SELECT dataset, model, split, {nulled_sql('label', 'prediction')} FROM ({PLANTED_SQL}) pp) x
GROUP BY dataset, model, split
""")
def q_regression_metrics(spark, sf):
    return round_metrics(metrics.regression_metrics(planted_predictions(spark, sf), ["dataset", "model", "split"]))


@register("r2_by_order", f"""
SELECT l_orderkey, {metric_cols_sql()}
FROM (SELECT l_orderkey, {nulled_sql('l_quantity', 'round(l_quantity * (1 + l_discount))')} FROM lineitem) x
GROUP BY l_orderkey
""")
def q_r2_by_order(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("label"),
                                         F.round(F.col("l_quantity") * (1 + F.col("l_discount"))).alias("prediction"))
    return round_metrics(metrics.regression_metrics(li, ["l_orderkey"]))


@register("axis_bounds", f"""
SELECT dataset, model, {R6('least(min(label), min(CASE WHEN NOT isnan(prediction) THEN prediction END))')} AS axis_min,
       {R6('greatest(max(label), max(CASE WHEN NOT isnan(prediction) THEN prediction END))')} AS axis_max
FROM ({PLANTED_SQL}) pp GROUP BY dataset, model
""")
def q_axis_bounds(spark, sf):
    b = metrics.axis_bounds(planted_predictions(spark, sf), ["dataset", "model"])
    return b.select("dataset", "model", r6("axis_min").alias("axis_min"), r6("axis_max").alias("axis_max"))


@register("actual_vs_predicted", f"""
WITH pp AS ({PLANTED_SQL}),
st AS (SELECT dataset, model, {r2_sql('yv', 'ev')} AS r2,
              least(min(label), min(CASE WHEN NOT isnan(prediction) THEN prediction END)) AS axis_min,
              greatest(max(label), max(CASE WHEN NOT isnan(prediction) THEN prediction END)) AS axis_max
       FROM (SELECT *, {nulled_sql('label', 'prediction')} FROM pp WHERE split = 'test') x
       GROUP BY dataset, model)
SELECT pp.l_orderkey, pp.l_linenumber, pp.dataset, pp.model, {R6('pp.label')} AS label,
       {R6("CASE WHEN isnan(pp.prediction) THEN NULL ELSE pp.prediction END")} AS prediction,
       {R6('st.r2')} AS r2, {R6('st.axis_min')} AS axis_min, {R6('st.axis_max')} AS axis_max
FROM pp JOIN st ON pp.dataset = st.dataset AND pp.model = st.model
WHERE pp.split = 'test'
""")
def q_actual_vs_predicted(spark, sf):
    pp = planted_predictions(spark, sf).where(F.col("split") == "test")
    a = metrics.actual_vs_predicted(pp, ["dataset", "model"])
    return a.select("l_orderkey", "l_linenumber", "dataset", "model", r6("label").alias("label"),
                    r6(F.nanvl("prediction", F.lit(None).cast("double"))).alias("prediction"),
                    *[r6(c).alias(c) for c in ("r2", "axis_min", "axis_max")])


# CV scores per dataset and model from the planted table: folds are the order line number.
def planted_fold_scores(spark, sf) -> DataFrame:
    return metrics.regression_metrics(planted_predictions(spark, sf), ["dataset", "model", "l_linenumber"]).select(
        "dataset", "model", F.col("l_linenumber").alias("fold"), "r2")


FOLD_SCORES_SQL = (f"SELECT dataset, model, l_linenumber AS fold, {r2_sql('yv', 'ev')} AS r2 FROM "
                   f"(SELECT dataset, model, l_linenumber, {nulled_sql('label', 'prediction')} FROM ({PLANTED_SQL}) pp) x "
                   "GROUP BY dataset, model, l_linenumber")

CV_SQL = (f"SELECT dataset, model, {R6('avg(r2)')} AS cv_mean, {R6('stddev_pop(r2)')} AS cv_std, count(r2) AS cv_folds "
          f"FROM ({FOLD_SCORES_SQL}) fs GROUP BY dataset, model")


# In the original flow the network has no cross-validation.
MODEL_CV_SQL = (f"SELECT model, cv_mean, cv_std, cv_folds FROM ({CV_SQL}) c WHERE dataset = 'original' "
                "AND model <> 'Neural Network'")


@register("cv_summary", CV_SQL)
def q_cv_summary(spark, sf):
    return round_metrics(metrics.cv_summary(planted_fold_scores(spark, sf), ["dataset", "model"]), ["cv_mean", "cv_std"])


RESULT_COLS = [f"{s}_{m}" for s in ("test", "val") for m in ("r2", "mae", "rmse")]


@register("results_table", f"""
WITH ev AS ({evaluate_sql()}), cv AS ({MODEL_CV_SQL})
SELECT ev.*, cv.cv_mean, cv.cv_std, cv.cv_folds,
       row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN isnan(test_r2) THEN NULL ELSE test_r2 END
                          DESC NULLS LAST, ev.model)::INTEGER AS rank
FROM ev LEFT JOIN cv ON ev.model = cv.model
""")
def q_results_table(spark, sf):
    ev = q_evaluate_df(spark, sf)
    fs = planted_fold_scores(spark, sf).where((F.col("dataset") == "original") & (F.col("model") != "Neural Network"))
    return ranking.results_table(ev, round_metrics(metrics.cv_summary(fs), ["cv_mean", "cv_std"]))


@register("rank_models", f"""
SELECT dataset, model, test_r2,
       row_number() OVER (PARTITION BY dataset ORDER BY test_r2 DESC NULLS LAST, model)::INTEGER AS rank
FROM ({evaluate_sql()}) ev
""")
def q_rank_models(spark, sf):
    return ranking.rank_models(q_evaluate_df(spark, sf).select("dataset", "model", "test_r2"))


@register("best_model", f"""
SELECT dataset, model AS best_model, test_r2 AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY test_r2 DESC NULLS LAST,
     CASE model WHEN 'Random Forest' THEN 1 WHEN 'Gradient Boosting' THEN 2 WHEN 'SVR' THEN 3
                WHEN 'Neural Network' THEN 4 WHEN 'XGBoost' THEN 5 ELSE 6 END, model) AS r
  FROM ({evaluate_sql()}) ev) x WHERE r = 1
""")
def q_best_model(spark, sf):
    return ranking.best_model(q_evaluate_df(spark, sf))


@register("compare_datasets", f"""
WITH ev AS ({evaluate_sql()})
SELECT o.model, o.test_r2 AS original_r2, o.test_mae AS original_mae, o.test_rmse AS original_rmse,
       s.test_r2 AS synthetic_r2, s.test_mae AS synthetic_mae, s.test_rmse AS synthetic_rmse,
       row_number() OVER (ORDER BY o.test_r2 DESC NULLS LAST, o.model) AS rank
FROM ev o JOIN ev s ON o.model = s.model WHERE o.dataset = 'original' AND s.dataset = 'synthetic'
""")
def q_compare_datasets(spark, sf):
    ev = q_evaluate_df(spark, sf)
    sel = lambda ds: ev.where(F.col("dataset") == ds).select(
        "model", F.col("test_r2").alias("r2"), F.col("test_mae").alias("mae"), F.col("test_rmse").alias("rmse"))
    return ranking.compare_datasets(sel("original"), sel("synthetic"))


@register("common_keys", f"""
WITH ev AS ({evaluate_sql()})
SELECT model, test_r2 FROM ev o WHERE dataset = 'original'
  AND model IN (SELECT model FROM ev WHERE dataset = 'synthetic')
""")
def q_common_keys(spark, sf):
    ev = q_evaluate_df(spark, sf)
    return clean.common_keys(ev.where(F.col("dataset") == "original").select("model", "test_r2"),
                             ev.where(F.col("dataset") == "synthetic"))


@register("tree_models_slug", f"""
SELECT dataset, model, lower(replace(model, ' ', '_')) AS slug, test_r2
FROM ({evaluate_sql()}) ev WHERE model IN ('Random Forest', 'Gradient Boosting', 'XGBoost')
""")
def q_tree_slug(spark, sf):
    ev = clean.tree_models_only(q_evaluate_df(spark, sf))
    return ev.select("dataset", "model", clean.display_name_slug("model").alias("slug"), "test_r2")


@register("chart_tables", f"""
WITH ev AS ({evaluate_sql()})
SELECT dataset, model, 'test_r2' AS metric, test_r2 AS value FROM ev
UNION ALL SELECT dataset, model, 'test_mae', test_mae FROM ev
UNION ALL SELECT dataset, model, 'test_rmse', test_rmse FROM ev
UNION ALL SELECT dataset, model, 'val_r2', coalesce(val_r2, 0.0) FROM ev
""")
def q_chart_tables(spark, sf):
    return ranking.chart_tables(q_evaluate_df(spark, sf))


@register("stack_splits", f"""
WITH h AS ({holdout_sql('SELECT o_orderkey FROM orders', 'o_orderkey')})
SELECT o_orderkey, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS split_order FROM h
""")
def q_stack_splits(spark, sf):
    h = sampling.holdout_split(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 42)
    return ranking.stack_splits(h.where(F.col("split") == "train").select("o_orderkey"),
                                h.where(F.col("split") == "test").select("o_orderkey"))


# history-shaped table from orders: config = priority, epoch = order key.
@register("best_epoch", f"""
WITH h AS (SELECT o_orderpriority AS config, o_orderkey AS epoch, o_totalprice / 1000 AS loss,
                  (o_totalprice / 1000) * (1 + (o_custkey % 10) / 100.0) AS val_loss FROM orders),
b AS (SELECT config, min(val_loss) AS best_val_loss, min(loss) AS best_loss, count(*) AS epochs FROM h GROUP BY config)
SELECT b.config, {R6('b.best_val_loss')} AS best_val_loss,
       (SELECT min(epoch) FROM h WHERE h.config = b.config AND h.val_loss = b.best_val_loss) AS best_epoch,
       {R6('b.best_loss')} AS best_loss, b.epochs FROM b
""")
def q_best_epoch(spark, sf):
    o = T(spark, sf, "orders")
    h = o.select(F.col("o_orderpriority").alias("config"), F.col("o_orderkey").alias("epoch"),
                 (F.col("o_totalprice") / 1000).alias("loss"),
                 ((F.col("o_totalprice") / 1000) * (1 + (F.col("o_custkey") % 10) / 100.0)).alias("val_loss"))
    b = metrics.best_epoch(h, ["config"])
    return b.select("config", r6("best_val_loss").alias("best_val_loss"), "best_epoch",
                    r6("best_loss").alias("best_loss"), "epochs")


# =====================================================================
# E6-E8 with the mean predictor (SQL-checkable experiment plumbing)

@register("cv_mean_predictor", f"""
WITH e AS ({EVENTS_NULLS_SQL}),
f AS ({kfold_sql('SELECT event_id, value FROM e', 'event_id', 5)}),
fs AS (SELECT fold, sum(value) AS s, count(value) AS c FROM f GROUP BY fold),
tot AS (SELECT sum(s) AS ts, sum(c) AS tc FROM fs),
mu AS (SELECT fold, (ts - s) / (tc - c)::DOUBLE AS mean FROM fs, tot)
SELECT f.fold, {metric_cols_sql()}
FROM (SELECT f.fold, {nulled_sql('f.value', 'mu.mean')} FROM f JOIN mu ON f.fold = mu.fold) f GROUP BY f.fold
""")
def q_cv_mean(spark, sf):
    return round_metrics(experiments.cv_mean_predictor(events_with_nulls(spark, sf).select("event_id", "value"),
                                                       ["event_id"], "value", 5))


@register("learning_curve_mean", f"""
WITH f AS ({kfold_sql('SELECT p_partkey, p_retailprice FROM part', 'p_partkey', 5)}),
c AS (SELECT max(n_) AS n, max(n_) // 5 AS q, max(n_) % 5 AS r FROM f),
sz AS (SELECT DISTINCT least(greatest(floor(fr * (n - (q + CASE WHEN r > 0 THEN 1 ELSE 0 END))), 1),
                             n - (q + CASE WHEN r > 0 THEN 1 ELSE 0 END))::BIGINT AS m
       FROM c, (SELECT unnest([{_fractions_sql()}]) AS fr) x),
cv AS (SELECT range::INTEGER AS cv_fold FROM range(5)),
mem AS (SELECT * FROM (SELECT f.p_retailprice AS y, cv.cv_fold, sz.m,
               row_number() OVER (PARTITION BY cv.cv_fold, sz.m ORDER BY f.pos_) AS rn
        FROM f, cv, sz WHERE f.fold <> cv.cv_fold) z WHERE rn <= m),
mu AS (SELECT cv_fold, m, avg(y) AS mean FROM mem GROUP BY cv_fold, m),
tr AS (SELECT mem.cv_fold, mem.m, {r2_sql('mem.y', '(mem.y - mu.mean)')} AS train_r2
       FROM mem JOIN mu ON mem.cv_fold = mu.cv_fold AND mem.m = mu.m GROUP BY mem.cv_fold, mem.m),
te AS (SELECT mu.cv_fold, mu.m, {r2_sql('f.p_retailprice', '(f.p_retailprice - mu.mean)')} AS test_r2
       FROM mu JOIN f ON f.fold = mu.cv_fold GROUP BY mu.cv_fold, mu.m)
SELECT tr.m AS train_size, {R6('avg(train_r2)')} AS train_mean, {R6('stddev_pop(train_r2)')} AS train_std,
       {R6('avg(test_r2)')} AS test_mean, {R6('stddev_pop(test_r2)')} AS test_std
FROM tr JOIN te ON tr.cv_fold = te.cv_fold AND tr.m = te.m GROUP BY tr.m
""")
def q_learning_curve_mean(spark, sf):
    from regimen.plans.experiments import learning_curve_mean
    part = T(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("label"))
    lc = learning_curve_mean(part, ["p_partkey"], "label", k=5)
    return round_metrics(lc, ["train_mean", "train_std", "test_mean", "test_std"])


@register("repeated_splits_mean", f"""
WITH ex AS (SELECT event_id, value, r.round, s.split FROM events,
            (SELECT range AS round FROM range(2)) r, (SELECT range AS split FROM range(5)) s),
k AS (SELECT *, row_number() OVER (PARTITION BY round, split
                                   ORDER BY md5(concat_ws('-', event_id, 42, round, split)), event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY round, split) AS n FROM ex),
t AS (SELECT *, pos < ceil(0.2::DOUBLE * n) AS is_test FROM k),
mu AS (SELECT round, split, avg(value) AS mean FROM t WHERE NOT is_test GROUP BY round, split),
sc AS (SELECT t.round, t.split, {r2_sql('t.value', '(t.value - mu.mean)')} AS score
       FROM t JOIN mu ON t.round = mu.round AND t.split = mu.split WHERE t.is_test GROUP BY t.round, t.split),
sc2 AS (SELECT mu.round, mu.split, {r2_sql('l.l_quantity', '(l.l_quantity - mu.mean)')} AS score2
        FROM mu, lineitem l GROUP BY mu.round, mu.split)
SELECT sc.round::INTEGER AS round, sc.split::INTEGER AS split, {R6('score')} AS score, {R6('score2')} AS score2,
       score > 0.89 AND score2 > 0.5 AS accepted
FROM sc JOIN sc2 ON sc.round = sc2.round AND sc.split = sc2.split
""")
def q_repeated_splits_mean(spark, sf):
    from regimen.plans.experiments import repeated_splits_mean
    ev = deal_up(T(spark, sf, "events").select("event_id", F.col("value").alias("label")))
    ext = T(spark, sf, "lineitem").select(F.col("l_quantity").alias("label"))
    out = repeated_splits_mean(ev, ["event_id"], "label", ext, n_rounds=2, n_splits=5)
    return out.select("round", "split", r6("score").alias("score"), r6("score2").alias("score2"), "accepted")


@register("best_split", f"""
WITH ex AS (SELECT event_id, value, r.round, s.split FROM events,
            (SELECT range AS round FROM range(2)) r, (SELECT range AS split FROM range(5)) s),
k AS (SELECT *, row_number() OVER (PARTITION BY round, split
                                   ORDER BY md5(concat_ws('-', event_id, 42, round, split)), event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY round, split) AS n FROM ex),
t AS (SELECT *, pos < ceil(0.2::DOUBLE * n) AS is_test FROM k),
mu AS (SELECT round, split, avg(value) AS mean FROM t WHERE NOT is_test GROUP BY round, split),
sc AS (SELECT t.round, t.split, {R6(r2_sql('t.value', '(t.value - mu.mean)'))} AS score
       FROM t JOIN mu ON t.round = mu.round AND t.split = mu.split WHERE t.is_test GROUP BY t.round, t.split)
SELECT round::INTEGER AS round, split::INTEGER AS split, score, (round * 5 + split)::INTEGER AS grid_index
FROM sc ORDER BY score DESC NULLS LAST, grid_index LIMIT 1
""")
def q_best_split(spark, sf):
    from regimen.plans.experiments import repeated_splits_mean
    ev = T(spark, sf, "events").select("event_id", F.col("value").alias("label"))
    out = repeated_splits_mean(ev, ["event_id"], "label", None, n_rounds=2, n_splits=5)
    grid = out.select("round", "split", r6("score").alias("score"),
                      (F.col("round") * 5 + F.col("split")).cast("int").alias("grid_index"))
    return ranking.best_params(grid, score="score", index_col="grid_index")


# =====================================================================
# synthesis

SYN_FEATURES = ["l_quantity", "l_discount", "l_tax"]
SYN_LABEL = "l_extendedprice"


def _u_sql(parts: str, start: int) -> str:
    return (f"((('0x' || substr(md5(concat_ws('-', {parts})), {start}, 13))::BIGINT + 1)::DOUBLE "
            f"/ 4503599627370497.0::DOUBLE)")


def _z_sql(parts: str) -> str:
    return f"(sqrt(-2.0 * ln({_u_sql(parts, 1)})) * cos(2.0 * pi() * {_u_sql(parts, 14)}))"


def synth_sql(seed: int = 42) -> str:
    keys = LI_KEYS_SQL
    st = ", ".join([f"avg({SYN_LABEL}) AS m_y", f"stddev_samp({SYN_LABEL}) AS s_y"] +
                   [f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, {_corr_sql(c, SYN_LABEL)} AS c_{c}"
                    for c in SYN_FEATURES])
    xs = ", ".join(f"m_{c} + 1.2 * s_{c} * {_z_sql(f'{keys}, ' + repr(c) + f', {seed}')} AS {c}"
                   for c in SYN_FEATURES)
    signal = " + ".join(f"coalesce(c_{c}, 0) * coalesce(({c} - m_{c}) / NULLIF(s_{c}, 0), 0)" for c in SYN_FEATURES)
    y = f"m_y + s_y * ({signal}) + 0.3 * s_y * {_z_sql(f'{keys}, ' + repr(SYN_LABEL) + f', {seed}')}"
    return (f"WITH st AS (SELECT {st} FROM lineitem), "
            f"x AS (SELECT {keys}, {xs}, st.* FROM lineitem CROSS JOIN st) "
            f"SELECT {keys}, {', '.join(f'{R6(c)} AS {c}' for c in SYN_FEATURES)}, "
            f"{R6(f'CASE WHEN ({y}) IS NULL THEN NULL ELSE greatest({y}, 0.0) END', 2)} AS {SYN_LABEL} FROM x")


def synthetic_lineitem(spark, sf) -> DataFrame:
    li = deal_up(T(spark, sf, "lineitem").select(*LI_KEYS, *SYN_FEATURES, SYN_LABEL))
    return synth.synthesize(li, SYN_FEATURES, SYN_LABEL, key_cols=LI_KEYS, seed=42)


@register("synthesize", synth_sql())
def q_synthesize(spark, sf):
    s = synthetic_lineitem(spark, sf)
    return s.select(*LI_KEYS, *[r6(c).alias(c) for c in SYN_FEATURES], r6(SYN_LABEL, 2).alias(SYN_LABEL))


def _fidelity_sql() -> str:
    cols = SYN_FEATURES + [SYN_LABEL]
    parts = []
    for c in cols:
        oc = "NULL::DOUBLE" if c == SYN_LABEL else _corr_sql(c, SYN_LABEL)
        parts.append(f"SELECT '{c}' AS column, avg(o.{c}) AS orig_mean, stddev_samp(o.{c}) AS orig_std, "
                     f"{oc.replace(c, 'o.' + c).replace(SYN_LABEL, 'o.' + SYN_LABEL) if c != SYN_LABEL else oc} "
                     f"AS orig_corr FROM lineitem o")
    orig = " UNION ALL ".join(parts)
    sparts = []
    for c in cols:
        sc = "NULL::DOUBLE" if c == SYN_LABEL else _corr_sql(c, SYN_LABEL)
        sparts.append(f"SELECT '{c}' AS column, avg({c}) AS syn_mean, stddev_samp({c}) AS syn_std, {sc} AS syn_corr "
                      f"FROM syn")
    syn = " UNION ALL ".join(sparts)
    return (f"WITH syn AS ({synth_sql()}), a AS ({orig}), b AS ({syn}) "
            f"SELECT a.column, {R6('syn_mean - orig_mean', 4)} AS d_mean, {R6('syn_std - orig_std', 4)} AS d_std, "
            f"{R6('syn_corr - orig_corr')} AS d_corr FROM a JOIN b ON a.column = b.column")


@register("synthetic_fidelity", _fidelity_sql())
def q_fidelity(spark, sf):
    li = T(spark, sf, "lineitem").select(*LI_KEYS, *SYN_FEATURES, SYN_LABEL)
    syn = q_synthesize(spark, sf)
    f = profile.fidelity(li, syn, SYN_FEATURES, SYN_LABEL)
    return f.select("column", r6("d_mean", 4).alias("d_mean"), r6("d_std", 4).alias("d_std"),
                    r6("d_corr").alias("d_corr"))


# =====================================================================
# Annotated text built from lineitem rows

def _doc_fields_strict() -> list[Column]:
    return [F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                              "l_extendedprice"]]


TEXT_COLS = ["orderkey", "linenumber", "quantity", "discount", "tax", "price"]
CRLF = "\r\n"


def annotated_docs(spark, sf, lenient: bool) -> DataFrame:
    li = deal_up(T(spark, sf, "lineitem"))
    ln = F.col("l_linenumber")
    toks = _doc_fields_strict()
    if lenient:
        toks[2] = F.when(ln == 2, F.lit("/")).otherwise(toks[2])
        toks[3] = F.when(ln == 3, F.lit("abc")).otherwise(toks[3])
        toks[4] = F.when(ln == 6, F.lit("")).otherwise(toks[4])
    line = F.concat_ws("\t", *toks)
    if lenient:
        line = (F.when(ln == 4, F.concat_ws("\t", *toks[:5]))
                .when(ln == 5, F.concat_ws("\t", *toks, F.lit("9")))
                .otherwise(line))
    pre = F.concat(F.lit("### lineitem "), F.col("l_orderkey").cast("string"), F.lit(CRLF),
                   F.lit(f"### -----{text.SENTINEL}----- ###{CRLF}{CRLF}"))
    body = F.concat(F.lit("\t"), line, F.lit(f"  {CRLF}{CRLF}"))
    doc = F.when(ln % 3 == 0, F.concat(line, F.lit(CRLF))).otherwise(F.concat(pre, body))
    return li.select(*LI_KEYS, doc.alias("text"))


@register("annotated_text_strict", """
SELECT CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS line_no,
       l_orderkey::DOUBLE AS orderkey, l_linenumber::DOUBLE AS linenumber, l_quantity AS quantity,
       l_discount AS discount, l_tax AS tax, l_extendedprice AS price
FROM lineitem
""")
def q_text_strict(spark, sf):
    docs = annotated_docs(spark, sf, lenient=False)
    return text.parse_annotated_text(docs, columns=TEXT_COLS, mode="strict").select("line_no", *TEXT_COLS)


@register("annotated_text_lenient", """
SELECT CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS line_no,
       l_orderkey::DOUBLE AS orderkey, l_linenumber::DOUBLE AS linenumber,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS tax,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS price,
       CASE WHEN l_linenumber = 5 THEN chr(9) || concat_ws(chr(9), l_orderkey, l_linenumber, l_quantity, l_discount,
                                                           l_tax, l_extendedprice, '9') || '  ' END AS _corrupt_record
FROM lineitem
""")
def q_text_lenient(spark, sf):
    docs = annotated_docs(spark, sf, lenient=True)
    return text.parse_annotated_text(docs, columns=TEXT_COLS, mode="lenient").select(
        "line_no", *TEXT_COLS, "_corrupt_record")


# =====================================================================
# Models on whole tables with planted labels

MODEL_FEATURES = ["l_quantity", "l_discount", "l_tax"]
STEP_SQL = "(CASE WHEN l_quantity > 25 THEN 10.0 ELSE 2.0 END)::DOUBLE"
LINE_SQL = "(3.0 * l_quantity + 100.0 * l_discount + 1.0)"
CUBIC_SQL = "(power(l_quantity / 10.0, 3) + 20.0 * l_tax)"


def planted_lineitem(spark, sf) -> DataFrame:
    li = T(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return li.select(*LI_KEYS, *MODEL_FEATURES,
                     F.when(q > 25, F.lit(10.0)).otherwise(F.lit(2.0)).alias("step"),
                     (F.lit(3.0) * q + F.lit(100.0) * F.col("l_discount") + F.lit(1.0)).alias("line"),
                     (F.pow(q / 10.0, 3) + F.lit(20.0) * F.col("l_tax")).alias("cubic"))


def _planted_sql(model: str, label_sql: str, pred_sql: str) -> str:
    return (f"SELECT {LI_KEYS_SQL}, '{model}' AS model, {label_sql} AS label, {pred_sql} AS prediction "
            f"FROM lineitem")


def _model_preds(model, d, label: str, name: str) -> DataFrame:
    from regimen.operators import models
    p = models.predict(model, d, label, LI_KEYS, name, "original", "train")
    return p.select(*LI_KEYS, "model", "label", "prediction")


@register("fit_random_forest", _planted_sql("Random Forest", STEP_SQL, STEP_SQL))
def q_fit_rf(spark, sf):
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.random_forest(MODEL_FEATURES, "step", num_trees=100, max_bins=64).fit(d)
    return _model_preds(m, d, "step", "Random Forest")


@register("fit_gbt", _planted_sql("Gradient Boosting", STEP_SQL, STEP_SQL))
def q_fit_gbt(spark, sf):
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.gbt(MODEL_FEATURES, "step", max_bins=64).fit(d)
    return _model_preds(m, d, "step", "Gradient Boosting")


@register("fit_gbt_stochastic", f"""
SELECT {LI_KEYS_SQL}, 'XGBoost' AS model, {STEP_SQL} AS label, {STEP_SQL} AS rounded FROM lineitem
""")
def q_fit_gbt_stochastic(spark, sf):
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.gbt_stochastic(MODEL_FEATURES, "step", max_bins=64).fit(d)
    p = _model_preds(m, d, "step", "XGBoost")
    return p.select(*LI_KEYS, "model", "label", F.round("prediction").alias("rounded"))


@register("fit_svr_linear", f"""
SELECT {LI_KEYS_SQL}, 'SVR' AS model, {LINE_SQL} AS label, TRUE AS within_tube FROM lineitem
""")
def q_fit_svr_linear(spark, sf):
    from regimen.operators import solvers
    d = planted_lineitem(spark, sf)
    m = solvers.SVR(MODEL_FEATURES, "line", kernel="linear", C=1.0, epsilon=0.1).fit(deal_up(d))
    p = _model_preds(m, d, "line", "SVR")
    return p.select(*LI_KEYS, "model", "label",
                    (F.abs(F.col("prediction") - F.col("label")) <= F.lit(0.1 + 1e-3)).alias("within_tube"))


@register("fit_svr_poly", f"""
SELECT {LI_KEYS_SQL}, 'SVR' AS model, {CUBIC_SQL} AS label, TRUE AS within_tube FROM lineitem
""")
def q_fit_svr_poly(spark, sf):
    from regimen.operators import solvers
    d = planted_lineitem(spark, sf)
    m = solvers.SVR(MODEL_FEATURES, "cubic", kernel="poly", degree=3, C=1.0, epsilon=0.1).fit(deal_up(d))
    p = _model_preds(m, d, "cubic", "SVR")
    return p.select(*LI_KEYS, "model", "label",
                    (F.abs(F.col("prediction") - F.col("label")) <= F.lit(0.1 + 1e-2)).alias("within_tube"))


def _explains(preds: DataFrame, least: float) -> DataFrame:
    """Whether the predictions of the whole table reach an R^2, beside every row."""
    r2 = metrics.regression_metrics(preds, ["model"]).select("model", (F.col("r2") > F.lit(least)).alias("explains"))
    return preds.join(F.broadcast(r2), "model").select(*LI_KEYS, "model", "label", "explains")  # one row a model


@register("fit_svr_rbf", f"""
SELECT {LI_KEYS_SQL}, 'SVR' AS model, {STEP_SQL} AS label, TRUE AS explains FROM lineitem
""")
def q_fit_svr_rbf(spark, sf):
    """M5: SVR over 256 Nystrom landmarks, up to 20 rounds, explains most of the step label (R^2 > 0.85: with C = 1 the
    smooth kernel rounds the step off)."""
    from regimen.operators import solvers
    d = planted_lineitem(spark, sf)
    m = solvers.SVR(MODEL_FEATURES, "step", kernel="rbf", keep_table=True).fit(deal_up(d))
    return _explains(_model_preds(m, d, "step", "SVR"), 0.85)


def _network(d):
    from regimen.operators import solvers
    return solvers.MLPRegressor(MODEL_FEATURES, "line", validation_col="is_val").fit(deal_up(d))


@register("fit_mlp", f"""
SELECT {LI_KEYS_SQL}, 'Neural Network' AS model, {LINE_SQL} AS label, TRUE AS explains FROM lineitem
""")
def q_fit_mlp(spark, sf):
    """M7/M8: the network on the linear label, early stopping on the rows of
    line number 1, up to 100 epochs; it explains the line (R^2 > 0.99)."""
    d = planted_lineitem(spark, sf).withColumn("is_val", F.col("l_linenumber") == 1)
    return _explains(_model_preds(_network(d), d, "line", "Neural Network"), 0.99)


@register("training_history", """
SELECT 'Neural Network' AS model, TRUE AS starts_at_one, TRUE AS no_gaps, TRUE AS loss_fell, TRUE AS best_is_lowest
FROM (SELECT count(*) AS n FROM lineitem) t WHERE n > 0
""")
def q_training_history(spark, sf):
    """M9 + A10: the network's history has one row an epoch, its loss falls,
    and the best epoch has the lowest validation loss."""
    d = planted_lineitem(spark, sf).withColumn("is_val", F.col("l_linenumber") == 1)
    h = _network(d).history_frame()
    both = h.join(metrics.best_epoch(h, ["model"]).select("model", "best_epoch"), "model")
    last = F.max_by("loss", "epoch")
    return both.groupBy("model").agg(
        (F.min("epoch") == 1).alias("starts_at_one"), (F.max("epoch") == F.count("*")).alias("no_gaps"),
        (last < F.min_by("loss", "epoch")).alias("loss_fell"),
        (F.min("val_loss") == F.max(F.when(F.col("epoch") == F.col("best_epoch"), F.col("val_loss")))).alias("best_is_lowest"))


@register("feature_importance", """
SELECT * FROM (VALUES ('Random Forest', 'l_quantity', 1.0::DOUBLE, 1),
                      ('Random Forest', 'l_discount', 0.0::DOUBLE, 2),
                      ('Random Forest', 'l_tax', 0.0::DOUBLE, 3)) t(model, feature, importance, rank)
""")
def q_feature_importance(spark, sf):
    """M11 + W3: only the planted feature carries importance."""
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.random_forest(MODEL_FEATURES, "step", max_bins=64).fit(d)
    imp = models.feature_importance(m, MODEL_FEATURES, "Random Forest")
    return ranking.rank_importance(imp).select("model", "feature", r6("importance").alias("importance"), "rank")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    import uuid
    from regimen.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/regimen-io/{name}-{uuid.uuid4().hex}"


@register("save_load_model", _planted_sql("Random Forest", STEP_SQL, STEP_SQL))
def q_save_load(spark, sf):
    """Persist under a score-derived name, load back, predict."""
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.random_forest(MODEL_FEATURES, "step", max_bins=64).fit(d)
    base = shared_path(spark, "models")
    path = tables.save_model(m, base, "random_forest", 1.0, registry=f"{base}/registry")
    return _model_preds(tables.load_model(path), d, "step", "Random Forest")


@register("csv_roundtrip", f"""
SELECT {', '.join(LI_NUM)} FROM lineitem
""")
def q_csv_roundtrip(spark, sf):
    """S3 + S5: header CSV written in parallel parts and read back as doubles."""
    path = shared_path(spark, "csv")
    tables.write_table_csv(T(spark, sf, "lineitem").select(*LI_NUM), path)
    return tables.read_table_csv(spark, path, LI_NUM)


@register("tsv_roundtrip", f"""
SELECT {', '.join(LI_NUM)} FROM lineitem
""")
def q_tsv_roundtrip(spark, sf):
    """Headerless tab-separated rows read with a fixed schema."""
    path = shared_path(spark, "tsv")
    T(spark, sf, "lineitem").select(*LI_NUM).write.option("sep", "\t").option("header", False) \
        .option("lineSep", "\r\n").csv(path)
    return tables.read_table_tsv(spark, path, LI_NUM)


@register("synthetic_roundtrip", synth_sql())
def q_synthetic_roundtrip(spark, sf):
    """The synthetic table persisted (parquet) and read back."""
    path = shared_path(spark, "synthetic")
    synth.write_synthetic(synthetic_lineitem(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select(*LI_KEYS, *[r6(c).alias(c) for c in SYN_FEATURES], r6(SYN_LABEL, 2).alias(SYN_LABEL))


# =====================================================================
# Experiments over the whole `part` table (rows-only checks:
# model quality is not SQL; the plumbing is SQL-checked above with the
# mean predictor)

PART_FEATURES = ["p_size", "p_retailprice"]


def planted_part(spark, sf) -> DataFrame:
    p = T(spark, sf, "part")
    y = (F.when(F.col("p_size") > 25, F.lit(10.0)).otherwise(F.lit(2.0))
         + (F.col("p_retailprice") - F.lit(900.0)) / F.lit(50.0))
    return p.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", y.alias("y"))


def step_part(spark, sf) -> DataFrame:
    """``part`` with a step label that trees recover exactly (every size
    value is a candidate threshold with 64 bins), so model CV and grid
    searches have an exact SQL answer."""
    p = T(spark, sf, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
                    F.when(F.col("p_size") > 25, F.lit(10.0)).otherwise(F.lit(2.0)).alias("y"))


@register("compare_models", """
SELECT m.model, TRUE AS explains, TRUE AS one_a_rank, 4::BIGINT AS models FROM (VALUES ('Random Forest'), ('Gradient Boosting'), ('SVR'),
       ('Neural Network')) m(model) WHERE (SELECT count(*) FROM part) > 0
""")
def q_compare_models(spark, sf):
    """E1 + E2: the suite with its own parameters (100 trees, 100 rounds, 256 landmarks, up to 100 epochs) on one
    exact hold-out; every model explains the planted label (R^2 over 0.95 for trees, 0.8 for the SVR, 0.6 for the
    network) and each has a rank of its own."""
    from regimen.plans import suite
    d = planted_part(spark, sf)
    s = materialize(deal_up(sampling.holdout_split(d, ["p_partkey"], 0.2, 42)))
    _, wide, _ = suite.compare_models(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"),
                                      suite.default_suite(PART_FEATURES, "y"), "y", ["p_partkey"])
    ranked = ranking.results_table(wide)
    least = F.when(F.col("model") == suite.SVR_NAME, 0.8).when(F.col("model") == suite.NN, 0.6).otherwise(0.95)
    return ranked.select("model", (F.col("test_r2") > least).alias("explains"),
                         (F.count("*").over(Window.partitionBy("rank")) == 1).alias("one_a_rank"),
                         F.count("*").over(Window.partitionBy(F.col("rank") > 0)).alias("models"))


@register("grid_search_holdout", """
SELECT n.i * 9 + r.i * 3 + d.i AS grid_index, max_iter, learning_rate, max_depth, TRUE AS explains, TRUE AS rounds_help,
       CASE WHEN n.i = 2 AND r.i = 2 AND d.i = 0 THEN TRUE END AS is_best
FROM (VALUES ('50', 0::BIGINT), ('100', 1), ('200', 2)) n(max_iter, i),
     (VALUES ('0.05', 0::BIGINT), ('0.1', 1), ('0.2', 2)) r(learning_rate, i), (VALUES ('3', 0::BIGINT), ('5', 1), ('7', 2)) d(max_depth, i)
WHERE (SELECT count(*) FROM part) > 0
""")
def q_grid_holdout(spark, sf):
    """E3 + W4: the boosted-tree grid (rounds x rate x depth, 27 points) scored on train and on the hold-out of
    ``part``, whose label is a wave plus a slope; the most rounds at the largest rate over the flattest trees win.
    ``rounds_help``: with more rounds and all else equal, the training score never falls."""
    from regimen.operators import models
    from regimen.plans import suite
    s = compact(materialize(sampling.holdout_split(part_with(spark, sf, WAVE), ["p_partkey"], 0.2, 42)))
    table, best = suite.grid_search_boosted(
        s.where(F.col("split") == "train"), s.where(F.col("split") == "test"),
        lambda max_iter, learning_rate, max_depth: models.gbt(PART_FEATURES, "y", max_iter=max_iter, step_size=learning_rate,
                                                              max_depth=max_depth, max_bins=64),
        {"max_iter": [50, 100, 200], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7]}, "y")
    before = F.lag("train_r2").over(Window.partitionBy("learning_rate", "max_depth").orderBy(F.col("max_iter").cast("int")))
    out = table.join(best.select("grid_index", F.lit(True).alias("is_best")), "grid_index", "left")
    return out.select("grid_index", "max_iter", "learning_rate", "max_depth",
                      (F.least("train_r2", "val_r2") > 0.98).alias("explains"),
                      (F.col("train_r2") >= F.coalesce(before, F.lit(0.0)) - 1e-9).alias("rounds_help"), "is_best")


@register("grid_search_cv", """
SELECT n.i * 16 + d.i * 8 + r.i * 4 + s.i * 2 + c.i AS grid_index, max_iter, max_depth, learning_rate, subsample, colsample,
       3::BIGINT AS cv_folds, n.i + d.i + r.i = 0 AS lags, CASE WHEN n.i = 1 AND d.i = 1 AND r.i = 1 THEN TRUE ELSE FALSE END AS can_win
FROM (VALUES ('5', 0::BIGINT), ('10', 1)) n(max_iter, i), (VALUES ('3', 0::BIGINT), ('5', 1)) d(max_depth, i),
     (VALUES ('0.25', 0::BIGINT), ('0.5', 1)) r(learning_rate, i), (VALUES ('0.8', 0::BIGINT), ('1.0', 1)) s(subsample, i),
     (VALUES ('0.8', 0::BIGINT), ('1.0', 1)) c(colsample, i)
WHERE (SELECT count(*) FROM part) > 0
""")
def q_grid_cv(spark, sf):
    """The boosted grid (rounds x depth x rate x row and column sampling, 32 points) by 3-fold CV R^2 on ``part`` whose
    label is a wave plus a slope.  Rounds and rates are scaled to a tenth and five times the original's.  ``can_win``: the
    winner has the most rounds, depth and rate (which sampling it has is chance); ``lags``: of the
    points with its sampling, this one (fewest rounds, least depth, lowest rate) has the lowest score."""
    from regimen.operators import models
    from regimen.plans import suite
    folded = sampling.kfold_contiguous(part_with(spark, sf, WAVE), ["p_partkey"], 3)
    table, best = suite.grid_search_boosted_cv(
        folded, lambda max_iter, max_depth, learning_rate, subsample, colsample: models.gbt(
            PART_FEATURES, "y", max_iter=max_iter, max_depth=max_depth, step_size=learning_rate, subsample=subsample,
            colsample=colsample, max_bins=64),
        {"max_iter": [5, 10], "max_depth": [3, 5], "learning_rate": [0.25, 0.5], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0]}, "y", 3)
    keys = ["max_iter", "max_depth", "learning_rate"]
    won = best.select(*keys, F.lit(True).alias("won"))
    out = table.join(won, keys, "left")
    return out.select("grid_index", "max_iter", "max_depth", "learning_rate", "subsample", "colsample", "cv_folds",
                      (F.col("cv_mean") == F.min("cv_mean").over(Window.partitionBy("subsample", "colsample"))).alias("lags"), F.coalesce("won", F.lit(False)).alias("can_win"))


SHIFTED = "(p_size - 25) / 10.0 + (p_retailprice - 900) / 300.0"
WAVE = "3 * sin(p_size / 6.0) + (p_retailprice - 900) / 300.0"


def part_with(spark, sf, label_sql: str) -> DataFrame:
    p = T(spark, sf, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.expr(label_sql).alias("y"))


@register("grid_search_mlp", """
SELECT g.*, 32 AS batch_size, 10 AS patience, TRUE AS learned, TRUE AS slow_rate_trails,
       CASE WHEN grid_index = 4 THEN TRUE END AS is_best
FROM (VALUES (0::BIGINT, '[32, 16]', 0.1::DOUBLE, 0.01::DOUBLE), (1, '[32, 16]', 0.1, 0.001), (2, '[32, 16]', 0.2, 0.01),
             (3, '[32, 16]', 0.2, 0.001), (4, '[64, 32]', 0.1, 0.01), (5, '[64, 32]', 0.1, 0.001), (6, '[64, 32]', 0.2, 0.01),
             (7, '[64, 32]', 0.2, 0.001)) g(grid_index, hidden_layers, dropout_rate, learning_rate)
WHERE (SELECT count(*) FROM part) > 0
""")
def q_grid_mlp(spark, sf):
    """E5: the reduced network grid (layers x dropout x rate x batch), 50 epochs with patience 10, all eight trained
    together on ``part``; the least validation loss wins: the wide network with little dropout and the fast
    rate.  ``learned``: the validation loss is under a twentieth of the label's variance, in at most 50 epochs;
    ``slow_rate_trails``: the same network with the slow rate has the larger validation loss."""
    from regimen.plans import suite
    s = materialize(deal_up(sampling.holdout_split(part_with(spark, sf, SHIFTED), ["p_partkey"], 0.2, 42)))
    train, val = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    log, best, _ = suite.grid_search_networks(train, val, PART_FEATURES, "y", {
        "hidden_layers": [[32, 16], [64, 32]], "dropout_rate": [0.1, 0.2], "learning_rate": [0.01, 0.001], "batch_size": [32]})
    spread = s.agg(F.var_pop("y").alias("spread"))
    pair = Window.partitionBy("hidden_layers", "dropout_rate")
    out = log.join(best.select("grid_index", F.lit(True).alias("is_best")), "grid_index", "left").crossJoin(F.broadcast(spread))
    return out.select(  # one row of statistics beside a row a point
        "grid_index", F.col("hidden_layers").cast("string").alias("hidden_layers"), "dropout_rate", "learning_rate", "batch_size",
        "patience", ((F.col("val_loss") < F.col("spread") / 20) & F.col("epochs_trained").between(10, 50)).alias("learned"),
        (F.max(F.when(F.col("learning_rate") == 0.01, F.col("val_loss"))).over(pair)
         < F.min(F.when(F.col("learning_rate") == 0.001, F.col("val_loss"))).over(pair)).alias("slow_rate_trails"), "is_best")


@register("cross_validate_suite", f"""
WITH f AS ({kfold_sql('SELECT p_partkey FROM part', 'p_partkey', 5)}),
c AS (SELECT fold, count(*) AS n FROM f GROUP BY fold)
SELECT m.model, c.fold, c.n, CASE WHEN m.model <> 'SVR' THEN 1.0::DOUBLE END AS r2, CASE WHEN m.model <> 'SVR' THEN 0.0::DOUBLE END AS rmse,
       CASE WHEN m.model <> 'SVR' THEN 1.0::DOUBLE END AS cv_mean, 5::BIGINT AS cv_folds, TRUE AS explains, TRUE AS fits_summary
FROM c CROSS JOIN (VALUES ('Random Forest'), ('Gradient Boosting'), ('SVR')) m(model)
""")
def q_cv_suite(spark, sf):
    """E6 + A8 + J2: fold scores of forest (100 trees), boosted trees (100 rounds) and scaler + SVR (rbf) on contiguous
    folds, summarised per model.  Trees recover the planted step in every fold; the SVR explains most of it (R^2 > 0.8).
    ``fits_summary``: a fold's score lies within the summary's mean and spread (no score is farther from the mean
    than sqrt(k - 1) deviations)."""
    from regimen.operators import models
    from regimen.plans import suite
    folded = deal_up(sampling.kfold_contiguous(step_part(spark, sf), ["p_partkey"], 5))
    ests = suite.default_suite(PART_FEATURES, "y")
    ests = {suite.RF: models.random_forest(PART_FEATURES, "y", max_bins=64), suite.GB: models.gbt(PART_FEATURES, "y", max_bins=64),
            suite.SVR_NAME: ests[suite.SVR_NAME]}
    scores = materialize(suite.cross_validate_suite(folded, ests, "y", 5))
    out = scores.join(metrics.cv_summary(scores), "model")
    tree = F.col("model") != suite.SVR_NAME
    return out.select("model", "fold", "n", *[F.when(tree, r6(c)).alias(c) for c in ("r2", "rmse", "cv_mean")], "cv_folds",
                      (F.col("r2") > 0.8).alias("explains"),
                      (F.abs(F.col("r2") - F.col("cv_mean")) <= 2 * F.col("cv_std") + 1e-9).alias("fits_summary"))


@register("learning_curve", """
WITH c AS (SELECT count(*) - CAST(ceil(count(*) / 5.0) AS BIGINT) AS n_max FROM part)
SELECT CAST(floor((0.1 + 0.1 * i)::DOUBLE * n_max + 1e-9) AS BIGINT) AS train_size, TRUE AS learns, TRUE AS spread_ok
FROM c, range(10) t(i)
""")
def q_learning_curve(spark, sf):
    """Boosted trees (20 rounds) on the ten growing prefixes of the first-fold training size; held-out scores
    are good at every size."""
    from regimen.operators import models
    from regimen.plans import suite
    out = suite.learning_curve(planted_part(spark, sf), ["p_partkey"], models.gbt(PART_FEATURES, "y", max_iter=20), "y", k=5,
                               parallelism=8)
    return out.select("train_size", ((F.col("test_mean") > 0.8) & (F.col("train_mean") > 0.8)).alias("learns"),
                      ((F.col("test_std") < 0.1) & (F.col("train_std") < 0.1)).alias("spread_ok"))


@register("repeated_splits", """
SELECT r::INTEGER AS round, s::INTEGER AS split, 1.0::DOUBLE AS score, 1.0::DOUBLE AS score2, TRUE AS accepted,
       printf('%d    %d  %.5f    %.5f', r, s, 1.0, 1.0) AS record
FROM range(2) a(r), range(5) b(s) WHERE (SELECT count(*) FROM part) > 0
""")
def q_repeated_splits(spark, sf):
    """E8 + P5 + S6: a forest of 100 trees per shuffled split of ``part`` (2 rounds of 5), scored on its
    test rows and on ``lineitem`` as the external table (quantity as size);
    the planted step is recovered, so every run is accepted."""
    from regimen.operators import models
    from regimen.plans import suite
    d = step_part(spark, sf)
    li = T(spark, sf, "lineitem")
    ext = li.select(F.col("l_quantity").alias("p_size"), (F.col("l_extendedprice") / 50.0).alias("p_retailprice"),
                    F.when(F.col("l_quantity") > 25, F.lit(10.0)).otherwise(F.lit(2.0)).alias("y"))
    runs = suite.repeated_splits(d, ["p_partkey"], models.random_forest(PART_FEATURES, "y", max_bins=64), "y", ext, n_rounds=2,
                                 n_splits=5)
    return runs.select("round", "split", r6("score").alias("score"), r6("score2").alias("score2"), "accepted",
                       tables.run_record().alias("record"))


@register("original_vs_synthetic", """
SELECT m.model, TRUE AS explains_original, TRUE AS scored_synthetic, TRUE AS one_a_rank,
       CASE WHEN m.model <> 'Neural Network' THEN 3::BIGINT END AS cv_folds, TRUE AS external_scored
FROM (VALUES ('Random Forest'), ('Gradient Boosting'), ('SVR'), ('Neural Network')) m(model) WHERE (SELECT count(*) FROM part) > 0
""")
def q_original_vs_synthetic(spark, sf):
    """E9 + D6 + J1: the suite (forest of 20 trees, 20 boosting rounds, SVR, network) on the table and on a synthetic draw
    of it, both validated on ``lineitem`` as the external table and, but for the network, cross-validated; on the original
    the trees explain the label (R^2 > 0.8) and the others most of it (R^2 > 0.6)."""
    from regimen.operators import models
    from regimen.plans import suite
    d = deal_up(planted_part(spark, sf))

    def build():
        full = suite.default_suite(PART_FEATURES, "y")
        return {suite.RF: models.random_forest(PART_FEATURES, "y", num_trees=20, max_depth=10),
                suite.GB: models.gbt(PART_FEATURES, "y", max_iter=20), suite.SVR_NAME: full[suite.SVR_NAME], suite.NN: full[suite.NN]}

    li = T(spark, sf, "lineitem")
    size, price = F.col("l_quantity"), F.col("l_extendedprice") / 50.0
    ext = li.select(size.alias("p_size"), price.alias("p_retailprice"),
                    (F.when(size > 25, 10.0).otherwise(2.0) + (price - 900.0) / 50.0).alias("y"))
    out, tables_ = suite.original_vs_synthetic(d, ext, PART_FEATURES, "y", ["p_partkey"], build, k=3)
    sides = tables_["original"].unionByName(tables_["synthetic"]).groupBy("model").agg(
        F.min("cv_folds").alias("cv_folds"), (F.count("val_r2") == 2).alias("external_scored"))
    least = F.when(F.col("model").isin(suite.RF, suite.GB), 0.8).otherwise(0.6)
    return out.join(sides, "model").select(
        "model", (F.col("original_r2") > least).alias("explains_original"),
        F.col("synthetic_r2").between(-1.0, 1.0).alias("scored_synthetic"),
        (F.count("*").over(Window.partitionBy("rank")) == 1).alias("one_a_rank"), "cv_folds", "external_scored")


@register("fit_gbt_early_stopping", _planted_sql("Gradient Boosting", STEP_SQL, STEP_SQL))
def q_fit_gbt_early_stopping(spark, sf):
    """M2 + M8 for trees: boosting stops once the validation rows (line
    number 1) stop improving; the step is still recovered exactly."""
    from regimen.operators import models
    d = planted_lineitem(spark, sf).withColumn("is_val", F.col("l_linenumber") == 1)
    m = models.gbt(MODEL_FEATURES, "step", max_iter=100, max_bins=64, validation_col="is_val").fit(d)
    return _model_preds(m, d, "step", "Gradient Boosting")


@register("split_features_label", f"""
SELECT {LI_KEYS_SQL}, 3 AS n_features, concat_ws(',', l_quantity, l_extendedprice, l_discount) AS features,
       l_tax AS label FROM lineitem
""")
def q_split_features_label(spark, sf):
    """The last column is the label, the columns before it the features."""
    li = T(spark, sf, "lineitem").select(*LI_KEYS, *LI_NUM)
    features, label = clean.split_features_label(LI_NUM)
    return li.select(*LI_KEYS, F.lit(len(features)).alias("n_features"),
                     F.concat_ws(",", *[F.col(c).cast("string") for c in features]).alias("features"),
                     F.col(label).alias("label"))


@register("compare_models_trees", """
SELECT 'original' AS dataset, m.model, 1.0::DOUBLE AS test_r2, 0.0::DOUBLE AS test_mae, 0.0::DOUBLE AS test_rmse,
       1.0::DOUBLE AS val_r2, 0.0::DOUBLE AS val_mae, 0.0::DOUBLE AS val_rmse, m.rank
FROM (VALUES ('Gradient Boosting', 1), ('Random Forest', 2)) m(model, rank)
""")
def q_compare_models_trees(spark, sf):
    """E1 + E2 + W1 with the tree models: fitted on the hold-out's training
    rows of ``part``, scored on its test rows and on ``lineitem`` as the
    external validation table; the planted step makes every score exact."""
    from regimen.operators import models
    from regimen.plans import suite
    d = step_part(spark, sf)
    li = T(spark, sf, "lineitem")
    ext = li.select(F.col("l_quantity").alias("p_size"), (F.col("l_extendedprice") / 50.0).alias("p_retailprice"),
                    F.when(F.col("l_quantity") > 25, F.lit(10.0)).otherwise(F.lit(2.0)).alias("y"))
    s = materialize(sampling.holdout_split(d, ["p_partkey"], 0.2, 42))
    ests = {suite.RF: models.random_forest(PART_FEATURES, "y", num_trees=20, max_depth=10, max_bins=64),
            suite.GB: models.gbt(PART_FEATURES, "y", max_iter=10, max_bins=64)}
    _, wide, _ = suite.compare_models(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"),
                                      ests, "y", ["p_partkey"], validation=ext)
    ranked = ranking.results_table(wide)
    return ranked.select("dataset", "model", *[r6(c).alias(c) for c in RESULT_COLS], "rank")


@register("chart_cv", f"""
SELECT dataset, model, cv_mean AS center, {R6('cv_mean - cv_std')} AS low, {R6('cv_mean + cv_std')} AS high
FROM ({CV_SQL}) c
""")
def q_chart_cv(spark, sf):
    """The CV chart's bars with their error bars."""
    b = ranking.chart_bands(q_cv_summary(spark, sf), ["dataset", "model"], "cv_mean", "cv_std")
    return b.select("dataset", "model", "center", r6("low").alias("low"), r6("high").alias("high"))


@register("chart_learning_curve", f"""
SELECT train_size, part, center, {R6('center - width')} AS low, {R6('center + width')} AS high FROM (
  SELECT train_size, 'train' AS part, train_mean AS center, train_std AS width FROM ({ORACLES['learning_curve_mean']}) a
  UNION ALL SELECT train_size, 'test', test_mean, test_std FROM ({ORACLES['learning_curve_mean']}) b) x
""")
def q_chart_learning_curve(spark, sf):
    """The learning curve's two lines with their bands."""
    c = materialize(QUERIES["learning_curve_mean"](spark, sf))
    both = [ranking.chart_bands(c, ["train_size"], f"{p}_mean", f"{p}_std").withColumn("part", F.lit(p))
            for p in ("train", "test")]
    return both[0].unionByName(both[1]).select("train_size", "part", "center", r6("low").alias("low"),
                                               r6("high").alias("high"))


@register("chart_importance", """
SELECT 'Random Forest' AS model, f.feature, f.importance, f.position FROM (VALUES ('l_quantity', 1.0::DOUBLE, 0),
       ('l_discount', 0.0::DOUBLE, 1), ('l_tax', 0.0::DOUBLE, 2)) f(feature, importance, position)
WHERE (SELECT count(*) FROM lineitem) > 0
""")
def q_chart_importance(spark, sf):
    """Importances in drawing order."""
    return ranking.chart_importance(QUERIES["feature_importance"](spark, sf))


@register("chart_history", """
SELECT 'Gradient Boosting' AS model, e::INTEGER AS epoch, 'loss' AS metric, 0.0::DOUBLE AS value FROM range(1, 6) t(e)
""")
def q_chart_history(spark, sf):
    """A training history as long rows; a metric that a model lacks draws nothing."""
    h = QUERIES["gbt_history"](spark, sf).withColumn("val_loss", F.lit(None).cast("double"))
    return ranking.chart_tables(h, ["model", "epoch"], ["loss", "val_loss"], zero_missing=()).where("value is not null")


@register("gbt_history", """
SELECT 'Gradient Boosting' AS model, e::INTEGER AS epoch, 0.0::DOUBLE AS loss FROM range(1, 6) t(e)
""")
def q_gbt_history(spark, sf):
    """M9 for boosted trees: squared error after each round on the whole
    table; the first tree already recovers the planted step."""
    from regimen.operators import models
    d = planted_lineitem(spark, sf)
    m = models.gbt(MODEL_FEATURES, "step", max_iter=5, max_bins=64).fit(d)
    h = models.training_history_gbt(m, d, "Gradient Boosting")
    return h.select("model", "epoch", r6("loss").alias("loss"))


SVR_GRID = {"kernel": ["rbf", "linear"], "C": [0.1, 1.0, 10.0], "epsilon": [0.1, 0.2], "gamma": ["scale", "auto"]}


@register("grid_search_svr", """
SELECT k.i * 12 + c.i * 4 + e.i * 2 + g.i AS grid_index, kernel, "C", epsilon, gamma, 3::BIGINT AS cv_folds,
       kernel = 'rbf' AS explains, CASE WHEN k.i = 0 AND c.i = 2 AND e.i = 0 AND g.i = 0 THEN TRUE END AS is_best, TRUE AS refitted
FROM (VALUES ('rbf', 0::BIGINT), ('linear', 1)) k(kernel, i), (VALUES ('0.1', 0::BIGINT), ('1.0', 1), ('10.0', 2)) c("C", i),
     (VALUES ('0.1', 0::BIGINT), ('0.2', 1)) e(epsilon, i), (VALUES ('scale', 0::BIGINT), ('auto', 1)) g(gamma, i)
WHERE (SELECT count(*) FROM part) > 0
""")
def q_grid_svr(spark, sf):
    """E4 for SVR: the reduced grid (kernel x C x epsilon x gamma, 24 points) by 3-fold CV on ``part`` whose label is a
    wave in the size: only the rbf kernel explains it (R^2 > 0.8), best with the largest C and the narrow tube.  On
    scaled features both gammas are the same number, and the first one wins the tie.  The winner is refitted on all rows."""
    from regimen.operators import solvers
    from regimen.plans import suite
    folded = deal_up(sampling.kfold_contiguous(part_with(spark, sf, WAVE), ["p_partkey"], 3))
    table, best = suite.grid_search_svr(folded, PART_FEATURES, "y", SVR_GRID, 3)
    best = materialize(best)
    _, model = suite.refit_winner(best, lambda **p: solvers.SVR(PART_FEATURES, "y", **p), SVR_GRID, folded)
    fit = metrics.regression_metrics(model.transform(folded).withColumnRenamed("y", "label"), []).select(
        (F.col("r2") > 0.99).alias("refitted"))
    out = table.join(best.select("grid_index", F.lit(True).alias("is_best")), "grid_index", "left").crossJoin(F.broadcast(fit))
    return out.select("grid_index", "kernel", "C", "epsilon", "gamma", "cv_folds", (F.col("cv_mean") > 0.8).alias("explains"),  # one row beside
                      "is_best", "refitted")


def _md5_word(expr: str, at: int) -> str:
    return f"('0x' || substr(md5({expr}), {at}, 8))::BIGINT % 2147483647"


@register("repeated_splits_500x50", f"""
WITH h AS (SELECT p_partkey AS id, p_retailprice AS y, {_md5_word('p_partkey::VARCHAR', 1)} AS h1,
                  {_md5_word('p_partkey::VARCHAR', 9)} AS h2 FROM part),
f AS (SELECT r.range AS round, s.range AS split, {_md5_word("concat_ws('-', 42, r.range, s.range)", 1)} AS a,
             {_md5_word("concat_ws('-', 42, r.range, s.range)", 9)} AS b, {_md5_word("concat_ws('-', 42, r.range, s.range)", 17)} AS c
      FROM range(500) r, range(50) s),
n AS (SELECT count(*) AS n, sum(y) AS total, CAST(ceil(round(0.2 * count(*), 9)) AS BIGINT) AS m FROM h),
k AS (SELECT round, split, y, row_number() OVER (PARTITION BY round, split
        ORDER BY ((h1 * a) % 2147483647 + (h2 * b) % 2147483647 + c) % 2147483647, id) AS pos FROM h, f),
t AS (SELECT round, split, count(*) AS n_test, avg(y) AS test_mean, var_pop(y) * count(*) AS spread
      FROM k, n WHERE pos <= m GROUP BY round, split),
u AS (SELECT t.*, n - n_test AS n_train, (total - n_test * test_mean) / (n - n_test) AS train_mean FROM t, n)
SELECT round::INTEGER AS round, split::INTEGER AS split, n_train, n_test, {R6('train_mean', 8)} AS train_mean,
       {R6('test_mean', 8)} AS test_mean, {R6('1 - (spread + n_test * (test_mean - train_mean) * (test_mean - train_mean)) / spread')} AS score
FROM u
""")
def q_repeated_splits_all(spark, sf):
    """E8 + D2: the original's 500 rounds of 50 shuffled hold-outs of ``part``, the mean predictor scored on all
    25,000 of them by vector sums, without a copy of the table."""
    from regimen.operators.split_stats import split_statistics
    p = T(spark, sf, "part").select("p_partkey", "p_retailprice")
    out = split_statistics(deal_up(p), ["p_partkey"], "p_retailprice")
    return out.select("round", "split", "n_train", "n_test", r6("train_mean", 8).alias("train_mean"), r6("test_mean", 8).alias("test_mean"),
                      r6("score").alias("score"))


@register("saved_pipelines", """
SELECT m.model, 'original' AS dataset, TRUE AS same, TRUE AS best_of_two, TRUE AS copies
FROM (VALUES ('scaler_svr'), ('scaler_network')) m(model) WHERE (SELECT count(*) FROM part) > 0
""")
def q_saved_pipelines(spark, sf):
    """S7 + N9: pipelines of the population scaler with an SVR and with a network, saved under their scores (a worse one
    beside each), found again by the registry's best score, and loaded; ``same``: the loaded pipeline predicts every row
    of ``part`` as the fitted one does; ``copies``: so does its copy."""
    from pyspark.ml import Pipeline

    from regimen.operators import solvers
    d = materialize(deal_up(part_with(spark, sf, SHIFTED)))
    stages = {"scaler_svr": solvers.SVR(PART_FEATURES, "y", kernel="linear", C=10.0, scale=False),
              "scaler_network": solvers.MLPRegressor(PART_FEATURES, "y", hidden=(16,), epochs=10, learning_rate=0.01, scale=False)}
    base, registry, rows = shared_path(spark, "models"), shared_path(spark, "registry"), []
    for name, est in stages.items():
        fitted = Pipeline(stages=[clean.PopulationScaler(PART_FEATURES), est]).fit(d)
        r2 = metrics.regression_metrics(fitted.transform(d).withColumnRenamed("y", "label"), []).first()["r2"]
        tables.save_model(fitted, base, name, r2, registry=registry)
        worse = Pipeline(stages=[clean.PopulationScaler(PART_FEATURES[:1]), est]).fit(d)
        tables.save_model(worse, base + "-worse", name, r2 - 1.0, registry=registry)
        best = tables.best_saved(spark.read.parquet(registry), name).first()
        loaded = tables.load_best(registry, name)
        both = [m.transform(d).select("p_partkey", F.col("prediction").alias(c)) for m, c in
                ((fitted, "a"), (loaded, "b"), (loaded.copy(), "c"))]
        pairs = both[0].join(both[1], "p_partkey").join(both[2], "p_partkey")
        rows.append(pairs.agg(F.lit(name).alias("model"), F.lit("original").alias("dataset"), F.every(F.col("a") == F.col("b")).alias("same"),
                              F.lit(best["score"] == r2).alias("best_of_two"), F.every(F.col("a") == F.col("c")).alias("copies")))
    return rows[0].unionByName(rows[1])


@register("corr_matrix_embeddings", f"""
WITH e AS (SELECT vec_id, unnest(range(64))::INTEGER AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT *, CASE WHEN (vec_id + i) % 11 = 0 THEN NULL WHEN i = 5 THEN 2.5 ELSE v END AS x FROM e)
SELECT a.i AS col_a, b.i AS col_b, CASE WHEN a.i <> 5 AND b.i <> 5 THEN {R6('corr(a.x, b.x)')} END AS corr
FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY a.i, b.i
""")
def q_corr_embeddings(spark, sf):
    """A3 over the 64 dimensions of ``embeddings`` by masked Gram matrices: missing values are left out pair by pair, a
    constant column has no correlation."""
    from regimen.operators.wide import corr_matrix_wide
    e = T(spark, sf, "embeddings")
    holes = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 11 == 0, F.lit(None)).when(i == 5, F.lit(2.5)).otherwise(v))
    m = corr_matrix_wide(e.select(holes.alias("embedding")), vector="embedding", size=64, block=24)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))
