from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import WX, cols, daily, finish, measurements, query, ratio_sql
from chronopanel.operators import metrics as m

# -- predictions: three models whose scores are functions of the event, with many ties ----

PRED = (
    WX
    + """, pred AS (
  SELECT m.model, event_id, City, Date, CAST(user_id % 20 AS VARCHAR) AS zone, y,
    CASE m.model WHEN 'a' THEN p WHEN 'b' THEN ((event_id * 53 + y * 311) % 1000) / 1000.0 ELSE (p + y) / 2 END AS p,
    CASE WHEN event_id % 10 < 7 THEN 'train' ELSE 'test' END AS split
  FROM wx, (VALUES ('a'), ('b'), ('c')) m(model)
), predh AS (SELECT *, CASE WHEN p >= 0.4 THEN 1 ELSE 0 END AS yhat FROM pred)"""
)


def predictions(spark, sf):
    i = F.col("event_id")
    scores = {"a": F.col("p"), "b": ((i * 53 + F.col("y") * 311) % 1000) / 1000.0, "c": (F.col("p") + F.col("y")) / 2}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("p")) for k, v in scores.items()]))
    split = F.when(i % 10 < 7, "train").otherwise("test")
    zone = (F.col("user_id") % 20).cast("string")
    out = measurements(spark, sf).select("event_id", "City", "Date", zone.alias("zone"), "y", split.alias("split"), rows.alias("r"))
    out = out.select("r.model", "event_id", "City", "Date", "zone", "y", "r.p", "split")
    return out.withColumn("yhat", (F.col("p") >= 0.4).cast("int"))


COUNTS = "sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn"
RATES = (
    f"{ratio_sql('tp', 'tp + fn')} AS recall, {ratio_sql('tp', 'tp + fp')} AS precision, {ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1, "
    f"{ratio_sql('5 * tp', '5 * tp + 4 * fn + fp')} AS f2, {ratio_sql('tp + tn', 'tp + fp + tn + fn')} AS accuracy"
)


@query(
    "e1_confusion",
    f"WITH {PRED}, c AS (SELECT model, {COUNTS} FROM predh GROUP BY 1), f AS (SELECT *, {RATES} FROM c) "
    f"SELECT {cols(key='model', int_='tp fp tn fn', num='recall precision f1 f2 accuracy')} FROM f",
)
def e1_confusion(spark, sf):
    return finish(m.confusion(predictions(spark, sf), by=["model"]))


CURVE = """g AS (SELECT model, p AS threshold, count(*) AS n, sum(y) AS pos FROM pred GROUP BY 1, 2),
  cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp, sum(n) OVER (PARTITION BY model) AS rows, sum(pos) OVER (PARTITION BY model) AS positives
    FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""


RANK = f"""{CURVE}, ap AS (SELECT model, sum(pos * tp * 1.0 / above) / max(positives) AS pr_auc,
    sum((n - pos) * (tp - pos) + (n - pos) * pos * 0.5) / (max(positives) * (max(rows) - max(positives))) AS roc_auc FROM cum GROUP BY 1)"""


@query("e2_average_precision", f"WITH {PRED}, {RANK} SELECT {cols(key='model', num='pr_auc')} FROM ap")
def e2_average_precision(spark, sf):
    return finish(m.ranking(predictions(spark, sf), by=["model"]), "model", "pr_auc")


@query("e3_roc_auc", f"WITH {PRED}, {RANK} SELECT {cols(key='model', num='roc_auc')} FROM ap")
def e3_roc_auc(spark, sf):
    return finish(m.ranking(predictions(spark, sf), by=["model"]), "model", "roc_auc")


@query(
    "e3_roc_auc_global",
    f"WITH {WX}, pred AS (SELECT 'x' AS model, y, p FROM wx), {RANK} SELECT {cols(num='pr_auc roc_auc')} FROM ap",
)
def e3_roc_auc_global(spark, sf):
    return finish(m.ranking(measurements(spark, sf)))


@query(
    "e4_curves",
    f"WITH {PRED}, {CURVE}, f AS (SELECT model, threshold, tp, above - tp AS fp, {ratio_sql('tp', 'above')} AS precision, {ratio_sql('tp', 'positives')} AS recall, "
    f"{ratio_sql('above - tp', 'rows - positives')} AS fpr FROM cum) SELECT {cols(key='model', int_='tp fp', num='threshold precision recall fpr')} FROM f",
)
def e4_curves(spark, sf):
    return finish(m.curves(predictions(spark, sf), by=["model"]))


def sweep_sql(grid, by="model", src="pred"):
    values = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in grid)
    key = f"{by}, " if by else ""
    return f"""grid AS (SELECT * FROM (VALUES {values}) v(threshold)),
    sc AS (SELECT {key}threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN p < threshold AND y = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END) AS fn
      FROM {src}, grid GROUP BY ALL),
    sweep AS (SELECT *, {RATES}, {ratio_sql('tp + fp', 'tp + fp + tn + fn')} AS positive_rate FROM sc)"""


SWEEP = "threshold recall precision f1 f2 accuracy positive_rate"


@query("e5_threshold_sweep", f"WITH {PRED}, {sweep_sql(m.SWEEP_GRID)} SELECT {cols(key='model', int_='tp fp tn fn', num=SWEEP)} FROM sweep")
def e5_threshold_sweep(spark, sf):
    return finish(m.sweep(predictions(spark, sf), by=["model"]), "model", "tp", "fp", "tn", "fn", *SWEEP.split())


@query(
    "e5_sweep_rounded",
    f"WITH {PRED}, one AS (SELECT * FROM pred WHERE model = 'c'), {sweep_sql(m.SWEEP_GRID, '', 'one')} SELECT round_even(threshold, 4) AS threshold, round_even(recall, 4) AS recall, CAST(tp AS BIGINT) AS tp FROM sweep",
)
def e5_sweep_rounded(spark, sf):
    one = predictions(spark, sf).filter("model = 'c'")
    return m.rounded_sweep(m.sweep(one)).select("threshold", "recall", "tp")


@query(
    "e6_f2",
    f"WITH {PRED}, c AS (SELECT model, {COUNTS} FROM predh GROUP BY 1), r AS (SELECT *, {RATES} FROM c), "
    f"f AS (SELECT model, CASE WHEN 4 * precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2 FROM r) SELECT {cols(key='model', num='f2')} FROM f",
)
def e6_f2(spark, sf):
    c = m.confusion(predictions(spark, sf), by=["model"])
    return finish(c.select("model", m.f2_score(F.col("precision"), F.col("recall")).alias("f2")))


@query(
    "e7_choose_f2",
    f"""WITH {PRED}, {sweep_sql(m.SWEEP_GRID)},
    l AS (SELECT *, CASE WHEN recall >= 0.7 AND precision >= 0.3 THEN 0 WHEN recall >= 0.7 THEN 1 ELSE 2 END AS gate FROM sweep),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY gate, round(CASE WHEN recall >= 0.7 THEN f2 ELSE recall END, 12) DESC, threshold) AS rn FROM l)
    SELECT {cols(key='model', int_='gate tp fp', num='threshold recall precision f2')} FROM r WHERE rn = 1""",
)
def e7_choose_f2(spark, sf):
    table = m.sweep(predictions(spark, sf), by=["model"])
    return finish(m.choose_f2(table, ["model"]), "model", "gate", "tp", "fp", "threshold", "recall", "precision", "f2")


def gate_sql(score):
    return f"""l AS (SELECT s.*, CASE WHEN precision >= 0.3 AND recall >= 0.7 THEN 0 WHEN precision >= 0.2 AND recall >= 0.7 THEN 1 WHEN precision >= 0.2 AND recall >= 0.5 THEN 2 ELSE 3 END AS gate, {score} AS score FROM sweep s),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY gate, round(CASE WHEN gate < 3 THEN score ELSE f1 END, 12) DESC, threshold) AS rn FROM l)"""


@query(
    "e8_choose_gated",
    f"WITH {PRED}, {sweep_sql(m.GATE_GRID)}, {gate_sql('0.6 * recall + 0.4 * f1')} SELECT {cols(key='model', int_='gate', num='threshold recall precision f1')} FROM r WHERE rn = 1",
)
def e8_choose_gated(spark, sf):
    table = m.sweep(predictions(spark, sf), by=["model"], grid=m.GATE_GRID)
    return finish(m.choose_gated(table, ["model"]), "model", "gate", "threshold", "recall", "precision", "f1")


@query(
    "e8_choose_scored",
    f"""WITH {PRED}, {RANK}, {sweep_sql(m.SCORE_GRID)}, {gate_sql('0.35 * (SELECT pr_auc FROM ap WHERE ap.model = s.model) + 0.30 * f1 + 0.20 * recall + 0.15 * precision')}
    SELECT {cols(key='model', int_='gate', num='threshold recall precision f1')} FROM r WHERE rn = 1""",
)
def e8_choose_scored(spark, sf):
    p = predictions(spark, sf)
    table = m.sweep(p, by=["model"], grid=m.SCORE_GRID).join(m.ranking(p, by=["model"]), "model")
    best = m.choose_gated(table, ["model"], m.gate_score(F.col("pr_auc")))
    return finish(best, "model", "gate", "threshold", "recall", "precision", "f1")


BOARD = f"c AS (SELECT model, {COUNTS} FROM predh GROUP BY 1), r AS (SELECT *, {RATES} FROM c), board AS (SELECT r.*, pr_auc, roc_auc, 0.6 * recall + 0.4 * f1 AS composite, 0.35 * pr_auc + 0.30 * f1 + 0.20 * recall + 0.15 * precision AS selection_score FROM r JOIN ap ON r.model = ap.model)"


@query(
    "e9_leaderboard",
    f"WITH {PRED}, {RANK}, {BOARD}, f AS (SELECT *, CAST(precision >= 0.3 AND recall >= 0.7 AND f1 >= 0.2 AS INT) AS qualified FROM board) "
    f"SELECT {cols(key='model', int_='tp fp tn fn qualified', num='recall precision f1 accuracy pr_auc roc_auc composite')} FROM f ORDER BY composite DESC",
)
def e9_leaderboard(spark, sf):
    board = m.qualified(m.leaderboard(predictions(spark, sf))).orderBy(F.desc("composite"))
    return finish(board, "model", "tp", "fp", "tn", "fn", "qualified", "recall", "precision", "f1", "accuracy", "pr_auc", "roc_auc", "composite")


@query(
    "e10_best_model",
    f"WITH {PRED}, {RANK}, {BOARD} SELECT {cols(key='model', num='selection_score')} FROM board ORDER BY board.selection_score DESC, model LIMIT 1",
)
def e10_best_model(spark, sf):
    return finish(m.best_model(m.leaderboard(predictions(spark, sf))), "model", "selection_score")


@query(
    "e11_by_entity",
    f"""WITH {PRED}, one AS (SELECT * FROM predh WHERE model = 'b'), c AS (SELECT zone, {COUNTS}, avg(p) AS mean_p, max(p) AS max_p FROM one GROUP BY 1), r AS (SELECT *, {RATES}, tp + fn AS events FROM c),
    f AS (SELECT zone, tp, fp, tn, fn, events, mean_p, max_p, CASE WHEN events > 0 THEN recall END AS recall, CASE WHEN events > 0 THEN precision END AS precision, CASE WHEN events > 0 THEN f1 END AS f1 FROM r)
    SELECT {cols(key='zone', int_='tp fp tn fn events', num='mean_p max_p recall precision f1')} FROM f""",
)
def e11_by_entity(spark, sf):
    one = predictions(spark, sf).filter("model = 'b'")
    return finish(m.by_entity(one, "zone"), "zone", "tp", "fp", "tn", "fn", "events", "mean_p", "max_p", "recall", "precision", "f1")


@query(
    "e12_overfit_gap",
    f"""WITH {PRED}, c AS (SELECT model, split, {COUNTS} FROM predh GROUP BY 1, 2), r AS (SELECT *, {RATES} FROM c),
    f AS (SELECT model, max(CASE WHEN split = 'train' THEN f1 END) AS train_f1, max(CASE WHEN split = 'test' THEN f1 END) AS test_f1 FROM r GROUP BY 1),
    g AS (SELECT *, train_f1 - test_f1 AS gap, CAST(train_f1 - test_f1 > 0.15 AS INT) AS overfit FROM f)
    SELECT {cols(key='model', num='train_f1 test_f1 gap', int_='overfit')} FROM g""",
)
def e12_overfit_gap(spark, sf):
    return finish(m.overfit_gap(predictions(spark, sf)))


@query(
    "e13_regression",
    f"""WITH {WX}, d AS (SELECT City, Temperature_C AS y, Temperature_C * 0.9 + p AS h FROM wx),
    f AS (SELECT City, count(*) AS n, avg(abs(y - h)) AS mae, sqrt(avg((y - h) * (y - h))) AS rmse, 1 - sum((y - h) * (y - h)) / (var_pop(y) * count(*)) AS r2,
      avg(CASE WHEN y <> 0 THEN abs((y - h) / y) END) * 100 AS mape FROM d GROUP BY 1)
    SELECT {cols(key='City', int_='n', num='mae rmse r2')}, round(mape, 4) + 0.0 AS mape FROM f""",
)
def e13_regression(spark, sf):
    df = measurements(spark, sf).select("City", F.col("Temperature_C").alias("y"), (F.col("Temperature_C") * 0.9 + F.col("p")).alias("yhat"))
    out = m.regression(df, by=["City"])
    return finish(out, "City", "n", "mae", "rmse", "r2", "mape").withColumn("mape", F.round("mape", 4) + 0.0)


@query(
    "e14_export",
    f"WITH {PRED} SELECT City, CAST(month(Date) AS BIGINT) AS month, CAST(y AS BIGINT) AS y_true, CAST(yhat AS BIGINT) AS y_pred, round_even(p, 4) + 0.0 AS probability FROM predh WHERE model = 'a'",
)
def e14_export(spark, sf):
    return finish(m.export(predictions(spark, sf).filter("model = 'a'")))


@query(
    "e15_limits",
    f"WITH {PRED}, {sweep_sql(m.SWEEP_GRID)}, f AS (SELECT model, max(CASE WHEN recall >= 0.7 THEN precision END) AS max_precision, max(CASE WHEN precision >= 0.3 THEN recall END) AS max_recall FROM sweep GROUP BY 1) "
    f"SELECT {cols(key='model', num='max_precision max_recall')} FROM f",
)
def e15_limits(spark, sf):
    return finish(m.limits(m.sweep(predictions(spark, sf), by=["model"]), ["model"]))
