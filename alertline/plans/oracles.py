"""The SQL that each named query must agree with, for an engine that reads the same tables."""

from __future__ import annotations

_COUNTER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_LABEL = f"CASE WHEN value * (1 + {_COUNTER} % 3) > 250 THEN 1 ELSE 0 END"

SCORED = f"scored AS (SELECT event_id AS id, ts AS time, {_LABEL} AS y, value / (value + 50) AS score FROM events)"

RAW = f"""raw AS (
  SELECT event_id AS TransactionID,
         CASE WHEN event_id % 13 = 0 THEN -1.0 WHEN event_id % 17 = 0 THEN -999.0 ELSE value END AS TransactionAmt,
         CASE WHEN event_id % 5 = 0 THEN 'missing' ELSE event_type END AS ProductCD,
         CASE WHEN event_id % 20 = 0 THEN value END AS sparse95,
         CASE WHEN event_id % 10 = 0 THEN value END AS sparse90,
         {_LABEL} AS isFraud,
         {_COUNTER} AS C1,
         CONCAT('v', CAST(user_id * 10 + event_id % 10 AS VARCHAR)) AS DeviceInfo,
         ts,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1704067200 AS TransactionDT
  FROM events)"""


def _gap(column: str) -> str:
    return f"CASE WHEN {column} IN (-1, -999) THEN NULL ELSE {column} END AS {column}"


CLEANED = f"""{RAW}, cleaned AS (
  SELECT {_gap('TransactionID')}, {_gap('TransactionAmt')}, NULLIF(ProductCD, 'missing') AS ProductCD,
         {_gap('sparse95')}, {_gap('sparse90')}, {_gap('isFraud')}, {_gap('C1')},
         NULLIF(DeviceInfo, 'missing') AS DeviceInfo, ts, {_gap('TransactionDT')}
  FROM raw)"""

CUT = """cut AS (SELECT CAST(floor(quantile_cont(epoch_us({time}), 0.8::DOUBLE)) AS BIGINT) AS t_cut FROM {table})"""
SIDES = f"""{CLEANED}, {CUT.format(time='ts', table='cleaned')},
train AS (SELECT c.* FROM cleaned c, cut WHERE epoch_us(ts) <= t_cut),
val AS (SELECT c.* FROM cleaned c, cut WHERE epoch_us(ts) > t_cut)"""

TIMED = f"""{RAW}, timed AS (
  SELECT *, TIMESTAMP '2017-01-01' + to_seconds(COALESCE(TransactionDT, 0)) AS dt FROM raw),
featured AS (
  SELECT *, hour(dt) AS hour, date_diff('day', DATE '2017-01-01', CAST(dt AS DATE)) AS day, isodow(dt) - 1 AS weekday
  FROM timed)"""


def _ratio(numerator: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 THEN CAST({numerator} AS DOUBLE) / ({denominator}) ELSE 0.0 END"


def _r(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 9) AS {name}"


def _stairs(source: str, score: str = "score") -> str:
    """One row per distinct score with cumulative counts from the highest down."""
    return f"""blocks AS (
  SELECT {score} AS s, COUNT(*) AS n, SUM(y) AS tp, SUM(1 - y) AS fp FROM {source} GROUP BY {score}),
stairs AS (
  SELECT s, n, tp, fp,
         SUM(n) OVER w AS cum_n, SUM(tp) OVER w AS cum_tp, SUM(fp) OVER w AS cum_fp,
         SUM(tp) OVER () AS all_tp, SUM(fp) OVER () AS all_fp
  FROM blocks WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


def _rows(source: str, score: str = "score") -> str:
    """One row per table row with its position and cumulative counts in the alert order."""
    return f"""stairs AS (
  SELECT id, time, y, {score} AS s, ROW_NUMBER() OVER w AS alerts,
         SUM(y) OVER w AS cum_tp, SUM(1 - y) OVER w AS cum_fp,
         SUM(y) OVER () AS all_tp, SUM(1 - y) OVER () AS all_fp, COUNT(*) OVER () AS n_rows
  FROM {source} WINDOW w AS (ORDER BY {score} DESC, time, id ROWS UNBOUNDED PRECEDING)),
days AS (SELECT COUNT(DISTINCT CAST(time AS DATE)) AS n_days FROM {source})"""


_CUM_RATES = ", ".join(
    [
        _r(_ratio("cum_tp", "cum_tp + cum_fp"), "precision"),
        _r(_ratio("cum_tp", "all_tp"), "recall"),
        _r(_ratio("cum_fp", "all_fp"), "fpr"),
    ]
)


def _doubles(*values: float) -> str:
    return ", ".join(f"({v}::DOUBLE)" for v in values)


def _topk(source: str, score: str = "score") -> str:
    return f"""{_rows(source, score)}, k(K) AS (VALUES {_doubles(0.5, 1, 2, 5)}),
topk AS (
  SELECT 'topk' AS mode, K AS K_or_FPR, s AS threshold, alerts, cum_tp, cum_fp, all_tp, all_fp, alerts::DOUBLE / n_days AS per_day
  FROM stairs, k, days WHERE alerts = CAST(ceil((K / 100.0::DOUBLE) * n_rows) AS BIGINT))"""


def _fpr_blocks(source: str, score: str, budgets: tuple[float, ...], name: str = "picked") -> str:
    return f"""fb AS (SELECT {score} AS s, COUNT(*) AS n, SUM(y) AS tp, SUM(1 - y) AS fp FROM {source} GROUP BY {score}),
fs AS (
  SELECT s, SUM(n) OVER w AS cum_n, SUM(tp) OVER w AS cum_tp, SUM(fp) OVER w AS cum_fp,
         SUM(tp) OVER () AS all_tp, SUM(fp) OVER () AS all_fp
  FROM fb WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
fd AS (SELECT COUNT(DISTINCT CAST(time AS DATE)) AS n_days FROM {source}),
budget(b) AS (VALUES {_doubles(*budgets)}),
ranked AS (
  SELECT b, fs.*, ROW_NUMBER() OVER (PARTITION BY b ORDER BY s) AS pos
  FROM fs, budget WHERE cum_fp::DOUBLE / all_fp <= b / 100.0::DOUBLE),
{name} AS (
  SELECT 'fpr' AS mode, budget.b AS K_or_FPR, r.s AS threshold, COALESCE(r.cum_n, 0) AS alerts,
         COALESCE(r.cum_tp, 0) AS cum_tp, COALESCE(r.cum_fp, f.cum_fp) AS cum_fp, f.all_tp, f.all_fp,
         COALESCE(r.cum_n, 0)::DOUBLE / n_days AS per_day
  FROM budget CROSS JOIN (SELECT cum_fp, all_tp, all_fp FROM fs ORDER BY s DESC LIMIT 1) f CROSS JOIN fd
  LEFT JOIN ranked r ON r.b = budget.b AND r.pos = 1)"""


_POINT = f"""mode, {_r('K_or_FPR', 'K_or_FPR')}, {_r('threshold', 'threshold')},
{_r('CASE WHEN alerts > 0 THEN ' + _ratio('cum_tp', 'cum_tp + cum_fp') + ' ELSE 0.0 END', 'precision')},
{_r(_ratio('cum_tp', 'all_tp'), 'recall')}, {_r(_ratio('cum_fp', 'all_fp'), 'fpr')},
CAST(alerts AS BIGINT) AS alerts, {_r('per_day', 'alerts_per_day')}"""


def _points(digits: int, run_id: str) -> str:
    """Operating points of the probability ``round(score, digits)`` as a select list over one WITH."""
    return f"""{SCORED}, cal AS (SELECT id, time, y, round(score, {digits}) AS p FROM scored),
{_topk('cal', 'p')}, {_fpr_blocks('cal', 'p', (0.1, 0.5, 1, 2))},
both_modes AS (SELECT * FROM topk UNION ALL SELECT * FROM picked),
points AS (
  SELECT '{run_id}' AS run_id, 'isotonic' AS calibrator, 'full' AS "window", mode,
         CASE WHEN mode = 'topk' THEN 'K_percent' ELSE 'FPR_percent' END AS budget_type,
         K_or_FPR AS budget_value, threshold AS threshold_prob,
         CASE WHEN alerts > 0 THEN {_ratio('cum_tp', 'cum_tp + cum_fp')} ELSE 0.0 END AS precision,
         {_ratio('cum_tp', 'all_tp')} AS recall, {_ratio('cum_fp', 'all_fp')} AS fpr,
         CAST(alerts AS BIGINT) AS alerts, per_day AS alerts_per_day
  FROM both_modes)"""


_POINT_ROW = f"""run_id, calibrator, "window", mode, budget_type, {_r('budget_value', 'budget_value')},
{_r('threshold_prob', 'threshold_prob')}, {_r('precision', 'precision')}, {_r('recall', 'recall')}, {_r('fpr', 'fpr')},
alerts, {_r('alerts_per_day', 'alerts_per_day')}"""

_BIN = "(" + " + ".join(f"CASE WHEN p > {i} * 0.1::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"
_QUANTILE_BARS = f"""WITH {SCORED},
edges AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(f'{i / 10}' for i in range(11))}])) AS e FROM scored),
inner_edges AS (SELECT e FROM edges WHERE e > (SELECT MIN(e) FROM edges) AND e < (SELECT MAX(e) FROM edges)),
binned AS (SELECT score AS p, y, (SELECT COUNT(*) FROM inner_edges WHERE e < score) AS bin FROM scored),
bars AS (SELECT bin, AVG(p) AS p_mean, AVG(y) AS y_mean, COUNT(*) AS n FROM binned GROUP BY bin)"""
_HOLDOUT = f"""{SCORED}, numbered AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY time, id) AS rn, COUNT(*) OVER () AS n_rows FROM scored),
hold AS (SELECT * FROM numbered WHERE rn > CAST(floor(0.8::DOUBLE * n_rows) AS BIGINT))"""


def _quality(name: str, test: str, observed: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", CAST({test} AS BIGINT) AS passed, {_r(observed, 'observed')} FROM observations"
    )


def _mode_of(column: str) -> str:
    return (
        f"(SELECT {column} FROM train WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY COUNT(*) DESC, {column} LIMIT 1)"
    )


def _code_of(column: str) -> str:
    return f"(SELECT {column} AS v, ROW_NUMBER() OVER (ORDER BY {column}) - 1 AS code FROM train WHERE {column} IS NOT NULL GROUP BY {column})"


def _drops(p: str) -> str:
    return f"""SELECT COUNT(*) AS scores,
  CAST(SUM(CASE WHEN low - prev < -1e-10 OR low - high < -1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS drops, '{p}' AS p
FROM (SELECT low, high, LAG(high) OVER (ORDER BY score) AS prev
      FROM (SELECT score, MIN({p}) AS low, MAX({p}) AS high FROM data GROUP BY score))"""


def _top_precision(score: str, percent: float, source: str) -> str:
    take = f"CAST(ceil(({percent}::DOUBLE / 100.0::DOUBLE) * n_rows) AS BIGINT)"
    return f"""SELECT '{score}' AS score_name, {percent}::DOUBLE AS K, MAX({take}) AS k_rows, {_r('AVG(y)', 'precision')}
FROM (SELECT y, ROW_NUMBER() OVER (ORDER BY {score} DESC, time, id) AS rn, COUNT(*) OVER () AS n_rows FROM {source})
WHERE rn <= {take}"""


ORACLES: dict[str, str] = {}

ORACLES["row_count_audit"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", COUNT(*) AS n FROM {t}" for t in ("region", "nation", "orders", "events")
)
ORACLES["limit_scan"] = """
SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) AS o_orderdate
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""
_WHOLE = """TransactionID, TransactionAmt, ProductCD, sparse95, sparse90, CAST(isFraud AS BIGINT) AS isFraud,
  CAST(C1 AS BIGINT) AS C1, DeviceInfo, epoch_us(ts) AS ts, TransactionDT"""
ORACLES["csv_roundtrip"] = f"""
SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, {_r('value', 'value')}, props FROM events"""
ORACLES["named_scores"] = f"""
WITH {SCORED} SELECT id, epoch_us(time) AS time, CAST(y AS BIGINT) AS y, {_r('score', 'score')},
  CAST(NULL AS DOUBLE) AS p_cal, 'raw_scores' AS dataset FROM scored
UNION ALL SELECT id, epoch_us(time), CAST(y AS BIGINT), {_r('score', 'score')}, {_r('score * score', 'p_cal')},
  'raw_scores_with_pcal' FROM scored"""
ORACLES["join_coverage"] = """
SELECT COUNT(*) AS with_identity, (SELECT COUNT(*) FROM documents) AS total
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL"""
ORACLES["joined_view"] = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.doc_id AS doc_id_1,
       CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
ORACLES["clean_sentinels"] = f"""
WITH {CLEANED} SELECT {_WHOLE} FROM cleaned"""
ORACLES["sparse_drop"] = f"""
WITH {CLEANED} SELECT TransactionID, TransactionAmt, ProductCD, sparse90, CAST(isFraud AS BIGINT) AS isFraud,
  CAST(C1 AS BIGINT) AS C1, DeviceInfo, epoch_us(ts) AS ts, TransactionDT FROM cleaned"""
ORACLES["missing_profile_topn"] = (
    f"WITH {CLEANED}, profile AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM cleaned"
        for c in ("TransactionID", "TransactionAmt", "ProductCD", "sparse95", "sparse90", "isFraud", "C1", "DeviceInfo", "ts", "TransactionDT")
    )
    + f") SELECT \"column\", {_r('rate', 'missing_rate')} FROM profile ORDER BY rate DESC, \"column\" LIMIT 5"
)
ORACLES["time_features"] = f"""
WITH {RAW}, gaps AS (SELECT TransactionID, CASE WHEN TransactionID % 50 <> 0 THEN TransactionDT END AS TransactionDT FROM raw),
timed AS (SELECT *, TIMESTAMP '2017-01-01' + to_seconds(COALESCE(TransactionDT, 0)) AS dt FROM gaps)
SELECT TransactionID, TransactionDT, epoch_us(dt) AS dt, CAST(hour(dt) AS BIGINT) AS hour,
  CAST(date_diff('day', DATE '2017-01-01', CAST(dt AS DATE)) AS BIGINT) AS day, CAST(isodow(dt) - 1 AS BIGINT) AS weekday
FROM timed"""
ORACLES["lenient_casts"] = f"""
WITH {RAW} SELECT TransactionID, CASE WHEN TransactionID % 7 <> 0 THEN epoch_us(ts) END AS time,
  CAST(CASE WHEN TransactionID % 11 = 0 THEN 0 ELSE isFraud END AS BIGINT) AS y,
  CAST(CASE WHEN TransactionID % 3 <> 0 THEN C1 END AS DOUBLE) AS score, epoch_us(ts) AS strict_time FROM raw"""
ORACLES["filters"] = f"""
WITH {CLEANED} SELECT TransactionID AS id, epoch_us(ts) AS time, CAST(isFraud AS BIGINT) AS y, TransactionAmt AS score,
  CAST(TransactionAmt >= 40.0 AS BIGINT) AS y_hat
FROM cleaned WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND TransactionAmt IS NOT NULL"""
ORACLES["fraud_stats"] = f"""
WITH {SCORED} SELECT COUNT(*) AS n_rows, CAST(SUM(y) AS BIGINT) AS n_fraud, {_r('AVG(y)', 'fraud_rate')}, 'events' AS source FROM scored
UNION ALL SELECT COUNT(*), CAST(SUM(quality) AS BIGINT), {_r('AVG(quality)', 'fraud_rate')}, 'labels'
FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLES["class_balance"] = f"""
WITH {SCORED}, both_sources AS (
  SELECT COUNT(*) AS total, CAST(SUM(y) AS BIGINT) AS pos, 'events' AS source FROM scored
  UNION ALL SELECT COUNT(*), CAST(SUM(quality) AS BIGINT), 'labels' FROM documents LEFT JOIN labels USING (doc_id))
SELECT total, pos, total - pos AS neg, {_r('pos::DOUBLE / total', 'prevalence')}, source FROM both_sources"""
for _name, _unit in (("rate_by_hour", "hour"), ("rate_by_weekday", "weekday")):
    ORACLES[_name] = f"""
WITH {TIMED} SELECT CAST({_unit} AS BIGINT) AS {_unit}, {_r('AVG(isFraud)', 'fraud_rate')} FROM featured GROUP BY 1"""
ORACLES["describe_time"] = f"WITH {TIMED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, {_r(f'AVG({c})', 'mean')}, {_r(f'stddev_samp({c})', 'std')},
{_r(f'MIN({c})', 'min')}, {_r(f'quantile_cont({c}, 0.25)', 'q25')}, {_r(f'quantile_cont({c}, 0.5)', 'q50')},
{_r(f'quantile_cont({c}, 0.75)', 'q75')}, {_r(f'MAX({c})', 'max')} FROM featured"""
    for c in ("hour", "day", "weekday")
)
ORACLES["amount_histogram"] = f"""
WITH amounts AS (SELECT ln(1 + value) AS x FROM events), ends AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM amounts),
edges AS (SELECT CAST(i AS BIGINT) AS bin, lo + i * (hi - lo) / 80 AS l, CASE WHEN i = 79 THEN hi ELSE lo + (i + 1) * (hi - lo) / 80 END AS r
          FROM ends, range(80) t(i))
SELECT bin, {_r('l', 'left_edge')}, {_r('r', 'right_edge')}, COUNT(x) AS n
FROM edges LEFT JOIN amounts ON x >= l AND (x < r OR (bin = 79 AND x <= r)) GROUP BY bin, l, r"""
ORACLES["unique_days"] = f"WITH {SCORED} SELECT COUNT(DISTINCT CAST(time AS DATE)) AS unique_days FROM scored"
ORACLES["time_quantile_cut"] = f"WITH {SCORED}, {CUT.format(time='time', table='scored')} SELECT t_cut FROM cut"
ORACLES["split_report"] = f"""
WITH {SCORED}, {CUT.format(time='time', table='scored')}
SELECT CASE WHEN epoch_us(time) <= t_cut THEN 'train' ELSE 'val' END AS side, COUNT(*) AS rows,
  epoch_us(MIN(time)) AS time_min, epoch_us(MAX(time)) AS time_max, CAST(SUM(y) AS BIGINT) AS pos,
  CAST(SUM(1 - y) AS BIGINT) AS neg, {_r('AVG(y)', 'prevalence')}
FROM scored, cut GROUP BY 1"""
ORACLES["positional_split"] = f"""
WITH {SCORED}, numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY time, id) AS rn, COUNT(*) OVER () AS n_rows FROM scored)
SELECT id, epoch_us(time) AS time, CAST(y AS BIGINT) AS y, {_r('score', 'score')},
  CASE WHEN rn <= CAST(floor(0.8::DOUBLE * n_rows) AS BIGINT) THEN 'head' ELSE 'tail' END AS side FROM numbered"""
ORACLES["dup_keys"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""
ORACLES["quality_suite"] = f"""
WITH {SCORED}, {RAW}, observations AS (
  SELECT COUNT(*) AS n, SUM(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS no_id,
         SUM(CASE WHEN time IS NULL THEN 1 ELSE 0 END) AS no_time, SUM(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS no_y,
         SUM(CASE WHEN score IS NULL OR NOT isfinite(score) THEN 1 ELSE 0 END) AS bad_score,
         SUM(y) AS pos, SUM(1 - y) AS neg, COUNT(*) - COUNT(DISTINCT id) AS extra_ids,
         (SELECT SUM(CASE WHEN isFraud NOT IN (0, 1) THEN 1 ELSE 0 END) FROM raw) AS bad_label,
         (SELECT AVG(CASE WHEN ts IS NULL THEN 1.0 ELSE 0.0 END) FROM raw) AS bad_ts,
         (SELECT SUM(CASE WHEN TransactionDT IS NULL THEN 1 ELSE 0 END) FROM raw) AS no_seconds
  FROM scored)
""" + " UNION ALL ".join(
    [
        _quality("rows", "n > 0", "n"),
        _quality("id_not_null", "no_id = 0", "no_id"),
        _quality("time_not_null", "no_time = 0", "no_time"),
        _quality("label_not_null", "no_y = 0", "no_y"),
        _quality("score_finite", "bad_score = 0", "bad_score"),
        _quality("positives", "pos > 0", "pos"),
        _quality("negatives", "neg > 0", "neg"),
        _quality("id_unique", "extra_ids = 0", "extra_ids"),
        _quality("label_is_binary", "bad_label = 0", "bad_label"),
        _quality("time_is_valid", "bad_ts < 0.001", "bad_ts"),
        _quality("seconds_are_numeric", "TRUE", "1"),
        _quality("times_from_missing_seconds", "TRUE", "no_seconds"),
    ]
)
ORACLES["split_checks"] = f"""
WITH {SCORED}, {CUT.format(time='time', table='scored')}, observations AS (
  SELECT SUM(CASE WHEN epoch_us(time) <= t_cut THEN 1 ELSE 0 END) AS tr, SUM(CASE WHEN epoch_us(time) > t_cut THEN 1 ELSE 0 END) AS va,
         CAST(MAX(CASE WHEN epoch_us(time) <= t_cut THEN time END) < MIN(CASE WHEN epoch_us(time) > t_cut THEN time END) AS INT) AS apart
  FROM scored, cut)
""" + " UNION ALL ".join(
    [
        _quality("train_rows", "tr > 0", "tr"),
        _quality("val_rows", "va > 0", "va"),
        _quality("no_overlap", "apart = 1", "apart"),
    ]
)
ORACLES["monotone_check"] = f"""
WITH {SCORED}, data AS (SELECT score, round(score, 3) AS stepped, score + y * 0.01::DOUBLE AS shifted FROM scored)
{_drops('stepped')} UNION ALL {_drops('shifted')}"""
ORACLES["det_rank"] = f"""
WITH {SCORED} SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, time, id) AS "rank" FROM scored"""
ORACLES["row_index_by_time"] = """
SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index
FROM orders"""
ORACLES["staircase_rows"] = f"""
WITH {SCORED}, {_rows('scored')}
SELECT id, alerts, CAST(cum_tp AS BIGINT) AS cum_tp, CAST(cum_fp AS BIGINT) AS cum_fp, {_CUM_RATES} FROM stairs"""
ORACLES["staircase_blocks"] = f"""
WITH {SCORED}, {_stairs('scored', 'round(score, 4)')}
SELECT {_r('s', 'score')}, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_tp AS BIGINT) AS cum_tp, CAST(cum_fp AS BIGINT) AS cum_fp,
  {_CUM_RATES} FROM stairs"""
ORACLES["roc_points"] = f"""
WITH {SCORED}, {_stairs('scored')}
SELECT {_r(_ratio('cum_fp', 'all_fp'), 'fpr')}, {_r(_ratio('cum_tp', 'all_tp'), 'tpr')}, {_r('s', 'threshold')} FROM stairs
UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS DOUBLE)"""
ORACLES["pr_points"] = f"""
WITH {SCORED}, {_stairs('scored')}
SELECT {_r(_ratio('cum_tp', 'cum_tp + cum_fp'), 'precision')}, {_r(_ratio('cum_tp', 'all_tp'), 'recall')}, {_r('s', 'threshold')} FROM stairs
UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS DOUBLE)"""
_AUC = "SUM(fp * (2 * cum_tp - tp))::DOUBLE / 2.0::DOUBLE / (MAX(all_tp)::DOUBLE * MAX(all_fp)::DOUBLE)"
_AP = "SUM(tp * cum_tp::DOUBLE / (cum_tp + cum_fp)) / MAX(all_tp)"
ORACLES["roc_auc"] = f"WITH {SCORED}, {_stairs('scored')} SELECT {_r(_AUC, 'roc_auc')} FROM stairs"
ORACLES["avg_precision"] = f"WITH {SCORED}, {_stairs('scored')} SELECT {_r(_AP, 'average_precision')} FROM stairs"
_TIES = """ties AS (SELECT l_orderkey AS id, l_shipdate AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_discount AS score FROM lineitem)"""
ORACLES["tied_curve_summary"] = f"""
WITH {_TIES}, {_stairs('ties')} SELECT {_r(_AUC, 'roc_auc')}, {_r(_AP, 'average_precision')} FROM stairs"""
ORACLES["best_f1"] = f"""
WITH {SCORED}, {_stairs('scored')}, rated AS (
  SELECT s, {_ratio('cum_tp', 'cum_tp + cum_fp')} AS p, {_ratio('cum_tp', 'all_tp')} AS r FROM stairs),
f AS (SELECT s, p, r, 2 * p * r / (CASE WHEN p + r = 0 THEN 1e-12 ELSE p + r END) AS f1 FROM rated)
SELECT {_r('s', 'threshold')}, {_r('f1', 'f1')}, {_r('p', 'precision')}, {_r('r', 'recall')} FROM f ORDER BY f.f1 DESC, s LIMIT 1"""
ORACLES["thr_metrics"] = f"""
WITH {SCORED}, t(thr) AS (VALUES {_doubles(0.25, 0.5, 0.75, 0.99)}), c AS (
  SELECT thr, SUM(CASE WHEN score >= thr AND y = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN score >= thr AND y = 0 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN score < thr AND y = 0 THEN 1 ELSE 0 END) AS tn, SUM(CASE WHEN score < thr AND y = 1 THEN 1 ELSE 0 END) AS fn
  FROM scored, t GROUP BY thr)
SELECT {_r('thr', 'threshold')}, {_r(_ratio('tp', 'tp + fp'), 'precision')}, {_r(_ratio('tp', 'tp + fn'), 'recall')},
  {_r(_ratio('2 * tp', '2 * tp + fp + fn'), 'f1')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM c"""
ORACLES["topk_table"] = f"WITH {SCORED}, {_topk('scored')} SELECT {_POINT} FROM topk"
_LABELLED = """stairs AS (
  SELECT id, time, y, score AS s, ROW_NUMBER() OVER w AS alerts,
         SUM(y) OVER w AS cum_tp, SUM(1 - y) OVER w AS cum_fp,
         SUM(y) OVER () AS all_tp, SUM(1 - y) OVER () AS all_fp, COUNT(*) OVER () AS n_rows
  FROM {source} WINDOW w AS (ORDER BY score DESC NULLS LAST, time, id, y ROWS UNBOUNDED PRECEDING)),
days AS (SELECT COUNT(DISTINCT CAST(time AS DATE)) AS n_days FROM {source}), k(K) AS (VALUES {shares}),
topk AS (
  SELECT 'topk' AS mode, K AS K_or_FPR, s AS threshold, alerts, cum_tp, cum_fp, all_tp, all_fp, alerts::DOUBLE / n_days AS per_day
  FROM stairs, k, days WHERE alerts = CAST(ceil((K / 100.0::DOUBLE) * n_rows) AS BIGINT))"""
ORACLES["topk_duplicates"] = f"""
WITH ties AS (
  SELECT l_orderkey // 1000 AS id, TIMESTAMP '1995-01-01' AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    l_discount AS score FROM lineitem),
{_LABELLED.format(source='ties', shares=_doubles(0.5, 1, 2, 5))} SELECT {_POINT} FROM topk"""
ORACLES["topk_missing_scores"] = f"""
WITH {SCORED}, gaps AS (SELECT id, time, y, CASE WHEN id % 3 = 2 THEN score END AS score FROM scored),
{_LABELLED.format(source='gaps', shares=_doubles(5, 30, 100))} SELECT {_POINT} FROM topk"""
ORACLES["narrowed_quantiles"] = f"""
WITH {SCORED}, shares(q) AS (VALUES {_doubles(0.1, 0.25, 0.5, 0.8, 0.99)}), long AS (
  SELECT 'id' AS c, id::DOUBLE AS v FROM scored UNION ALL SELECT 'score', score FROM scored
  UNION ALL SELECT 'tied', round(score, 1) FROM scored),
placed AS (SELECT c, v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY v) - 1 AS p, COUNT(*) OVER (PARTITION BY c) AS n FROM long)
SELECT c AS "column", round(q, 9) AS share, round(
  MAX(CASE WHEN p = floor(q * (n - 1)) THEN v END) + (MAX(CASE WHEN p = least(floor(q * (n - 1)) + 1, n - 1) THEN v END)
  - MAX(CASE WHEN p = floor(q * (n - 1)) THEN v END)) * (q * MAX(n - 1) - floor(q * MAX(n - 1))), 9) AS value
FROM placed, shares GROUP BY c, q"""
ORACLES["prevalence"] = f"WITH {RAW} SELECT {_r('AVG(CASE WHEN isFraud = 1 THEN 1.0 ELSE 0.0 END)', 'prevalence')} FROM raw"
ORACLES["probability_suite"] = f"""
WITH {SCORED}, p AS (SELECT score, CASE WHEN id % 1000 = 7 THEN 1.5 ELSE score / 2 END AS p_cal FROM scored),
blocks AS (SELECT score, MIN(p_cal) AS low, MAX(p_cal) AS high FROM p GROUP BY score),
steps AS (SELECT low, high, LAG(high) OVER (ORDER BY score) AS before FROM blocks),
counts AS (
  SELECT (SELECT COUNT(*) FROM p WHERE p_cal < -1e-12 OR p_cal > 1 + 1e-12) AS outside,
    (SELECT COUNT(*) FROM steps WHERE low - before < -1e-10 OR low - high < -1e-10) AS drops)
SELECT 'probability_in_bounds' AS "check", CAST(outside = 0 AS BIGINT) AS passed, round(outside::DOUBLE, 9) AS observed FROM counts
UNION ALL
SELECT 'probability_monotone', CAST(drops = 0 AS BIGINT), round(drops::DOUBLE, 9) FROM counts"""
ORACLES["stored_transactions"] = f"""
WITH {RAW}, texts AS (SELECT * REPLACE (NULLIF(ProductCD, 'missing') AS ProductCD, NULLIF(DeviceInfo, 'missing') AS DeviceInfo) FROM raw)
SELECT {_WHOLE} FROM texts"""
ORACLES["joined_scan"] = f"""
WITH {CLEANED} SELECT {_WHOLE}, CASE WHEN doc_id IN (-1, -999) THEN NULL ELSE doc_id END AS TransactionID_1,
  CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic
FROM cleaned LEFT JOIN labels ON TransactionID = doc_id"""
ORACLES["feature_kinds"] = f"""
WITH {CLEANED}, n AS (SELECT {", ".join(f"COUNT({c}) AS {c}" for c in ("TransactionID", "TransactionAmt", "ProductCD", "sparse95", "sparse90", "isFraud", "C1", "DeviceInfo", "ts", "TransactionDT"))} FROM cleaned),
long AS (UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE n_values)
SELECT CASE WHEN name IN ('TransactionID', 'isFraud', 'ts') THEN 'dropped'
  WHEN name IN ('ProductCD', 'DeviceInfo') THEN 'categorical' ELSE 'numeric' END AS kind, name, n_values FROM long"""
ORACLES["contracted_projection"] = f"WITH {CLEANED} SELECT TransactionID, DeviceInfo, CAST(C1 AS BIGINT) AS C1 FROM cleaned"
ORACLES["run_metadata"] = f"""
WITH {SCORED}, n AS (SELECT COUNT(*) AS r, SUM(y) AS p FROM scored)
SELECT unnest(['run_id', 'score_type', 'time_column', 't_cut', 'rows_val', 'positives_val']) AS name,
  unnest(['r1', 'probability', 'time', '2024-01-25 00:00:00', r::VARCHAR, p::VARCHAR]) AS value FROM n"""
ORACLES["topk_selection"] = f"""
WITH {SCORED}, n AS (
  SELECT id, ROW_NUMBER() OVER (ORDER BY round(score, 2) DESC, time, id) AS rn, COUNT(*) OVER () AS n_rows FROM scored)
SELECT id, CAST(rn <= CAST(ceil(0.02::DOUBLE * n_rows) AS BIGINT) AS BIGINT) AS selected FROM n"""
ORACLES["precision_at_k_floor"] = f"""
WITH {SCORED}, {_rows('scored')}, k(share) AS (VALUES {_doubles(0.005, 0.01, 0.02, 0.05)})
SELECT {_r('share', 'share')}, alerts AS k, {_r('cum_tp::DOUBLE / alerts', 'precision')}
FROM stairs, k WHERE alerts = greatest(1, CAST(floor(n_rows * share) AS BIGINT))"""
ORACLES["topk_precision_by_score"] = (
    f"WITH {SCORED}, both_scores AS (SELECT *, round(score, 2) AS rounded FROM scored) "
    + " UNION ALL ".join(
        f"SELECT score_name, {_r('K', 'K')}, k_rows, precision FROM ({_top_precision(s, p, 'both_scores')})"
        for s in ("score", "rounded")
        for p in (0.5, 1, 2, 5)
    )
)
ORACLES["recall_at_fpr_curve"] = f"""
WITH {SCORED}, {_stairs('scored')}, t(target) AS (VALUES {_doubles(0.001, 0.005, 0.01, 0.02)})
SELECT {_r('target', 'target_fpr')}, {_r('COALESCE(MAX(CASE WHEN cum_fp::DOUBLE / all_fp <= target THEN cum_tp::DOUBLE / all_tp END), 0.0)', 'recall')}
FROM stairs, t GROUP BY target"""
ORACLES["fpr_rows"] = f"""
WITH {SCORED}, {_rows('scored')}, budget(b) AS (VALUES {_doubles(0.1, 0.5, 1, 2)}),
ranked AS (
  SELECT b, stairs.*, ROW_NUMBER() OVER (PARTITION BY b ORDER BY alerts DESC) AS pos
  FROM stairs, budget WHERE cum_fp::DOUBLE / all_fp <= b / 100.0::DOUBLE),
picked AS (
  SELECT 'fpr' AS mode, budget.b AS K_or_FPR, r.s AS threshold, COALESCE(r.alerts, 0) AS alerts,
         COALESCE(r.cum_tp, 0) AS cum_tp, COALESCE(r.cum_fp, f.cum_fp) AS cum_fp, f.all_tp, f.all_fp,
         COALESCE(r.alerts, 0)::DOUBLE / n_days AS per_day
  FROM budget CROSS JOIN (SELECT cum_fp, all_tp, all_fp FROM stairs WHERE alerts = 1) f CROSS JOIN days
  LEFT JOIN ranked r ON r.b = budget.b AND r.pos = 1)
SELECT {_POINT} FROM picked"""
ORACLES["fpr_blocks"] = f"""
WITH {SCORED}, cal AS (SELECT id, time, y, round(score, 3) AS p FROM scored), {_fpr_blocks('cal', 'p', (0.1, 0.5, 1, 2))}
SELECT {_POINT} FROM picked"""
ORACLES["tied_fpr_blocks"] = f"""
WITH {_TIES}, {_fpr_blocks('ties', 'score', (5, 10, 20, 50))} SELECT {_POINT} FROM picked"""
ORACLES["operating_points"] = f"WITH {_points(2, 'run_a')} SELECT {_POINT_ROW} FROM points"
ORACLES["op_upsert"] = f"""
WITH {_points(2, 'run_a')}, twice AS (
  SELECT * FROM points UNION ALL
  SELECT 'run_b', calibrator, "window", mode, budget_type, budget_value, threshold_prob, precision, recall, fpr, alerts, alerts_per_day FROM points)
SELECT {_POINT_ROW} FROM twice"""
ORACLES["monotone_badges"] = f"""
WITH {_points(2, 'run_a')}, moved AS (
  SELECT *, recall - LAG(recall) OVER w AS d_recall, precision - LAG(precision) OVER w AS d_precision, fpr - LAG(fpr) OVER w AS d_fpr,
         alerts - LAG(alerts) OVER w AS d_alerts, threshold_prob - LAG(threshold_prob) OVER w AS d_threshold
  FROM points WINDOW w AS (PARTITION BY mode ORDER BY budget_value)),
judged AS (
  SELECT run_id, calibrator, "window", mode, CASE WHEN mode = 'fpr'
    THEN COALESCE(d_recall >= 0, TRUE) AND COALESCE(d_threshold <= 0, TRUE) AND threshold_prob IS NOT NULL
         AND COALESCE(d_alerts >= 0, TRUE) AND fpr <= budget_value / 100.0 + 1e-12
    ELSE COALESCE(d_precision <= 0, TRUE) AND COALESCE(d_recall >= 0, TRUE) AND COALESCE(d_fpr >= 0, TRUE)
         AND COALESCE(d_threshold <= 0, TRUE) AND threshold_prob IS NOT NULL END AS fine FROM moved)
SELECT run_id, calibrator, "window", mode, CAST(bool_and(fine) AS BIGINT) AS monotone FROM judged GROUP BY ALL"""
ORACLES["brier"] = f"""
WITH {SCORED} SELECT 'score' AS score_name, {_r('AVG((score - y) * (score - y))', 'brier')} FROM scored
UNION ALL SELECT 'rounded', {_r('AVG((round(score, 1) - y) * (round(score, 1) - y))', 'brier')} FROM scored"""
_ECE = "SUM(n * abs(p_mean - y_mean)) / SUM(n)"
ORACLES["ece_uniform"] = f"""
WITH {SCORED}, bars AS (SELECT {_BIN} AS bin, AVG(p) AS p_mean, AVG(y) AS y_mean, COUNT(*) AS n FROM (SELECT score AS p, y FROM scored) GROUP BY 1)
SELECT {_r(_ECE, 'ece')} FROM bars"""
ORACLES["ece_quantile"] = f"{_QUANTILE_BARS} SELECT {_r(_ECE, 'ece')} FROM bars"
ORACLES["reliability_quantile"] = f"""
{_QUANTILE_BARS} SELECT CAST(bin AS BIGINT) AS bin, {_r('p_mean', 'p_mean')}, {_r('y_mean', 'y_mean')}, n FROM bars"""
ORACLES["reliability_uniform"] = f"""
WITH {SCORED}, both_scores AS (
  SELECT 'score' AS score_name, score AS p, y FROM scored UNION ALL SELECT 'squared', score * score, y FROM scored)
SELECT score_name, CAST({_BIN} AS BIGINT) AS bin, {_r('AVG(p)', 'p_mean')}, {_r('AVG(y)', 'y_mean')}, COUNT(*) AS n
FROM both_scores GROUP BY 1, 2"""
# The isotonic fit is the slope of the greatest convex line below the running totals: from each corner of it the
# next one is the farthest of the points with the smallest slope.
ORACLES["isotonic_probs"] = f"""
WITH RECURSIVE {SCORED}, b AS (SELECT score AS s, COUNT(*) AS n, SUM(y) AS tp FROM scored WHERE score IS NOT NULL GROUP BY 1),
c AS (
  SELECT s, (SUM(n) OVER w)::BIGINT AS cn, (SUM(tp) OVER w)::BIGINT AS ct FROM b WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING)),
corners AS (
  SELECT 0::BIGINT AS before, 0::BIGINT AS cn, 0::BIGINT AS ct, 0.0::DOUBLE AS slope
  UNION ALL
  SELECT before, -nearest.neg_cn, nearest.ct, nearest.slope FROM (
    SELECT h.cn AS before,
      MIN(struct_pack(slope := (c.ct - h.ct)::DOUBLE / (c.cn - h.cn), neg_cn := -c.cn, ct := c.ct)) AS nearest
    FROM corners h JOIN c ON c.cn > h.cn GROUP BY h.cn))
SELECT {_r('s', 'score')}, {_r('slope', 'p_cal')} FROM c JOIN corners k ON c.cn > k.before AND c.cn <= k.cn"""
ORACLES["holdout_metrics"] = f"""
WITH {_HOLDOUT}, bars AS (SELECT {_BIN} AS bin, AVG(p) AS p_mean, AVG(y) AS y_mean, COUNT(*) AS n FROM (SELECT score AS p, y FROM hold) GROUP BY 1),
hold_rows AS (SELECT id, time, y, score FROM hold),
heads AS ({" UNION ALL ".join(_top_precision('score', p, 'hold_rows') for p in (0.5, 1, 2, 5))})
SELECT 'score' AS score_name, (SELECT {_r('AVG((score - y) * (score - y))', 'v')} FROM hold) AS brier, (SELECT {_r(_ECE, 'v')} FROM bars) AS ece,
  {", ".join(f"(SELECT precision FROM heads WHERE K = {p}) AS top_{n}" for p, n in ((0.5, '0_5'), (1, '1_0'), (2, '2_0'), (5, '5_0')))}"""
ORACLES["median_impute"] = f"""
WITH {SIDES}, m AS (SELECT median(C1) AS c, median(TransactionAmt) AS a, median(sparse90) AS s FROM train)
SELECT TransactionID, {_r('COALESCE(C1, c)', 'C1')}, {_r('COALESCE(TransactionAmt, a)', 'TransactionAmt')},
  {_r('COALESCE(sparse90, s)', 'sparse90')} FROM val, m"""
ORACLES["mode_impute"] = f"""
WITH {SIDES}, m AS (SELECT {_mode_of('DeviceInfo')} AS d, {_mode_of('ProductCD')} AS p)
SELECT TransactionID, COALESCE(DeviceInfo, d) AS DeviceInfo, COALESCE(ProductCD, p) AS ProductCD FROM val, m"""
ORACLES["ordinal_encode"] = f"""
WITH {SIDES}, m AS (
  SELECT (SELECT median(C1) FROM train) AS c, (SELECT median(TransactionAmt) FROM train) AS a,
         (SELECT median(sparse90) FROM train) AS s, {_mode_of('DeviceInfo')} AS d, {_mode_of('ProductCD')} AS p),
filled AS (
  SELECT TransactionID, COALESCE(C1, c) AS C1, COALESCE(TransactionAmt, a) AS amt, COALESCE(sparse90, s) AS sp,
         COALESCE(DeviceInfo, d) AS device, COALESCE(ProductCD, p) AS product FROM val, m)
SELECT TransactionID, {_r('C1', 'num__C1')}, {_r('amt', 'num__TransactionAmt')}, {_r('sp', 'num__sparse90')},
  {_r('COALESCE(dv.code, -1)', 'cat__DeviceInfo')}, {_r('COALESCE(pv.code, -1)', 'cat__ProductCD')}
FROM filled LEFT JOIN {_code_of('DeviceInfo')} dv ON dv.v = device LEFT JOIN {_code_of('ProductCD')} pv ON pv.v = product"""
ORACLES["ordinal_encode_broadcast"] = ORACLES["ordinal_encode_shuffled"] = ORACLES["ordinal_encode"]
ORACLES["unseen_categories"] = f"WITH {SIDES} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) AS unseen FROM (SELECT {c} FROM val WHERE {c} IS NOT NULL
EXCEPT SELECT {c} FROM train WHERE {c} IS NOT NULL)"""
    for c in ("DeviceInfo", "ProductCD")
)
ORACLES["reloaded_prep"] = ORACLES["ordinal_encode"]
ORACLES["preprocess_report"] = f"""
WITH {SIDES} SELECT (SELECT CAST(t_cut AS VARCHAR) FROM cut) AS t_cut, 3::BIGINT AS n_numeric, 2::BIGINT AS n_categorical,
  'C1,TransactionAmt,sparse90,DeviceInfo,ProductCD' AS feature_order, (SELECT COUNT(*) FROM train) AS train_rows,
  5::BIGINT AS width, (SELECT COUNT(*) FROM val) AS val_rows, CAST((SELECT SUM(unseen) FROM ({ORACLES["unseen_categories"]})) AS BIGINT) AS unseen"""
ORACLES["platt_probs"] = f"""
WITH RECURSIVE {SCORED}, b AS (SELECT score AS s, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS tp FROM scored GROUP BY 1),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS base
  UNION ALL
  SELECT k + 1, slope - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), base - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (
    SELECT k, slope, base, SUM((n * p - tp) * s) + slope AS ga, SUM(n * p - tp) AS gb,
      SUM(n * p * (1 - p) * s * s) + 1 AS haa, SUM(n * p * (1 - p) * s) AS hab, SUM(n * p * (1 - p)) AS hbb
    FROM (SELECT k, slope, base, s, n, tp, 1 / (1 + exp(-(slope * s + base))) AS p FROM steps, b WHERE k < 25)
    GROUP BY k, slope, base))
SELECT id, epoch_us(time) AS time, y::BIGINT AS y, {_r('score', 'score')},
  round(1 / (1 + exp(-(slope * score + base))), 6) AS p_cal
FROM scored, steps WHERE k = 25"""
ORACLES["class_weight"] = f"""
WITH {SCORED}, {CUT.format(time='time', table='scored')}, t AS (
  SELECT SUM(y) AS pos, SUM(1 - y) AS neg FROM scored, cut WHERE epoch_us(time) <= t_cut)
SELECT CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(neg::DOUBLE / pos, 2) AS scale_pos_weight FROM t"""
_FOLDS = (("2024-01-10", "2024-01-17"), ("2024-01-17", "2024-01-24"), ("2024-01-24", "2024-01-31"))
ORACLES["fold_sizes"] = f"WITH {SCORED} " + " UNION ALL ".join(
    f"""SELECT COUNT(*) AS n_rows, CAST(COALESCE(SUM(y), 0) AS BIGINT) AS pos, CAST({i} AS BIGINT) AS fold, '{side}' AS side FROM scored WHERE {test}"""
    for i, (begin, end) in enumerate(_FOLDS)
    for side, test in (
        ("train", f"time <= TIMESTAMP '{begin}'"),
        ("val", f"time > TIMESTAMP '{begin}' AND time <= TIMESTAMP '{end}'"),
    )
)
