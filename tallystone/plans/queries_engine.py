"""Walk-forward choice, the risk model, training sets and model-filtered signals. Fits have no SQL; tests hold them against a brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.engine import walkforward
from tallystone.models import bayes, fits, logistic, registry
from tallystone.operators import allocation, labeling, signals, validation
from tallystone.operators.persist import cut, shared_folder
from tallystone.operators.series import bars, forward_drawdown_label
from tallystone.operators.strategies import strategy, weights_of
from tallystone.plans import fit_sql
from tallystone.plans.catalog import register
from tallystone.plans.queries_joins import BARRIER, SIDES
from tallystone.plans.queries_signals import EWM, FEATURES_SQL, RISK_SQL, _index, market
from tallystone.plans.views import L, cut_candles, long_candles

LOOKBACKS = (20, 60, 120)


def _returns(s: SparkSession, d: str) -> DataFrame:
    c = cut_candles(s, d)
    chosen = {f"{n:03d}": strategy("momentum", lookback=n, top_n=2) for n in LOOKBACKS}
    return signals.weighted_returns(weights_of(c, chosen), c)


def _windows(s: SparkSession) -> DataFrame:
    return walkforward.year_windows(s, 1992, 1998)


RETURNS = f"""{L}, steps AS (SELECT secid, lag(date) OVER w AS decided, date, close / lag(close) OVER w - 1 AS ret FROM l WINDOW w AS (PARTITION BY secid ORDER BY date)),
ranks AS ({" UNION ALL ".join(f"SELECT '{n:03d}' AS config, secid, date, row_number() OVER (PARTITION BY date ORDER BY m DESC, secid) AS place FROM (SELECT secid, date, close / lag(close, {n}) OVER (PARTITION BY secid ORDER BY date) - 1 AS m FROM l) WHERE m IS NOT NULL" for n in LOOKBACKS)}),
rets AS (SELECT config, s.date, sum(0.5 * s.ret) AS ret FROM ranks r JOIN steps s ON s.secid = r.secid AND s.decided = r.date WHERE place <= 2 AND s.ret IS NOT NULL GROUP BY 1, 2),
wins AS (SELECT CAST(y - 1992 AS INTEGER) AS win, make_date(y, 1, 1) AS a, make_date(y + 3, 12, 31) AS b, make_date(y + 4, 1, 1) AS c, make_date(y + 4, 12, 31) AS e FROM range(1992, 1995) AS t(y)),
inw AS (SELECT win, config, phase, rets.date, ret FROM rets JOIN (SELECT win, 'train' AS phase, a AS lo, b AS hi FROM wins UNION ALL SELECT win, 'test', c, e FROM wins) ON rets.date BETWEEN lo AND hi),
res AS (SELECT win, config, phase, sum(ln(greatest(1 + ret, 1e-6))) AS log_growth, avg(ret) / stddev_samp(ret) AS sharpe, count(*) AS n FROM inw GROUP BY 1, 2, 3),
cho AS (SELECT * FROM (SELECT win, config, sharpe, row_number() OVER (PARTITION BY win ORDER BY sharpe DESC NULLS LAST, config) AS place FROM res WHERE phase = 'train') WHERE place = 1)"""
register(
    "x6_strategies",
    lambda s, d: weights_of(long_candles(s, d), {"held": strategy("buy_and_hold", secid="ASIA", weight=0.4), "reverting": strategy("mean_reversion", lookback=20, top_n=2)}),
    f"""WITH {L}, r AS (SELECT secid, date, close / lag(close, 20) OVER (PARTITION BY secid ORDER BY date) - 1 AS m FROM l)
SELECT 'held' AS config, secid, date, 0.4::DOUBLE AS weight FROM l WHERE secid = 'ASIA' UNION ALL
SELECT 'reverting', secid, date, 0.5 FROM (SELECT secid, date, row_number() OVER (PARTITION BY date ORDER BY m, secid) AS place FROM r WHERE m IS NOT NULL) WHERE place <= 2""",
    "weight",
)
# returns of these tables are wild, so years' growth is compared by its logarithm
register(
    "e14_window_results",
    lambda s, d: walkforward.window_results(_returns(s, d), _windows(s)),
    f'WITH {RETURNS} SELECT win AS "window", config, phase, log_growth, sharpe, n FROM res',
    "log_growth sharpe",
)
register("t4_choice", lambda s, d: walkforward.choose(walkforward.window_results(_returns(s, d), _windows(s))), f'WITH {RETURNS} SELECT win AS "window", config, sharpe AS metric FROM cho', "metric")


def out_of_sample(s: SparkSession, d: str) -> DataFrame:
    returns, windows = cut(_returns(s, d)), _windows(s)
    return walkforward.out_of_sample(returns, windows, walkforward.choose(walkforward.window_results(returns, windows)))


register("e14_out_of_sample", out_of_sample, f"""WITH {RETURNS} SELECT inw.date, inw.win AS "window", inw.config, ret FROM inw JOIN cho ON inw.win = cho.win AND inw.config = cho.config WHERE phase = 'test'""", "ret")
register(
    "a19_config_results",
    lambda s, d: walkforward.config_results(walkforward.window_results(_returns(s, d), _windows(s)), _windows(s)).select("config", "log_annual"),
    f"""WITH {RETURNS} SELECT config, sum(log_growth) * 365.25 / sum(date_diff('day', c, e)) AS log_annual FROM res JOIN wins USING (win) WHERE phase = 'test' GROUP BY 1""",
    "log_annual",
)
register(
    "a18_best_and_median",
    lambda s, d: walkforward.best_and_median(walkforward.config_results(walkforward.window_results(_returns(s, d), _windows(s)), _windows(s)), "log_annual"),
    f"""WITH {RETURNS}, r AS (SELECT config, sum(log_growth) * 365.25 / sum(date_diff('day', c, e)) AS annual FROM res JOIN wins USING (win) WHERE phase = 'test' GROUP BY 1)
SELECT max(annual) AS best, quantile_cont(annual, 0.5) AS median, count(*) AS n FROM r WHERE annual IS NOT NULL""",
    "best median",
)


def risk(s: SparkSession, d: str) -> DataFrame:
    equity = _index(s, d, "ASIA")
    features = allocation.risk_features(equity, _index(s, d, "EUROPE"))
    y = equity.select("run_id", "date", forward_drawdown_label("close", 21, 0.3, bars("run_id")).alias("y"))
    names = [c for c in features.columns if c not in ("run_id", "date")]
    return logistic.walk_forward_risk(features.join(y, ["run_id", "date"]), names, 1995, least_rows=250)


RISK = "vol20 vol60 vol_ratio mom20 mom120 dd250 ma200 bond_mom60 bond_vol20".split()
register(
    "e16_risk_forecast",
    risk,
    f"""WITH RECURSIVE {RISK_SQL[0]}, ft AS ({RISK_SQL[1]}),
lb AS (SELECT date, CASE WHEN count(close) OVER ahead = 21 THEN CAST(min(close) OVER ahead / close - 1 <= -0.3 AS INTEGER) END AS y FROM eq WINDOW ahead AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
kn AS (SELECT ft.*, y, year(ft.date) AS forecast, row_number() OVER (ORDER BY ft.date) - 1 AS pos, {" AND ".join(f"{f} IS NOT NULL AND NOT isnan({f})" for f in RISK)} AS known FROM ft JOIN lb USING (date)),
al AS (SELECT *, count(*) FILTER (known AND y IS NOT NULL) OVER (ORDER BY date) - 1 AS rank FROM kn),
yr AS (SELECT forecast, min(pos) AS start FROM al WHERE forecast >= 1995 GROUP BY 1),
pa AS (SELECT yr.forecast, al.rank, al.y, {", ".join(f"al.{f}" for f in RISK)} FROM al JOIN yr ON al.pos < yr.start - 21 WHERE known AND y IS NOT NULL),
{fit_sql.calibrated("rm", "pa", ["forecast"], RISK, 250)}
SELECT 'fund' AS run_id, al.date, {fit_sql.probability(RISK)} AS proba, all_ones / everyone AS base_rate FROM al JOIN rm USING (forecast) WHERE known""",
    "proba base_rate",
)

START, END, HOLDING = "1992-01-01", "1998-12-31", 20


def training(c: DataFrame) -> DataFrame:
    return signals.training_set(c, START, END, 60, 2, HOLDING, 1.0, 20, *market(c))


TRAINING = f"""{FEATURES_SQL}, {EWM},
n AS (SELECT secid, date, close, row_number() OVER (PARTITION BY secid ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY secid) AS n_bars FROM l),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM l)),
ent AS (SELECT max(date) AS date FROM cal WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY date_trunc('month', date)),
open_ AS (SELECT ent.date FROM ent JOIN cal USING (date) WHERE pos + {HOLDING} <= (SELECT count(*) FROM cal WHERE date < DATE '{END}')),
pick AS (SELECT * FROM (SELECT secid, date, row_number() OVER (PARTITION BY date ORDER BY m DESC, secid) AS place FROM (SELECT secid, date, close / lag(close, 60) OVER (PARTITION BY secid ORDER BY date) - 1 AS m FROM l) WHERE m IS NOT NULL) WHERE place <= 2),
ev AS (SELECT n.secid, n.date AS t0, n.close AS entry, n.pos, least(n.pos + {HOLDING}, n.n_bars - 1) AS stop, ewm.ewm_std AS target FROM pick JOIN open_ USING (date) JOIN n ON n.secid = pick.secid AND n.date = pick.date
  JOIN ewm ON ewm.secid = n.secid AND ewm.date = n.date WHERE ewm.ewm_std > 0),
pa AS (SELECT ev.*, n.pos AS spot, n.date AS bar, n.close / ev.entry - 1 AS ret FROM ev JOIN n ON n.secid = ev.secid AND n.pos BETWEEN ev.pos AND ev.stop WHERE ev.stop > ev.pos),
hit AS (SELECT secid, t0, min(spot) FILTER (ret >= target) AS up, min(spot) FILTER (ret <= -target) AS down, max(spot) AS stop FROM pa GROUP BY 1, 2),
lab AS (SELECT hit.secid, hit.t0, pa.bar AS t1, CAST(pa.ret > 0 AS INTEGER) AS y FROM hit JOIN pa ON pa.secid = hit.secid AND pa.t0 = hit.t0 AND pa.spot = least(hit.stop, hit.up, hit.down))
SELECT lab.*, {", ".join("bf." + f for f in signals.BET_FEATURES)} FROM lab JOIN bf ON bf.secid = lab.secid AND bf.date = lab.t0 WHERE {" AND ".join(f"bf.{f} IS NOT NULL" for f in signals.BET_FEATURES)}"""
TRAINING_WITH = TRAINING.rpartition("\nSELECT lab.*")[0] + ",\ntset AS (SELECT lab.*" + TRAINING.rpartition("\nSELECT lab.*")[2] + ")"
register("m11_training_set", lambda s, d: training(cut_candles(s, d)), f"WITH {TRAINING}", " ".join(signals.BET_FEATURES))


def modelled(c: DataFrame) -> DataFrame:
    """(secid, date, proba) of every bar with known features, by a model of the training set."""
    model = logistic.fitted(training(c), signals.BET_FEATURES)
    known = signals.bet_features(c, *market(c)).na.drop(subset=signals.BET_FEATURES)
    return known.select("secid", "date", (F.lit(None).cast("double") if model is None else model.column()).alias("proba"))


def model_filtered(s: SparkSession, d: str, least: float) -> DataFrame:
    c = cut_candles(s, d)
    return signals.meta_filtered(signals.ranked(c, "momentum", 60, 2), modelled(c), least)


MODELLED = f"""{TRAINING_WITH},
ts AS (SELECT 0 AS model, y, {", ".join(signals.BET_FEATURES)}, row_number() OVER (ORDER BY t0, {", ".join(signals.BET_FEATURES)}) - 1 AS rank FROM tset),
{fit_sql.calibrated("cm", "ts", ["model"], signals.BET_FEATURES, 40)},
pr AS (SELECT bf.secid, bf.date, {fit_sql.probability(signals.BET_FEATURES)} AS proba FROM bf LEFT JOIN cm ON true WHERE {" AND ".join(f"bf.{f} IS NOT NULL" for f in signals.BET_FEATURES)})"""
register("m12_model_probabilities", lambda s, d: modelled(cut_candles(s, d)), f"WITH RECURSIVE {MODELLED} SELECT secid, date, proba FROM pr", "proba")
for _name, _least in (("q8_model_filtered", 0.5), ("q8_meta_filtered", 0.6)):
    register(
        _name,
        lambda s, d, least=_least: model_filtered(s, d, least),
        f"""WITH RECURSIVE {MODELLED}, k AS (SELECT secid, date, row_number() OVER (PARTITION BY date ORDER BY m DESC, secid) AS place FROM (SELECT secid, date, close / lag(close, 60) OVER (PARTITION BY secid ORDER BY date) - 1 AS m FROM l) WHERE m IS NOT NULL)
SELECT k.secid, k.date, 0.5::DOUBLE AS weight, proba FROM k JOIN pr ON pr.secid = k.secid AND pr.date = k.date WHERE place <= 2 AND proba >= {_least}""",
        "weight proba",
    )
for _name, _least in (("q8_model_most_confident", 0.5), ("q8_most_confident", 0.6)):
    register(
        _name,
        lambda s, d, least=_least: signals.most_confident(modelled(cut_candles(s, d)), least, 2),
        f"""WITH RECURSIVE {MODELLED}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, secid) AS place FROM pr WHERE proba >= {_least})
SELECT secid, date, 0.5::DOUBLE AS weight, proba FROM k WHERE place <= 2""",
        "weight proba",
    )

BETS = ["mom20", "vol20", "ma50"]


def bets(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, t0, y, features) of every bar's bet, and its labels (secid, t0, t1)."""
    events = labeling.numbered(c).select("secid", F.col("date").alias("t0"), F.lit(0.02).alias("target"), F.lit(1.0).alias("side"))
    labels = labeling.meta_labels(events, c)
    features = signals.bet_features(c).select(F.col("secid").alias("key"), F.col("date").alias("t0"), *BETS).na.drop()
    return labels.select(F.col("secid").alias("key"), "t0", F.col("meta").alias("y")).join(features, ["key", "t0"]), labels.select("secid", "t0", "t1")


def importance(s: SparkSession, d: str) -> DataFrame:
    data, labels = bets(cut_candles(s, d))
    return logistic.permutation_importance(data, BETS, validation.purged_folds(labels).withColumnRenamed("secid", "key"))


def _fit(s: SparkSession, d: str) -> DataFrame:
    """A weighted model for each security: bets weigh what their labels have for themselves."""
    c = cut_candles(s, d)
    data, labels = bets(c)
    weights = labeling.concurrency_weights(labels, c).withColumnRenamed("secid", "key")
    rows = cut(data.join(weights, ["key", "t0"]))
    found = fits.fit(rows, ["key"], BETS, weight="weight")
    return found.table(rows).select("key", F.posexplode("_coef").alias("i", "coef"), F.col("_constant").alias("constant"), F.col("_count").alias("n"), F.col("_ones").alias("ones"))


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    data, _ = bets(cut_candles(s, d))
    rows = cut(data.withColumn("rank", F.row_number().over(bars("key", "t0")) - 1))
    found = fits.fit_calibrated(rows, ["key"], BETS, "rank")
    table = found.table(rows)
    return fits.beside(rows, table, ["key"], len(found.names)).select("key", "t0", fits.probability(BETS).alias("proba"), F.col("_slope").alias("slope"), F.col("_level").alias("level"))


BETS_SQL = f"""{L}, {BARRIER.replace(SIDES, "1.0::DOUBLE AS side")},
x AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM l WINDOW w AS (PARTITION BY secid ORDER BY date)),
own AS (SELECT secid, date, close / lag(close, 20) OVER w - 1 AS mom20, CASE WHEN count(ret) OVER f20 = 20 THEN stddev_samp(ret) OVER f20 END AS vol20, close / CASE WHEN count(close) OVER f50 = 50 THEN avg(close) OVER f50 END - 1 AS ma50
  FROM x WINDOW w AS (PARTITION BY secid ORDER BY date), f20 AS (PARTITION BY secid ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY secid ORDER BY date ROWS 49 PRECEDING)),
bets AS (SELECT b.secid AS key, b.t0, CAST(b.ret > 0 AS INTEGER) AS y, mom20, vol20, ma50 FROM b JOIN own ON own.secid = b.secid AND own.date = b.t0 WHERE mom20 IS NOT NULL AND vol20 IS NOT NULL AND ma50 IS NOT NULL)"""
register(
    "m4_fit",
    _fit,
    f"""WITH RECURSIVE {BETS_SQL}, sp AS (SELECT b.secid, b.t0, n.pos FROM b JOIN n ON n.secid = b.secid AND n.date BETWEEN b.t0 AND b.t1), al AS (SELECT secid, pos, count(*) AS c FROM sp GROUP BY 1, 2),
ra AS (SELECT sp.secid, sp.t0, avg(1.0 / c) AS raw FROM sp JOIN al USING (secid, pos) GROUP BY 1, 2), cw AS (SELECT secid, t0, raw / avg(raw) OVER (PARTITION BY secid) AS weight FROM ra),
wb AS (SELECT bets.*, weight FROM bets JOIN cw ON cw.secid = bets.key AND cw.t0 = bets.t0), {fit_sql.fits("fm", "wb", ["key"], BETS, "weight")}
SELECT key, CAST(unnest([0, 1, 2]) AS INTEGER) AS i, unnest([b0, b1, b2]) AS coef, b3 AS constant, n, CAST(ones AS BIGINT) AS ones FROM fm""",
    "coef constant",
)
register(
    "m5_calibrated",
    _calibrated,
    f"""WITH RECURSIVE {BETS_SQL}, rb AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t0) - 1 AS rank FROM bets), {fit_sql.calibrated("cm", "rb", ["key"], BETS)}
SELECT key, t0, {fit_sql.probability(BETS)} AS proba, slope, level FROM rb JOIN cm USING (key)""",
    "proba slope level",
)
_hash = "md5('42:' || fold || ':' || feature || ':{side}:' || key || ':' || strftime(t0, '%Y-%m-%d'))"
register(
    "m8_permutation_importance",
    importance,
    f"""WITH RECURSIVE {BETS_SQL},
i AS (SELECT secid, t0, t1, row_number() OVER o - 1 AS pos, ntile(5) OVER o - 1 AS fold, count(*) OVER (PARTITION BY secid) AS n FROM b WINDOW o AS (PARTITION BY secid ORDER BY t0)),
g AS (SELECT secid, fold, n, min(t0) AS lo, max(t1) AS hi FROM i GROUP BY 1, 2, 3),
k AS (SELECT g.*, (SELECT count(*) FROM i WHERE i.secid = g.secid AND i.t0 <= g.hi) + CAST(floor(g.n * 0.01) AS BIGINT) AS r FROM g),
fo AS (SELECT i.secid AS key, k.fold, i.t0, i.fold = k.fold AS test FROM i JOIN k ON i.secid = k.secid WHERE i.fold = k.fold OR i.t1 < k.lo OR i.pos >= k.r),
jo AS (SELECT fo.fold, fo.test, bets.* FROM fo JOIN bets USING (key, t0)), tr AS (SELECT * FROM jo WHERE NOT test), {fit_sql.fits("fm", "tr", ["fold"], BETS)},
te AS (SELECT fold, key, t0, y = 1 AS y, [{", ".join(f"({f} - m{i}) / d{i} * b{i}" for i, f in enumerate(BETS))}] AS own, {fit_sql.margin(BETS)} AS z FROM jo JOIN fm USING (fold) WHERE test),
ea AS (SELECT fold, key, t0, y, z, unnest({BETS!r}) AS feature, unnest(own) AS share FROM te),
ra AS (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY {_hash.format(side="to")}, key, t0) AS a, row_number() OVER (PARTITION BY fold, feature ORDER BY {_hash.format(side="from")}, key, t0) AS c FROM ea),
sc AS (SELECT p.fold, p.feature, avg(CASE WHEN (p.z - p.share + q.share >= 0) = p.y THEN 1.0 ELSE 0.0 END) AS score FROM ra AS p JOIN ra AS q ON p.fold = q.fold AND p.feature = q.feature AND p.a = q.c GROUP BY 1, 2),
ba AS (SELECT fold, avg(CASE WHEN (z >= 0) = y THEN 1.0 ELSE 0.0 END) AS base FROM te GROUP BY 1)
SELECT feature, avg(base - score) AS mean_drop, stddev_pop(base - score) AS std_drop FROM sc JOIN ba USING (fold) GROUP BY 1""",
    "mean_drop std_drop",
)


def _scored_by_protocol(s: SparkSession, d: str) -> DataFrame:
    """Both models of all bets, through the registry, by the one protocol."""
    data = cut(bets(cut_candles(s, d))[0])
    store, out = registry.Models(s, f"{shared_folder(s)}/models-{uuid.uuid4().hex}"), None
    found = {"bayes": bayes.fit_bayes(data, BETS), "linear": logistic.fitted(data.withColumn("secid", F.col("key")), BETS)}
    for name, model in found.items():
        store.register(registry.Card(name, BETS, END, "bets", {}), model)
        one = registry.scored(data, store.load(name)[0]).select(F.lit(name).alias("model"), "key", "t0", "proba")
        out = one if out is None else out.unionByName(one)
    return out


_bayes = " ".join(f"+ pow({f} - m0_{i}, 2) / (2 * v0_{i}) - pow({f} - m1_{i}, 2) / (2 * v1_{i}) + 0.5 * ln(v0_{i} / v1_{i})" for i, f in enumerate(BETS))
register(
    "x4_models",
    _scored_by_protocol,
    f"""WITH RECURSIVE {BETS_SQL},
rb AS (SELECT 0 AS model, *, row_number() OVER (ORDER BY t0, {", ".join(BETS)}) - 1 AS rank FROM bets), {fit_sql.calibrated("cm", "rb", ["model"], BETS, 40)},
nb AS (SELECT count(*) FILTER (y = 1) / count(*) FILTER (y = 0) AS odds, {", ".join(f"avg({f}) FILTER (y = {c}) AS m{c}_{i}, greatest(var_pop({f}) FILTER (y = {c}), 1e-12) AS v{c}_{i}" for c in (0, 1) for i, f in enumerate(BETS))} FROM bets)
SELECT 'bayes' AS model, key, t0, 1 / (1 + exp(-(ln(odds) {_bayes}))) AS proba FROM bets CROSS JOIN nb
UNION ALL SELECT 'linear', key, t0, {fit_sql.probability(BETS)} FROM rb JOIN cm USING (model)""",
    "proba",
)
