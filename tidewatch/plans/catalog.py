"""Registered queries of the engine and the DuckDB SQL that states the same result."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.functions import storage
from tidewatch.functions.scalar import even
from tidewatch.ml import autoencoder, bundle, ensemble, iforest, ocsvm, scaler
from tidewatch.operators import alerts, baseline, evaluate, explore, quantiles, sessions
from tidewatch.operators.ordering import with_sequence
from tidewatch.plans import fixed, oracle, train
from tidewatch.schema import DATASET, FEATURES
from tidewatch.sources import alerts as alert_source
from tidewatch.sources import simulate, tables
from tidewatch.sources.telemetry import raw_events
from tidewatch.streaming import detector, native

#: Minutes that make sessions of many events from the events table, and the default.
LONG, SHORT = 720, 60
SESSION_COLUMNS = ("username", "timestamp")
CONFIG = Config()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def found(spark: SparkSession, sf_dir: str, minutes: int = LONG) -> DataFrame:
    return sessions.sessions(events(spark, sf_dir), minutes)


def features(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    return sessions.session_features(events(spark, sf_dir), CONFIG, LONG, split)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.user_zscores(features(spark, sf_dir))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as doubles, for statistics."""
    return scored(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in FEATURES])


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of three fixed rules in the models' places, and a label from other columns."""
    g = scored(spark, sf_dir)
    rule = {"isolation_forest": F.abs("z_score_files") > 1.0, "one_class_svm": F.col("bytes_sent") > 50000, "autoencoder": F.col("entropy_commands") > 0.5}
    label = F.when(F.col("nb_failed_logins") >= 3, 2).when(F.col("nb_sensitive_files") > 0, 1).otherwise(0)
    return alerts.verdict(g.withColumns({m: F.struct(c.alias("anomaly")) for m, c in rule.items()}).withColumn("label", label), CONFIG.detection.ensemble_threshold)


def simulated(spark: SparkSession):
    return baseline.user_zscores(simulate.training_set(spark))


def trained(spark: SparkSession) -> bundle.Bundle:
    return bundle.fit(simulated(spark), CONFIG)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


RAW_COLUMNS = ("_seq", "username", "event_id", "src_ip", "file_path", "process_name", "command_line", "bytes_sent")


@query("raw_events", f"WITH {oracle.RAW} SELECT {', '.join(RAW_COLUMNS)} FROM raw")
def _(spark, d):
    return events(spark, d).select(*RAW_COLUMNS)


@query("event_class_counts", f"WITH {oracle.RAW} SELECT CASE event_id WHEN '4624' THEN 'login_success' WHEN '4625' THEN 'login_failed' WHEN '4663' THEN 'file_access' WHEN '4688' THEN 'process' WHEN '3' THEN 'network' ELSE 'other' END AS class, count(*) AS n FROM raw GROUP BY ALL")
def _(spark, d):
    from tidewatch.schema import CLASSES

    kind = F.lit("other")
    for name, ids in CLASSES.items():
        kind = F.when(F.col("event_id").isin(*ids), name).otherwise(kind)
    return events(spark, d).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("alert_extraction", f"WITH {oracle.RAW} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts_text, {', '.join(RAW_COLUMNS[1:])} FROM raw")
def _(spark, d):
    """Events written as nested alert lines, read and flattened again."""
    rows = events(spark, d)
    win = F.struct(F.struct(F.col("event_id").alias("eventID")).alias("system"), F.struct(F.upper("username").alias("targetUserName"), F.col("src_ip").alias("ipAddress"), F.col("file_path").alias("targetFilename"), F.col("process_name").alias("image"), F.col("command_line").alias("commandLine")).alias("eventdata"))
    alert = F.struct(F.regexp_replace("ts_text", r"\+00:00$", "Z").alias("timestamp"), F.struct(win.alias("win"), "bytes_sent").alias("data"))
    path = storage.fresh(spark, "alerts")
    rows.select(F.to_json(alert).alias("value")).write.text(path)
    return alert_source.raw_events(alert_source.load(spark, path)).select("ts_text", *RAW_COLUMNS[1:])


def bounds(spark, d, minutes):
    s = found(spark, d, minutes)
    minutes_long = even(F.greatest((F.unix_micros("last_ts") - F.unix_micros("start_ts")) / 1e6 / 60, F.lit(1.0)), 2)
    return s.select("username", F.col("start.ts_text").alias("timestamp"), "nb_events", minutes_long.alias("session_duration_min"))


def bounds_sql(minutes):
    return f"WITH {oracle.sessions(minutes)} SELECT s.username, timestamp, nb_events, session_duration_min FROM sess s JOIN f ON s.username = f.username AND s.sid = f.sid"


@query("sessions_60m", bounds_sql(SHORT))
def _(spark, d):
    return bounds(spark, d, SHORT)


@query("sessions_720m", bounds_sql(LONG))
def _(spark, d):
    return bounds(spark, d, LONG)


def plain(columns: str):
    """A query over sessions and the same columns in SQL."""
    sql = f"WITH {oracle.sessions(LONG)} SELECT username, strftime(start_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, {columns} FROM sess"
    return sql, lambda spark, d: found(spark, d).select("username", F.col("start.ts_text").alias("timestamp"), *[c.strip() for c in columns.split(",")])


for _name, _columns in (("session_counts", "login_count, logout_count, nb_failed_logins, nb_files_accessed, nb_processes"), ("session_bytes", "bytes_sent"), ("session_new_ip", "new_ip, first_ip"), ("session_first_process", "process_name, command_line")):
    _sql, _f = plain(_columns)
    query(_name, _sql)(_f)


def chosen(columns: str):
    """A query over feature rows and the same columns in SQL."""
    names = [*SESSION_COLUMNS, *[c.strip() for c in columns.split(",")]]
    return f"WITH {oracle.sessions(LONG)} SELECT {', '.join(names)} FROM f", lambda spark, d: features(spark, d).select(*names)


for _name, _columns in (("session_sensitive", "nb_sensitive_files, sensitive_path_access"), ("session_entropy", "entropy_commands"), ("session_velocity", "velocity, session_duration_min"), ("session_time_flags", "hour, is_night, is_weekend")):
    _sql, _f = chosen(_columns)
    query(_name, _sql)(_f)


DATASET_SQL = f"WITH {oracle.scored(LONG)} SELECT {', '.join(DATASET)} FROM g"


@query("session_features", DATASET_SQL)
def _(spark, d):
    return baseline.dataset(scored(spark, d))


@query("session_features_split", DATASET_SQL)
def _(spark, d):
    """The same by the plan for data in which one user holds a large part of all rows."""
    return baseline.dataset(baseline.user_zscores(features(spark, d, split="week"), skewed=True))


@query("user_zscores", f"WITH {oracle.scored(LONG)} SELECT username, timestamp, z_score_files, z_score_logins FROM g")
def _(spark, d):
    return scored(spark, d).select("username", "timestamp", "z_score_files", "z_score_logins")


@query("rolling_zscores", f"""WITH {oracle.sessions(LONG)},
q AS (SELECT *, row_number() OVER (ORDER BY username, start_ts) - 1 AS seq FROM f)
SELECT seq, username, timestamp, {oracle.z('nb_files_accessed', 'h')} AS z_score_files, {oracle.z('nb_failed_logins', 'h')} AS z_score_logins
FROM q WINDOW h AS (PARTITION BY username ORDER BY seq RANGE BETWEEN 500 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    numbered = with_sequence(features(spark, d), "username", "start_ts")
    return baseline.rolling_zscores(numbered, CONFIG.daemon.history_size).select("seq", "username", "timestamp", "z_score_files", "z_score_logins")


@query("dataset_export", DATASET_SQL)
def _(spark, d):
    path = storage.fresh(spark, "export")
    tables.write_csv(baseline.dataset(scored(spark, d)), path)
    return tables.read_csv(spark, path).select(*DATASET)


def describe_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS count, round(avg(x), 3) + 0.0 AS mean, round(stddev_samp(x), 3) AS std, round(min(x), 3) + 0.0 AS min, round(quantile_cont(x, 0.25), 3) + 0.0 AS q25, round(quantile_cont(x, 0.5), 3) + 0.0 AS q50, round(quantile_cont(x, 0.75), 3) + 0.0 AS q75, round(max(x), 3) + 0.0 AS max FROM (SELECT CAST({c} AS DOUBLE) AS x FROM g)" for c in FEATURES)
    return f"WITH {oracle.scored(LONG)} {rows}"


@query("feature_describe", describe_sql())
def _(spark, d):
    return explore.describe(numbers(spark, d))


def correlation_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN max({a}) <> min({a}) AND max({b}) <> min({b}) THEN round(corr({a}, {b}), 6) + 0.0 END AS r FROM g" for a, b in combinations(FEATURES, 2))
    return f"WITH {oracle.scored(LONG)} {rows}"


@query("feature_correlation", correlation_sql())
def _(spark, d):
    return explore.correlation(numbers(spark, d))


@query("hour_histogram", f"WITH {oracle.sessions(LONG)} SELECT CAST(h AS INT) AS hour, count(f.hour) AS n FROM range(24) t(h) LEFT JOIN f ON f.hour = h GROUP BY h")
def _(spark, d):
    return explore.hours(features(spark, d))


HISTOGRAM = """,
x AS (SELECT CAST(nb_files_accessed AS DOUBLE) AS x FROM g),
l AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS sd, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 30 ELSE 1.0 END AS width FROM x),
c AS (SELECT CAST(least(floor((x - lo) / width), 29) AS INT) AS bin, count(*) AS n FROM x, l GROUP BY 1)
SELECT CAST(b AS INT) AS bin, lo + b * width AS low, coalesce(n, 0) AS n, round(mean + 2 * coalesce(sd, 0), 6) AS sigma_2, round(mean + 3 * coalesce(sd, 0), 6) AS sigma_3 FROM range(30) t(b) CROSS JOIN l LEFT JOIN c ON c.bin = b"""


@query("feature_histogram", f"WITH {oracle.scored(LONG)}{HISTOGRAM}")
def _(spark, d):
    h = explore.histogram(scored(spark, d), "nb_files_accessed")
    return h.select("bin", "low", "n", F.round("sigma_2", 6).alias("sigma_2"), F.round("sigma_3", 6).alias("sigma_3"))


@query("score_histogram", f"""WITH {oracle.voted(LONG)},
x AS (SELECT velocity AS x, is_anomaly AS flag FROM w),
l AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS width FROM x)
SELECT flag, CAST(least(floor((x - lo) / width), 29) AS INT) AS bin, round(lo + least(floor((x - lo) / width), 29) * width, 9) AS low, count(*) AS n FROM x, l GROUP BY ALL""")
def _(spark, d):
    return explore.split_histogram(voted(spark, d), "velocity", "is_anomaly").select("flag", "bin", F.round("low", 9).alias("low"), "n")


def scaled_sql() -> str:
    parts = ", ".join(f"round((CAST(CAST({c} AS FLOAT) AS DOUBLE) - (SELECT avg(CAST(CAST({c} AS FLOAT) AS DOUBLE)) FROM g)) / (SELECT CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE stddev_pop(CAST(CAST({c} AS FLOAT) AS DOUBLE)) END FROM g), 3) + 0.0 AS {c}" for c in FEATURES)
    return f"WITH {oracle.scored(LONG)} SELECT username, timestamp, {parts} FROM g"


@query("scaled_features", scaled_sql())
def _(spark, d):
    data = scored(spark, d)
    out = scaler.transform(data, scaler.fit(data))
    return out.select("username", "timestamp", *[(F.round(F.col("scaled")[i].cast("double"), 3) + F.lit(0.0)).alias(c) for i, c in enumerate(FEATURES)])


@query("rule_votes", f"WITH {oracle.voted(LONG)} SELECT username, timestamp, votes, is_anomaly, confidence FROM w")
def _(spark, d):
    return voted(spark, d).select("username", "timestamp", "votes", "is_anomaly", "confidence")


@query("vote_distribution", f"WITH {oracle.voted(LONG)} SELECT CAST(k AS INT) AS votes, count(w.votes) AS n, round(count(w.votes) / (SELECT count(*) FROM w), 6) AS share FROM range(4) t(k) LEFT JOIN w ON w.votes = k GROUP BY k")
def _(spark, d):
    return evaluate.vote_distribution(voted(spark, d))


@query("alert_severity", f"""WITH {oracle.voted(LONG)} SELECT username, timestamp AS session_ts, votes, confidence,
CASE WHEN votes = 3 OR (votes = 2 AND (nb_sensitive_files > 0 OR nb_failed_logins >= 5 OR is_night <> 0)) THEN 'HIGH' WHEN votes = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
'ueba_anomaly' AS type, is_night = 1 AS is_night, nb_failed_logins, process_name, bytes_sent FROM w WHERE is_anomaly""")
def _(spark, d):
    rows = voted(spark, d).drop(*alerts.MODELS)
    return alerts.shaped(rows).select("username", "session_ts", "votes", "confidence", "severity", "type", "indicators.is_night", "indicators.nb_failed_logins", "indicators.process_name", "indicators.bytes_sent")


@query("anomaly_rates", f"WITH {oracle.voted(LONG)} SELECT 'first' AS name, round(avg(CAST(a AS INT)), 6) AS rate FROM w UNION ALL SELECT 'second', round(avg(CAST(b AS INT)), 6) FROM w UNION ALL SELECT 'third', round(avg(CAST(c AS INT)), 6) FROM w UNION ALL SELECT 'vote', round(avg(CAST(is_anomaly AS INT)), 6) FROM w")
def _(spark, d):
    rows = voted(spark, d).select("is_anomaly", *[F.col(m)["anomaly"].alias(m) for m in alerts.MODELS])
    return explore.rates(rows, {"first": "isolation_forest", "second": "one_class_svm", "third": "autoencoder", "vote": "is_anomaly"})


@query("label_votes", f"WITH {oracle.voted(LONG)} SELECT CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'insider' WHEN 2 THEN 'malware' END AS label_name, votes, count(*) AS n FROM w GROUP BY ALL")
def _(spark, d):
    return evaluate.label_votes(voted(spark, d))


@query("label_counts", f"WITH {oracle.voted(LONG)} SELECT count(*) FILTER (WHERE label = 0) AS n_normal, count(*) FILTER (WHERE label = 1) AS n_insider, count(*) FILTER (WHERE label = 2) AS n_malware, count(*) AS n FROM w")
def _(spark, d):
    return evaluate.label_counts(voted(spark, d))


CONFUSION = ", m AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT is_anomaly) AS tn, count(*) FILTER (WHERE label = 0 AND is_anomaly) AS fp, count(*) FILTER (WHERE label > 0 AND NOT is_anomaly) AS fn, count(*) FILTER (WHERE label > 0 AND is_anomaly) AS tp FROM w)"


@query("confusion_matrix", f"WITH {oracle.voted(LONG)}{CONFUSION} SELECT * FROM m")
def _(spark, d):
    return evaluate.confusion(voted(spark, d))


@query("classification_report", f"""WITH {oracle.voted(LONG)}{CONFUSION},
p AS (SELECT *, tn + fp AS s0, tp + fn AS s1, coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1 FROM m),
o AS (SELECT *, s0 + s1 AS t, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1, (tn + tp) / (s0 + s1) AS acc FROM p)
SELECT 'normal' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM o
UNION ALL SELECT 'attack', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM o
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), t FROM o
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), t FROM o
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / t, 6), round((r0 * s0 + r1 * s1) / t, 6), round((f0 * s0 + f1 * s1) / t, 6), t FROM o""")
def _(spark, d):
    return evaluate.report(voted(spark, d))


@query("detection_rates", f"WITH {oracle.voted(LONG)}{CONFUSION} SELECT tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, fp / nullif(fp + tn, 0) AS fpr FROM m")
def _(spark, d):
    return evaluate.rates(voted(spark, d))


def radar_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT label, '{c}' AS feature, round(avg({c}) / ((SELECT max({c}) FROM w) + 1e-9), 6) AS value FROM w GROUP BY label" for c in evaluate.RADAR)
    return f"WITH {oracle.voted(LONG)} {rows}"


@query("radar_profile", radar_sql())
def _(spark, d):
    return evaluate.radar(voted(spark, d))


@query("files_vs_bytes", f"WITH {oracle.voted(LONG)} SELECT nb_files_accessed, bytes_sent, label, is_anomaly FROM w")
def _(spark, d):
    return explore.scatter(voted(spark, d))


@query("user_list", f"WITH {oracle.sessions(LONG)} SELECT username, count(*) AS sessions, strftime(min(start_ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM f GROUP BY username")
def _(spark, d):
    return explore.users(features(spark, d)).select("username", "sessions", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("dataset_summary", f"WITH {oracle.sessions(LONG)} SELECT count(*) AS sessions, count(DISTINCT username) AS users, epoch_us(min(start_ts)) AS first_us, epoch_us(max(last_ts)) AS last_us FROM f")
def _(spark, d):
    return explore.summary(features(spark, d)).select("sessions", "users", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("positional_split", f"""WITH {oracle.sessions(LONG)},
q AS (SELECT username, timestamp, row_number() OVER (ORDER BY username, start_ts) - 1 AS seq, count(*) OVER () AS t FROM f)
SELECT username, timestamp, CASE WHEN seq < floor(0.8 * t) THEN 'train' ELSE 'validation' END AS part FROM q""")
def _(spark, d):
    rows = with_sequence(features(spark, d), "username", "start_ts")
    cut = int(0.8 * rows.count())
    return rows.select("username", "timestamp", F.when(F.col("seq") < cut, "train").otherwise("validation").alias("part"))


def fitted_on_events(spark, d):
    """Scaled session features in a table, as each fit reads them several times."""
    data = storage.written(scored(spark, d).select("username", "timestamp", *FEATURES), "features")
    return storage.written(scaler.transform(data, scaler.fit(data)).select("username", "timestamp", "scaled"), "scaled")


@query("iforest_score")
def _(spark, d):
    scaled = fitted_on_events(spark, d)
    return iforest.score(scaled, iforest.fit(scaled)).select("username", "timestamp", "score")


@query("ocsvm_score")
def _(spark, d):
    scaled = fitted_on_events(spark, d)
    return ocsvm.score(scaled, ocsvm.fit(scaled)).select("username", "timestamp", "score")


@query("autoencoder_score")
def _(spark, d):
    """Trained on autoencoder.MOST_ROWS rows at most, all epochs; the threshold and the scores take every row."""
    scaled = fitted_on_events(spark, d)
    model = autoencoder.fit(scaled)
    return autoencoder.score(scaled, model).select("username", "timestamp", "mse", F.lit(model.threshold).alias("threshold"))


@query("autoencoder_history")
def _(spark, d):
    return train.history(spark, bundle.Bundle(autoencoder=autoencoder.fit(fitted_on_events(spark, d))))


@query("ensemble_alerts")
def _(spark, d):
    data = storage.written(scored(spark, d), "features")
    return alerts.shaped(ensemble.predict(data, bundle.fit(data, CONFIG)), stamp()).select("severity", "username", "session_ts", "confidence", "votes")


@query("simulated_evaluation")
def _(spark, d):
    data = baseline.user_zscores(simulate.test_set(spark))
    return evaluate.report(ensemble.predict(data, trained(spark)))


def fixed_prediction(spark, d):
    return ensemble.predict(scored(spark, d), fixed.models(), CONFIG.detection.ensemble_threshold)


FIXED = f"WITH {fixed.scored(LONG)}"


def stamp():
    """A time of alerts that doesn't change."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query("iforest_score_fixed", f"{FIXED} SELECT username, timestamp, round(forest, 6) + 0.0 AS score, a AS anomaly FROM m")
def _(spark, d):
    models = fixed.models()
    out = iforest.score(scaler.transform(scored(spark, d), models.scaler), models.iforest)
    return out.select("username", "timestamp", (F.round("score", 6) + F.lit(0.0)).alias("score"), (F.col("score") < 0).alias("anomaly"))


@query("ocsvm_score_fixed", f"{FIXED} SELECT username, timestamp, round(svm, 6) + 0.0 AS score, b AS anomaly FROM m")
def _(spark, d):
    models = fixed.models()
    out = ocsvm.score(scaler.transform(scored(spark, d), models.scaler), models.ocsvm)
    return out.select("username", "timestamp", (F.round("score", 6) + F.lit(0.0)).alias("score"), (F.col("score") < 0).alias("anomaly"))


@query("autoencoder_score_fixed", f"{FIXED} SELECT username, timestamp, round(mse, 6) + 0.0 AS mse, c AS anomaly FROM m")
def _(spark, d):
    models = fixed.models()
    out = autoencoder.score(scaler.transform(scored(spark, d), models.scaler), models.autoencoder)
    return out.select("username", "timestamp", (F.round("mse", 6) + F.lit(0.0)).alias("mse"), (F.col("mse") > models.autoencoder.threshold).alias("anomaly"))


@query("detection_thresholds", f"{FIXED} SELECT round(avg(mse) + 3 * stddev_pop(mse), 6) AS ae_threshold, round(quantile_cont(raw, 0.05), 6) AS if_offset FROM m")
def _(spark, d):
    """Where the fits would cut: mean and three deviations of the errors, and the contamination quantile of the scores."""
    models = fixed.models()
    scaled = scaler.transform(scored(spark, d), models.scaler)
    rows = autoencoder.score(iforest.score(scaled, models.iforest, raw=True), models.autoencoder)
    rows = storage.written(rows.select("score", "mse"), "scores")
    offset = quantiles.exact(rows, {"score": (CONFIG.detection.contamination,)})["score", CONFIG.detection.contamination]
    limit = autoencoder.threshold(rows, CONFIG.detection.ae_threshold_sigma)
    return spark.createDataFrame([(limit, offset)], "a double, b double").select(F.round("a", 6).alias("ae_threshold"), F.round("b", 6).alias("if_offset"))


@query("model_predictions_fixed", f"""{FIXED} SELECT username, timestamp, CASE WHEN a THEN -1 ELSE 1 END AS if_pred, CASE WHEN b THEN -1 ELSE 1 END AS svm_pred, CASE WHEN c THEN -1 ELSE 1 END AS ae_pred,
round(round_even(forest, 4), 4) + 0.0 AS if_score, round(round_even(svm, 4), 4) + 0.0 AS svm_score, round(round_even(mse, 6), 6) + 0.0 AS ae_error, votes, votes >= 2 AS is_anomaly, round_even(votes / 3.0, 2) AS confidence FROM v""")
def _(spark, d):
    flat = ensemble.flat(fixed_prediction(spark, d))
    tidy = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return flat.select("username", "timestamp", "if_pred", "svm_pred", "ae_pred", tidy("if_score", 4), tidy("svm_score", 4), tidy("ae_error", 6), "votes", "is_anomaly", "confidence")


ALERTS_SQL = f"""{FIXED} SELECT '2024-01-01T00:00:00.000000Z' AS timestamp, 'ueba_anomaly' AS type, username, timestamp AS session_ts, votes, round_even(votes / 3.0, 2) AS confidence,
CASE WHEN votes = 3 OR nb_sensitive_files > 0 OR nb_failed_logins >= 5 OR is_night <> 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, b AS svm_anomaly, is_weekend = 1 AS is_weekend, nb_sensitive_files, process_name, bytes_sent FROM v WHERE votes >= 2"""
ALERT_COLUMNS = ("timestamp", "type", "username", "session_ts", "votes", "confidence", "severity", "models.one_class_svm.anomaly", "indicators.is_weekend", "indicators.nb_sensitive_files", "indicators.process_name", "indicators.bytes_sent")


def alert_columns(rows):
    return rows.select(*[F.col(c).alias("svm_anomaly" if c.endswith("anomaly") else c.rpartition(".")[2]) for c in ALERT_COLUMNS])


@query("ensemble_alerts_fixed", ALERTS_SQL)
def _(spark, d):
    return alert_columns(alerts.shaped(fixed_prediction(spark, d), stamp()))


@query("alert_sink", ALERTS_SQL)
def _(spark, d):
    """Alerts appended as JSON lines by a batch that is written twice, read back."""
    rows, path = alerts.shaped(fixed_prediction(spark, d), stamp()), storage.fresh(spark, "alerts")
    for _ in range(2):
        alerts.write(rows, path, 0)
    return alert_columns(spark.read.schema(rows.schema).json(path)).withColumn("votes", F.col("votes").cast("int"))


@query("bundle_round_trip", f"{FIXED} SELECT username, timestamp, votes, a, b, c FROM v")
def _(spark, d):
    """Models saved, loaded and applied by the row, all absent ones aside."""
    folder = storage.fresh(spark, "bundle")
    bundle.save(spark, fixed.models(), folder)
    out = ensemble.predict(scored(spark, d), bundle.load(spark, folder))
    return out.select("username", "timestamp", "votes", *[F.col(m)["anomaly"].alias(n) for m, n in zip(alerts.MODELS, "abc", strict=True)])


@query("bundle_inventory", "SELECT * FROM (VALUES ('autoencoder', true), ('history', true), ('iforest', true), ('meta', true), ('ocsvm', false), ('scaler', true)) t(part, present)")
def _(spark, d):
    folder, models = storage.fresh(spark, "bundle"), fixed.models()
    models.ocsvm = None
    bundle.save(spark, models, folder)
    return bundle.inventory(spark, folder).select("part", "present")


@query("score_ranges", f"""{FIXED} SELECT 'if_score' AS name, round(avg(round_even(forest, 4)), 6) AS mean, round(min(round_even(forest, 4)), 6) AS min, round(max(round_even(forest, 4)), 6) AS max FROM m
UNION ALL SELECT 'svm_score', round(avg(round_even(svm, 4)), 6), round(min(round_even(svm, 4)), 6), round(max(round_even(svm, 4)), 6) FROM m
UNION ALL SELECT 'ae_error', round(avg(round_even(mse, 6)), 6), round(min(round_even(mse, 6)), 6), round(max(round_even(mse, 6)), 6) FROM m""")
def _(spark, d):
    return train.ranges(fixed_prediction(spark, d)).select("name", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


def scaler_check_sql() -> str:
    one = lambda c: f"SELECT '{c}' AS feature, round(avg(x), 4) + 0.0 AS mean, round(stddev_pop(x), 4) + 0.0 AS deviation, 0.0 AS scaled_mean, CASE WHEN max(x) = min(x) THEN 0.0 ELSE 1.0 END AS scaled_deviation FROM (SELECT CAST(CAST({c} AS FLOAT) AS DOUBLE) AS x FROM g)"
    return f"WITH {oracle.scored(LONG)} {' UNION ALL '.join(map(one, FEATURES))}"


@query("scaler_check", scaler_check_sql())
def _(spark, d):
    """Mean and deviation of each feature before and after scaling."""
    return scaler.check(storage.written(scored(spark, d), "features"), digits=4)


@query("scenario_verdicts", f"WITH g AS (SELECT * FROM (VALUES {', '.join('(' + repr(k) + ', ' + ', '.join(repr(float(v[c])) for c in FEATURES) + ')' for k, v in ensemble.SCENARIOS.items())}) t(scenario, {', '.join(FEATURES)})){fixed.scores_sql()} SELECT scenario, votes, votes >= 2 AS is_anomaly, a, b, c FROM v")
def _(spark, d):
    """Each scenario explained on its own."""
    models = fixed.models()
    said = {k: ensemble.explain(spark, models, v) for k, v in ensemble.SCENARIOS.items()}
    return spark.createDataFrame([(k, r["votes"], r["is_anomaly"], *[r[m]["anomaly"] for m in alerts.MODELS]) for k, r in said.items()], "scenario string, votes int, is_anomaly boolean, a boolean, b boolean, c boolean")


@query("model_vectors", f"WITH {oracle.scored(LONG)} SELECT username, timestamp, {', '.join(f'CAST({c} AS FLOAT) AS {c}' if c != 'velocity' else '0::FLOAT AS velocity' for c in FEATURES)} FROM g")
def _(spark, d):
    """The models' input where a feature is absent: it counts as 0."""
    rows = tables.vector(scored(spark, d).drop("velocity"))
    return rows.select("username", "timestamp", *[F.col("vector")[i].alias(c) for i, c in enumerate(FEATURES)])


@query("session_preview", f"WITH {oracle.sessions(LONG)} SELECT username, timestamp, nb_files_accessed, bytes_sent FROM f ORDER BY start_ts, username LIMIT 5")
def _(spark, d):
    return explore.head(features(spark, d), "start_ts", "username").select("username", "timestamp", "nb_files_accessed", "bytes_sent")


@query("users_by_first_session", f"WITH {oracle.sessions(LONG)} SELECT username, count(*) AS sessions, epoch_us(min(start_ts)) AS first_us FROM f GROUP BY username")
def _(spark, d):
    return explore.users(features(spark, d)).select("username", "sessions", F.unix_micros("first_ts").alias("first_us"))


@query("recent_history", f"""WITH {oracle.sessions(LONG)}, q AS (SELECT *, row_number() OVER (ORDER BY username, start_ts) - 1 AS seq FROM f)
SELECT seq, username, nb_files_accessed, nb_failed_logins FROM q ORDER BY seq DESC LIMIT 500""")
def _(spark, d):
    """What the detector remembers after two batches that hold all sessions."""
    rows = storage.written(with_sequence(features(spark, d), "username", "start_ts"), "sessions")
    folder, size, cut = storage.fresh(spark, "history"), CONFIG.daemon.history_size, rows.count() // 2
    for batch, part in enumerate((rows.filter(F.col("seq") < cut), rows.filter(F.col("seq") >= cut))):
        detector.remember(detector.recent(spark, folder, batch, size), part, folder, batch, size)
    return detector.recent(spark, folder, 2, size)


@query("anomalous_files", f"WITH {oracle.voted(LONG)} SELECT username, timestamp, nb_files_accessed FROM w WHERE a AND nb_files_accessed IS NOT NULL")
def _(spark, d):
    """Rows of one sign of a model's prediction, nulls left out."""
    rows = voted(spark, d).filter(F.col("isolation_forest.anomaly") & F.col("nb_files_accessed").isNotNull())
    return rows.select("username", "timestamp", "nb_files_accessed")


def as_array(frames):
    """Lines of a JSON array over the values of a partition."""
    import pandas as pd

    yield pd.DataFrame({"value": ["["]})
    before = ""
    for frame in frames:
        values = frame["value"].tolist()
        yield pd.DataFrame({"value": [(before if k == 0 else ",") + v for k, v in enumerate(values)]})
        before = "," if values else before
    yield pd.DataFrame({"value": ["]"]})


@query("alert_array", f"WITH {oracle.RAW} SELECT _seq, username, event_id, bytes_sent FROM raw")
def _(spark, d):
    """Events written as JSON arrays over many lines, one a file, read and flattened again."""
    alert = F.struct(F.col("ts_text").alias("timestamp"), F.struct(F.col("_seq").alias("id")).alias("rule"), F.struct(F.col("event_id").cast("int").alias("id"), F.concat(F.lit(" "), F.upper("username")).alias("srcuser"), "bytes_sent").alias("data"))
    path = storage.fresh(spark, "arrays")
    events(spark, d).select(F.to_json(alert).alias("value")).mapInPandas(as_array, "value string").write.text(path)
    found = alert_source.raw_events(alert_source.load(spark, path))
    return found.select(F.col("rule_id").cast("bigint").alias("_seq"), "username", "event_id", "bytes_sent")


@query("rejected_lines", "SELECT * FROM (VALUES (1, 'not JSON'), (2, 'neither an object nor an array'), (3, 'no valid timestamp'), (4, 'no valid timestamp'), (6, 'no valid timestamp')) t(_seq, reason)")
def _(spark, d):
    """Lines that give no event, with the reason."""
    values = ['{"timestamp": "2024-01-15T10:00:00Z"}', "{broken", "12", '{"timestamp": "soon"}', "{}", '[{}, {"@timestamp": "2024-01-15 10:00:00"}]', "[]"]
    lines = spark.createDataFrame(list(enumerate(values)), "_seq bigint, value string")
    return alert_source.rejected(lines, alert_source.raw_events(alert_source.parse(lines))).select(F.col("_seq").cast("int").alias("_seq"), "reason")


STREAM_COLUMNS = ("timestamp", "username", "hour", "is_night", "is_weekend", "nb_files_accessed", "nb_sensitive_files", "nb_failed_logins", "nb_processes", "bytes_sent", "new_ip", "sensitive_path_access", "process_name", "command_line", "velocity", "entropy_commands", "session_duration_min")


@query("stream_sessions", f"WITH {oracle.sessions(LONG)} SELECT {', '.join(STREAM_COLUMNS)} FROM f")
def _(spark, d):
    """The stateful plan over the events as a stream, closed by one event of another user far in the future."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    folder = storage.fresh(spark, "stream")
    end = spark.createDataFrame([(None, None, None, "end", None, None)], schema).withColumn("ts", F.lit("2100-01-01").cast("timestamp_ntz"))
    end.select(*schema.names).write.parquet(f"{folder}/end")
    read = lambda p, **o: spark.readStream.schema(schema).options(**o).parquet(p)
    flow = read(d, pathGlobFilter="events.parquet") if not _is_folder(spark, f"{d}/events.parquet") else read(f"{d}/events.parquet")
    both = raw_events(flow.unionByName(read(f"{folder}/end"))).withColumn("username", F.coalesce("username", F.lit("\x00end")))
    sink = native.sessions(both, CONFIG, LONG).select(*STREAM_COLUMNS).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _is_folder(spark, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()
