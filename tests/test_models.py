import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Config
from tidewatch.ml import autoencoder, bundle, ensemble, iforest, ocsvm, scaler
from tidewatch.operators import alerts, baseline, evaluate
from tidewatch.plans import catalog
from tidewatch.schema import FEATURES
from tidewatch.sources import simulate, tables


@pytest.fixture(scope="module")
def train(spark):
    return baseline.user_zscores(simulate.training_set(spark)).persist()


@pytest.fixture(scope="module")
def models(train):
    return bundle.fit(train, Config(), trees=100, epochs=30)


def test_scaler_keeps_constant_columns(spark):
    s = scaler.fit(spark.createDataFrame([(1, 5.0), (3, 5.0), (None, 5.0)], "hour int, velocity double"))
    at = {c: (m, d) for c, m, d in zip(FEATURES, s.mean, s.scale, strict=True)}
    assert at["velocity"] == (5.0, 1.0) and at["hour"] == pytest.approx((4 / 3, np.std([1, 3, 0])))


def test_training_rates(train, models):
    row = bundle.score(train, models).agg(*[F.avg(F.col(m)["anomaly"].cast("int")).alias(m) for m in alerts.MODELS]).first()
    assert row["isolation_forest"] == pytest.approx(0.05, abs=0.01)
    assert row["one_class_svm"] == pytest.approx(0.05, abs=0.04)
    assert row["autoencoder"] <= 0.03


def test_attacks_are_found(spark, models):
    data = baseline.user_zscores(simulate.test_set(spark))
    r = evaluate.rates(ensemble.predict(data, models)).first()
    assert r["recall"] >= 0.9 and r["fpr"] <= 0.3
    said = {k: ensemble.explain(spark, models, s)["is_anomaly"] for k, s in ensemble.SCENARIOS.items()}
    assert said == {"normal": False, "insider": True, "malware": True, "brute_force": True}


def test_bundle_round_trip(spark, train, models, tmp_path):
    folder = str(tmp_path / "models")
    bundle.save(spark, models, folder)
    back = bundle.load(spark, folder)
    assert back.ready and all(r["present"] and r["bytes"] > 0 for r in bundle.inventory(spark, folder).collect())
    few = train.limit(5)
    a, b = (sorted(map(repr, bundle.score(few, m).collect())) for m in (models, back))
    assert a == b
    assert not bundle.load(spark, str(tmp_path / "none")).ready


def test_absent_models(spark, train, models):
    only = bundle.Bundle(models.scaler, iforest=models.iforest)
    rows = ensemble.predict(train.limit(3), only).collect()
    assert all(r["autoencoder"] is None and not r["is_anomaly"] and r["confidence"] in (0.0, 1.0) for r in rows)


def test_solver_is_optimal():
    x = np.random.default_rng(0).normal(size=(300, 3))
    m = ocsvm.solve(x, nu=0.1)
    assert m.alpha.sum() == pytest.approx(30) and (m.decision(x) < -1e-3).mean() <= 0.1 + 1e-9
    assert len(m.alpha) >= 30


def test_average_path():
    assert iforest.average_path([0, 1, 2]).tolist() == [0, 0, 1]
    assert float(iforest.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_gradients():
    rng = np.random.default_rng(1)
    m = autoencoder.Autoencoder.fresh(5, 2, rng)
    x = rng.normal(size=(8, 5))

    def loss():
        out, _ = m.forward(x, np.random.default_rng(3))
        return ((out - x) ** 2).mean() + m.penalty()

    g = m.gradients(x, np.random.default_rng(3))
    for name in ("enc_1.kernel", "enc_2.gamma", "dec_2.beta", "output.bias", "latent.kernel"):
        w, at = m.weights[name], tuple(0 for _ in m.weights[name].shape)
        was = w[at]
        w[at] = was + 1e-5
        up = loss()
        w[at] = was - 1e-5
        down = loss()
        w[at] = was
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_severity_and_confidence(spark):
    rows = [(3, 0, 0, 0, "HIGH"), (2, 1, 0, 0, "HIGH"), (2, 0, 5, 0, "HIGH"), (2, 0, 0, 1, "HIGH"), (2, 0, 4, 0, "MEDIUM"), (1, 9, 9, 1, "LOW"), (0, 0, 0, 0, "LOW")]
    df = spark.createDataFrame(rows, "votes int, nb_sensitive_files int, nb_failed_logins int, is_night int, want string")
    assert all(r[0] == r[1] for r in df.select(alerts.severity(), "want").collect())


def test_csv_round_trip(spark, train, tmp_path):
    data = baseline.dataset(train)
    tables.write_csv(data, str(tmp_path / "d"), single=True)
    back = tables.read_csv(spark, str(tmp_path / "d"))
    assert data.exceptAll(back.select(*data.columns)).isEmpty() and {r["label"] for r in back.select("label").distinct().collect()} == {0}
    data.drop("hour").write.option("header", True).csv(str(tmp_path / "e"))
    with pytest.raises(ValueError, match="hour"):
        tables.read_csv(spark, str(tmp_path / "e"))


@pytest.mark.parametrize("name,size", [("autoencoder_score", "sf0.01"), ("ensemble_alerts", "sf0.001")])
def test_queries_train_in_full(spark, monkeypatch, name, size):
    seen, real = [], autoencoder.train

    def train(x, *args, **options):
        seen.append((len(x), options.get("epochs", 200)))
        return real(x, *args, **options | {"epochs": 1})

    monkeypatch.setattr(autoencoder, "train", train)
    sessions = catalog.scored(spark, f"/root/testdata/{size}").count()
    catalog.QUERIES[name](spark, f"/root/testdata/{size}")
    assert seen == [(sessions, 200)] and (size != "sf0.01" or sessions > 2000)


def test_exact_quantiles(spark, monkeypatch):
    from tidewatch.operators import quantiles

    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=500), "b": rng.integers(0, 3, 500).astype(float), "c": np.full(500, 2.5), "d": np.where(rng.random(500) < 0.5, np.nan, rng.random(500)), "e": np.full(500, np.nan)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values(), strict=True)], ", ".join(f"{k} double" for k in data))
    shares = (0.0, 0.05, 0.25, 0.5, 0.75, 1.0)
    for bins in (quantiles.BINS, 3):
        got = quantiles.exact(df, dict.fromkeys(data, shares), bins)
        for c, x in data.items():
            x = x[~np.isnan(x)]
            assert [got[c, q] for q in shares] == ([None] * len(shares) if not len(x) else pytest.approx(np.quantile(x, shares), abs=1e-12))


def test_correlation_with_nulls(spark):
    from tidewatch.operators import explore

    rows = [(1.0, 2.0, None, 5.0), (2.0, 1.0, 3.0, 5.0), (3.0, 5.0, 1.0, 5.0), (4.0, 3.0, 2.0, 5.0)]
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in explore.correlation(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    want = lambda i, j: float(np.corrcoef(*np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]).T)[0, 1])
    assert got["a", "b"] == pytest.approx(want(0, 1), abs=1e-6) and got["a", "c"] == pytest.approx(want(0, 2), abs=1e-6) and got["b", "c"] == pytest.approx(want(1, 2), abs=1e-6)
    assert got["a", "d"] is got["c", "d"] is None


def test_train_program(spark, tmp_path, monkeypatch):
    from tidewatch.plans import train

    monkeypatch.setattr(spark, "stop", lambda: None)
    log, folder = tmp_path / "train.log", str(tmp_path / "models")
    assert train.main(["--simulate", "60", "--models", folder, "--epochs", "2", "--trees", "20", "--evaluate", "--log-file", str(log)]) == 0
    assert bundle.load(spark, folder).ready
    said = log.read_text()
    assert "autoencoder: 2 epochs" in said and "if_score: mean" in said and "attack: precision" in said
    data = baseline.dataset(baseline.user_zscores(simulate.normal(spark, 40)))
    tables.write_csv(data, str(tmp_path / "data"))
    assert train.data_set(spark, str(tmp_path / "data")).count() == 40
    with pytest.raises(ValueError, match="velocity"):
        data.drop("velocity").write.parquet(str(tmp_path / "less"))
        train.data_set(spark, str(tmp_path / "less"), "parquet")
