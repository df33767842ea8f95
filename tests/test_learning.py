from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.operators import features, objective, training, vectors
from quarry.sources.instances import SCHEMA, parse_text

X = [0, 1, 1, -1, -1, 0, 0, 1, -1]
GA = [0, 3, -3, 3, -3, 3, -3, 0, 0]
XB = [0, 1, 1, -1, -1, 1, -1, 0, 0]
GB = [0, 3, -3, 3, -3, 0, 0, 3, -3]
arr = lambda v: np.array(v, float)


def test_sign_cases():
    assert training.steepest(arr(X), arr(GA), 2).tolist() == [0, -5, 1, -1, 5, -1, 1, -2, 2]
    assert training.steepest(arr(XB), arr(GB), 2).tolist() == [0, -5, 1, -1, 5, -2, 2, -1, 1]
    assert training.directional(arr(X), arr(GA), arr(GA), 2) == 66 == training.directional(arr(XB), arr(GB), arr(GB), 2)
    assert training.next_point(arr(XB), arr(GB), 0.5, 2).tolist() == [0, 2.5, 0, 0, -2.5, 1, -1, 1.5, -1.5]
    assert training.fix_signs(arr(GB), arr(XB), 2).tolist() == [0, 3, 0, 0, -3, 0, 0, 0, 0]


def test_columns_equal_arrays(spark):
    rows = spark.createDataFrame(list(zip(range(9), map(float, XB), map(float, GB))), "id int, x double, g double")
    got = rows.select("id", objective.steepest(F.col("x"), F.col("g"), 2.0).alias("s"), objective.next_point(F.col("x"), F.col("g"), 0.5, 2.0).alias("n"), objective.fix_signs(F.col("g"), F.col("x"), 2.0).alias("f")).orderBy("id").toPandas()
    assert (got["s"].to_numpy() == training.steepest(arr(XB), arr(GB), 2)).all()
    assert (got["n"].to_numpy() == training.next_point(arr(XB), arr(GB), 0.5, 2)).all()
    assert (got["f"].to_numpy() == training.fix_signs(arr(GB), arr(XB), 2)).all()
    assert rows.agg(F.sum(objective.derivative_term(F.col("x"), F.col("g"), F.col("g"), 2.0))).first()[0] == 66


def test_improvement():
    seen = training.Improvement()
    got = [seen.add(1000.0 / (k + 1)) for k in range(12)]
    values = [1000.0 / (k + 1) for k in range(12)]
    assert got[:6] == [math.inf] * 6
    assert got[6] == pytest.approx((values[0] - values[6]) / 6 / values[6])
    assert got[10] == pytest.approx((values[0] - values[10]) / 9 / values[10])
    assert got[11] == pytest.approx((values[1] - values[11]) / 9 / values[11])


def tiny(spark):
    return parse_text(spark.createDataFrame([("10 10   2 1 5 0",), ("0  10   2 0 5 1",)], "value string"))


def test_training(spark):
    model = training.train(tiny(spark), training.Options(l1=0.1))
    assert model.values[0] == pytest.approx(14.862943611, rel=1e-9) and model.values[-1] == pytest.approx(2.12003, rel=1e-4)
    assert dict(zip(model.ids.tolist(), model.weights.round(2).tolist())) == {2: 4.6, 5: -4.6}
    assert training.train(tiny(spark), training.Options(l1=1.0)).values[-1] == pytest.approx(7.50166, rel=1e-4)


def test_flat_problem_ends(spark):
    model = training.train(tiny(spark), training.Options(binary=True, duplicates="sum"))
    assert model.reason == training.CONVERGED and not model.weights.any()


@pytest.fixture(scope="module")
def random_instances(spark):
    rng = np.random.default_rng(3)
    truth = rng.normal(size=30)
    rows = []
    for _ in range(300):
        ids = rng.choice(30, 5, replace=False)
        vals = rng.normal(size=5)
        app = int(rng.integers(1, 20))
        pos = int(rng.binomial(app, 1 / (1 + np.exp(-(truth[ids] * vals).sum()))))
        rows.append((float(pos), float(app), [(None, int(i), float(v)) for i, v in zip(ids, vals)]))
    return spark.createDataFrame(rows, SCHEMA).withColumn("row", F.monotonically_increasing_id())


def test_gradient_two_ways(spark, random_instances):
    ids = np.arange(30)
    x = np.where(ids % 3 == 0, 0.5, -0.25)
    loss, grad = training.evaluator(training.prepare(random_instances, training.Options()), ids)(x)
    weights = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, x)], "id int, value double")
    rows = objective.with_loss(objective.scored(random_instances, weights))
    by_sql = {r["id"]: r["g"] for r in objective.gradient(rows).collect()}
    assert objective.objective(rows, weights, 2.0).first()[0] == pytest.approx(1 + loss + 2 * np.abs(x).sum())
    assert grad == pytest.approx(np.array([by_sql[i] for i in ids]))


def test_optimum_against_another_method(spark, random_instances):
    """Proximal gradient steps on the same objective reach no better value."""
    l1 = 3.0
    model = training.train(random_instances, training.Options(l1=l1, tolerance=1e-7))
    evaluate = training.evaluator(training.prepare(random_instances, training.Options()).persist(), model.ids)
    x, pace = model.weights.copy(), 1e-3
    for _ in range(30):
        _, g = evaluate(x)
        x = x - pace * g
        x = np.sign(x) * np.maximum(np.abs(x) - pace * l1, 0)
    loss, _ = evaluate(x)
    assert model.values[-1] <= 1 + loss + l1 * np.abs(x).sum() + 0.02
    assert (np.diff(model.values) < 0).all()


def test_resume(spark, random_instances, tmp_path):
    options = training.Options(l1=1.0)
    whole = training.train(random_instances, options)
    path = str(tmp_path / "state")
    part = training.train(random_instances, training.Options(l1=1.0, max_iterations=3), path)
    assert part.reason == training.ENOUGH_STEPS
    learner, ids, _, number = training.load_state(spark, path)
    assert number == part.evaluations and (ids == whole.ids).all() and learner.iteration == 4
    assert training.load_state(spark, str(tmp_path / "none")) is None
    assert training.dump_state(spark, path, model_only=True).count() > 0


def test_states_in_fragments(spark, random_instances, tmp_path):
    """Vectors are kept in fragments, and a state that lacks one gives way to the one before."""
    path, n = str(tmp_path / "state"), 7
    ids = np.arange(3, 3 + n)
    for number in (1, 2):
        learner = training.Learner(training.Options(), np.arange(n) * 0.5 * number)
        learner.tell(5.0, np.linspace(-9.0, 9.0, n))
        training.save_state(spark, path, number, learner, ids, [5.0], fragment=3)
    whole = training.dump_state(spark, path)
    assert sorted(r["part"] for r in whole.where("name = 'ids'").collect()) == [0, 1, 2]
    back, found, values, number = training.load_state(spark, path)
    assert number == 2 and values == [5.0] and found.tolist() == ids.tolist()
    for name in ("x", "new_x", "grad", "direction"):
        assert getattr(back, name) == pytest.approx(getattr(learner, name))
    model = {r["id"]: r["value"] for r in training.dump_state(spark, path, model_only=True).collect()}
    assert model == pytest.approx({int(i): v for i, v in zip(ids, learner.new_x) if v})
    torn = str(tmp_path / "torn")
    spark.read.parquet(path).where("not (number = 2 and name = 'x' and part = 1)").write.parquet(torn)
    assert training.load_state(spark, torn)[3] == 1
    assert training.dump_state(spark, str(tmp_path / "none"), model_only=True).count() == 0


def test_predict_and_mixture(spark, random_instances):
    mean = training.mixture(random_instances, 1, training.Options(l1=1.0))
    model = training.train(random_instances, training.Options(l1=1.0))
    got = {r["id"]: r["value"] for r in mean.collect()}
    want = {int(i): w for i, w in zip(model.ids, model.weights) if w}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-3) for i in got)
    found = objective.predict(random_instances, model.rows(spark)).collect()
    assert all(0 < r["probability"] < 1 for r in found)
    assert training.mixture(random_instances, 4).count() > 0


def test_options():
    with pytest.raises(ValueError):
        training.Options(memory=0)
    with pytest.raises(ValueError):
        training.Options(l1=-1)


def test_single_features(spark):
    rows = spark.createDataFrame([([(None, 1, 2.0), (None, 1, 3.0), (None, 2, 4.0), (None, 2, 0.0)],)], "f array<struct<name:string,id:int,value:double>>")
    last, total = rows.select(objective.single(F.col("f")), objective.single(F.col("f"), "sum")).first()
    assert [tuple(x) for x in last] == [(1, 3.0)] and [tuple(x) for x in total] == [(1, 5.0), (2, 4.0)]


def test_dictionary_and_conversion(spark):
    rows = spark.createDataFrame([(1.0, 2.0, [("b", None, 1.0), ("a", None, 2.0)]), (0.0, 1.0, [("c", None, 1.0)]), (0.0, 1.0, []), (0.0, 1.0, [("z", None, 1.0), ("a", None, 1.0)])], SCHEMA)
    names = features.dictionary(features.feature_names(rows.where("num_positive >= 0"))).where("name <> 'z'")
    assert {r["name"]: r["id"] for r in names.collect()} == {"a": 1, "b": 2, "c": 3}
    for size in (None, 1 << 40):
        got = sorted([(x["id"], x["value"]) for x in r["features"]] for r in features.convert(rows, names, size).collect())
        assert got == [[], [(2, 1.0), (1, 2.0)], [(3, 1.0)]]


def sparse(spark, entries):
    return spark.createDataFrame([(int(k), float(v)) for k, v in entries.items()], "id int, value double")


def as_dict(df):
    return {r["id"]: r["value"] for r in df.collect()}


def test_sparse_vectors(spark):
    u, v = {101: 2, 102: 4, 301: 10}, {101: 2, 103: 6, 301: 4, 302: 200}
    assert as_dict(vectors.scale(sparse(spark, {101: 2, 102: 4}), 0.5)) == {101: 1, 102: 2}
    assert as_dict(vectors.add_scaled(sparse(spark, u), sparse(spark, v), 0.5)) == {101: 3, 102: 4, 103: 3, 301: 12, 302: 100}
    assert as_dict(vectors.add_scaled(sparse(spark, u), sparse(spark, u), -1)) == {}
    assert vectors.dot(sparse(spark, u), sparse(spark, v)).first()[0] == 44
    assert vectors.dot(sparse(spark, {1: 1}), sparse(spark, {2: 1})).first()[0] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-8, 8), min_size=4, max_size=4), st.lists(st.integers(-8, 8), min_size=4, max_size=4))
def test_sparse_equals_dense(spark, a, b):
    u, v = (sparse(spark, {i: x for i, x in enumerate(w) if x}) for w in (a, b))
    dense = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<double>, b array<double>")
    dot, added = dense.select(vectors.array_dot(F.col("a"), F.col("b")), vectors.array_add_scaled(F.col("a"), F.col("b"), 0.5)).first()
    assert vectors.dot(u, v).first()[0] == dot
    assert as_dict(vectors.add_scaled(u, v, 0.5)) == {i: x for i, x in enumerate(added) if x}


def test_vector_arrays_and_text(spark):
    row = spark.createDataFrame([([(1, 10.0), (3, 30.0)], [10.0, 0.0, 30.0])], "s array<struct<id:int,value:double>>, d array<double>")
    got = row.select(
        vectors.hybrid_dot(F.col("s"), F.col("d")), vectors.at(F.col("s"), F.lit(3)), vectors.at(F.col("s"), F.lit(2)), vectors.has(F.col("s"), F.lit(1)),
        vectors.to_text(F.col("s")), vectors.to_text(vectors.put(F.col("s"), F.lit(2), F.lit(5.0))), vectors.to_text(vectors.put(F.col("s"), F.lit(1), F.lit(0.0))),
    ).first()
    assert list(got) == [0.0, 30.0, 0.0, True, "[ 1:10.0 3:30.0 ]", "[ 1:10.0 2:5.0 3:30.0 ]", "[ 3:30.0 ]"]
    back = spark.range(1).select(vectors.from_text(F.lit("[ 1:10.0 3:-0.5 ]"))).first()[0]
    assert [tuple(x) for x in back] == [(1, 10.0), (3, -0.5)]
    assert spark.range(1).select(vectors.to_text(F.array().cast("array<struct<id:int,value:double>>"))).first()[0] == "[ ]"


def test_command_line(spark, tmp_path):
    from quarry import train

    (tmp_path / "in").write_text("10 10   2 1 5 0\n0  10   2 0 5 1\n")
    model = train.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "model"), "--l1", "0.1"])
    line = spark.read.text(str(tmp_path / "model")).first()["value"]
    back = {x["id"]: x["value"] for x in spark.range(1).select(vectors.from_text(F.lit(line)).alias("v")).first()["v"]}
    assert back == dict(zip(model.ids.tolist(), model.weights.tolist()))


def test_more_iterations_of_a_saved_run(spark, random_instances, tmp_path):
    """A run that had enough iterations goes on as if it had not stopped."""
    path = str(tmp_path / "state")
    training.train(random_instances, training.Options(l1=0.5, max_iterations=3), path)
    later = training.train(random_instances, training.Options(l1=0.5, max_iterations=7), path)
    whole = training.train(random_instances, training.Options(l1=0.5, max_iterations=7))
    assert later.iterations == whole.iterations and later.weights == pytest.approx(whole.weights, rel=1e-6, abs=1e-9)


def test_features_of_one_id_in_near_linear_time(spark):
    import time

    took = []
    for n in (200, 4000):
        rows = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((k % (n // 2)).cast("int").alias("id"), k.cast("double").alias("value"))).alias("f"))
        for how in ("last", "sum"):
            began = time.time()
            got = rows.select(F.size(objective.single(F.col("f"), how)).alias("n")).distinct().collect()
            took.append(time.time() - began)
            assert [r["n"] for r in got] == [n // 2]
    assert max(took[2:]) < 5


def test_conversion_of_odd_features(spark):
    schema = "row int, features array<struct<name:string,id:int,value:double>>, more string"
    rows = [(1, [("a", None, 1.0), ("b", None, 2.0)], "x"), (2, [("a", None, 1.0), ("c", None, 2.0)], None), (3, [], "y"), (4, None, "z"), (5, [(None, None, 1.0)], "n"), (6, [("b", None, 5.0)] * 3, "m")]
    names = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int")
    for size in (None, 1 << 40):
        got = {r["row"]: ([(f["id"], f["value"]) for f in r["features"] or []], r["more"]) for r in features.convert(spark.createDataFrame(rows, schema), names, size).collect()}
        assert got == {1: ([(1, 1.0), (2, 2.0)], "x"), 3: ([], "y"), 4: ([], "z"), 6: ([(2, 5.0)] * 3, "m")}
