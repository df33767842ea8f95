"""Dictionaries, conversion, vectors, objective, training and prediction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.operators import features, objective, training, vectors
from quarry.plans.job import Job
from quarry.queries.common import ORDER_SQL, order_instances, read
from quarry.session import shared_folder
from quarry.sources import instances as instance_source

L1 = 0.5


def feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dictionary(features.feature_names(order_instances(spark, sf_dir)))


def _withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_dictionary(spark, sf_dir).where(F.col("name") != "prio:5-LOW")


def convert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One priority is missing from the dictionary, so its orders go."""
    found = features.convert(order_instances(spark, sf_dir), _withheld(spark, sf_dir))
    return found.select("row", F.array_join(F.transform("features", lambda x: x["id"].cast("string")), ",").alias("ids"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.convert(order_instances(spark, sf_dir), feature_dictionary(spark, sf_dir))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of halves and quarters, by the feature's number."""
    w = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, -0.25).otherwise(0.0)
    return feature_dictionary(spark, sf_dir).select("id", w.alias("value")).where("value <> 0")


def _vector(spark: SparkSession, sf_dir: str, of: int) -> DataFrame:
    part = read(spark, sf_dir, "part").where(F.col("p_partkey") % of != 0)
    return part.select(F.col("p_partkey").cast("int").alias("id"), (F.col("p_size") * F.lit(0.5)).alias("value")).where("value <> 0")


def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dot(_vector(spark, sf_dir, 2), _vector(spark, sf_dir, 3))


def sparse_add_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.add_scaled(_vector(spark, sf_dir, 2), _vector(spark, sf_dir, 3), -1.0)


def sparse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.scale(_vector(spark, sf_dir, 2), 0.25)


def dense_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared length of every vector, as whole-number components so that sums are exact."""
    whole = F.transform("embedding", lambda x: F.floor(x * 64).cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.array_dot(whole, whole).alias("dot"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _numbered(spark, sf_dir).select(F.explode("features").alias("f"))
    return each.agg((F.max("f.id") + 1).cast("bigint").alias("dim"))


def _at(spark: SparkSession, sf_dir: str, weights: DataFrame) -> DataFrame:
    return objective.with_loss(objective.scored(objective.usable(_numbered(spark, sf_dir)), weights))


def objective_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _weights(spark, sf_dir).where("value = 99")
    return objective.objective(_at(spark, sf_dir, none), none, L1).select(F.round("value", 6).alias("value"))


def objective_at_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weights(spark, sf_dir)
    return objective.objective(_at(spark, sf_dir, w), w, L1).select(F.round("value", 6).alias("value"))


def gradient_at_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objective.gradient(_at(spark, sf_dir, _weights(spark, sf_dir)))
    return found.select("id", F.round("g", 6).alias("g"))


def _point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, and g with direction d: whole numbers of supplier keys with every pair of signs."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.cast("int").alias("id"), ((k % 3 - 1) * 1.0).alias("x"), ((k % 7 - 3) * 1.0).alias("g"), ((k % 5 - 2) * 1.0).alias("d"))


def steepest_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir).select("id", objective.steepest(F.col("x"), F.col("g"), 2.0).alias("d"))


def dir_deriv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir).agg(F.sum(objective.derivative_term(F.col("x"), F.col("g"), F.col("d"), 2.0)).alias("slope"))


def next_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir).select("id", objective.next_point(F.col("x"), F.col("d"), 0.5, 2.0).alias("x"))


def fix_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(spark, sf_dir).select("id", objective.fix_signs(F.col("d"), F.col("g"), 2.0).alias("d"))


def improvement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean relative improvement at every step of a falling sequence; infinite for the first six."""
    # one value a step, as an optimiser's run gives them
    steps = read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    seen = training.Improvement()
    return spark.createDataFrame([(r[0], round(seen.add(1000.0 / (r[0] + 1)), 9)) for r in steps], "step int, improvement double")


def hybrid_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse vector with entries past the end, with every dense one."""
    entry = lambda i, v: F.struct(F.lit(i).alias("id"), F.lit(v).alias("value"))
    sparse = F.array(entry(0, 1.0), entry(5, 2.0), entry(63, -0.5), entry(500, 9.0))
    whole = F.transform("embedding", lambda x: F.floor(x * 64).cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.hybrid_dot(sparse, whole).alias("dot"))


def vector_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element read, asked for and changed in sparse vectors of ten parts each."""
    rows = _vector(spark, sf_dir, 2).withColumn("k", F.floor((F.col("id") - 1) / 20).cast("int"))
    whole, asked = vectors.collect(rows, "k"), (F.col("k") * 20 + 3 + F.col("k") % 2).cast("int")
    put = vectors.put(F.col("vector"), asked, F.when(F.col("k") % 3 == 0, 0.0).otherwise(7.5))
    return whole.select("k", vectors.at(F.col("vector"), asked).alias("value"), vectors.has(F.col("vector"), asked).alias("there"), F.size(put).alias("n"), vectors.at(put, asked).alias("now"))


def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objective.predict(_numbered(spark, sf_dir), _weights(spark, sf_dir))
    return found.select("row", F.round("probability", 9).alias("probability"))


def train_l1_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = training.train(_numbered(spark, sf_dir), training.Options(l1=L1))
    return model.rows(spark)


def parameter_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mixture(_numbered(spark, sf_dir), 4, training.Options(l1=L1))


def model_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights printed as a model line and read again."""
    whole = vectors.collect(_weights(spark, sf_dir).withColumn("k", F.lit(0)), "k")
    line = whole.select(vectors.to_text(F.col("vector")).alias("line"))
    return line.select(F.explode(vectors.from_text(F.col("line"))).alias("e")).select("e.id", "e.value")


def recordio_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances written as binary messages in records, read by the data source and decoded again."""
    from quarry.sources import recordio

    rows = order_instances(spark, sf_dir)
    records = instance_source.encode(rows, F.col("row"))
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    recordio.write(records, path)
    back = instance_source.decode(recordio.read(spark, path))
    return back.groupBy("num_positive", "num_appearance").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).cast("bigint").alias("features"))


def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as sorted shards and read again with the place of each, counted through all shards."""
    from quarry.sources import shards

    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    names = read(spark, sf_dir, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    shards.write_text(names.select(F.col("c_name").alias("value")), path)
    lines = shards.read_text_with_places(spark, path).select(F.expr("left(key, length(key) - 11)").alias("file"), F.substring("key", -10, 10).cast("bigint").alias("at"), "value")
    sizes = lines.groupBy("file").agg(F.max(F.col("at") + F.octet_length("value") + 1).alias("size"))
    before = sizes.select(F.col("file").alias("of"), (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))  # a row a file
    return lines.join(F.broadcast(before), F.col("file") == F.col("of")).select((F.col("at") + F.col("before")).alias("place"), "value")


def message_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed form of instances as messages: how often each text of a feature name occurs in it."""
    from quarry.sources import messages

    definitions = """message Instance { message Feature { optional string name = 1; optional int32 id = 2; required double value = 3; }
        required float num_positive = 1; required float num_appearance = 2; repeated Feature feature = 3; }"""
    lines = messages.dump(instance_source.encode(order_instances(spark, sf_dir), F.col("row")), definitions, "Instance")
    names = F.regexp_extract_all("line", F.lit('name: "([^"]*)"'), F.lit(1))
    return lines.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the newest saved state of a training run that is stopped early and resumed."""
    path = training.new_state_path(shared_folder(spark))
    rows = _numbered(spark, sf_dir)
    for most in (2, 4):  # the second run goes on from the first one's state
        training.train(rows, training.Options(l1=L1, max_iterations=most), path)
    return training.dump_state(spark, path, model_only=True)


def text_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances printed as text lines and parsed again."""
    rows = _numbered(spark, sf_dir)
    pairs = F.array_join(F.transform("features", lambda x: F.concat_ws("\t", x["id"].cast("string"), x["value"].cast("string"))), "  ")
    lines = rows.select(F.concat_ws(" ", F.col("num_positive").cast("string"), F.col("num_appearance").cast("string"), pairs).alias("value"))
    parsed = instance_source.parse_text(lines)
    each = parsed.select("num_positive", F.explode("features").alias("f"))
    return each.groupBy(F.col("f.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("num_positive").cast("double")).alias("positive"))


def distinct_names_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct feature names by a job whose keys are the names."""
    pairs = features.feature_names(order_instances(spark, sf_dir)).select(F.col("name").alias("key"), F.lit("").alias("value"))
    return Job(pairs, reducer={"n": F.count(F.lit(1))}, shards=4).run().select(F.col("key").alias("name"), "n")


_DICT = f"WITH {ORDER_SQL}, dict AS (SELECT name, row_number() OVER (ORDER BY name)::INTEGER AS id FROM (SELECT DISTINCT name FROM feat))"
_W = f"{_DICT}, w AS (SELECT id, CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 END::DOUBLE AS value FROM dict WHERE id % 3 <> 2)"
_SCORED = """, s AS (SELECT row_id, any_value(num_positive)::DOUBLE AS p, any_value(num_appearance)::DOUBLE AS a, coalesce(sum(w.value), 0)::DOUBLE AS s
  FROM feat JOIN dict USING (name) LEFT JOIN w USING (id) WHERE num_positive >= 0 AND num_positive <= num_appearance GROUP BY row_id),
l AS (SELECT *, p * CASE WHEN s < -30 THEN -s WHEN s > 30 THEN 0 ELSE ln(1 + exp(-s)) END + (a - p) * CASE WHEN -s < -30 THEN s WHEN -s > 30 THEN 0 ELSE ln(1 + exp(s)) END AS loss,
  -p * (1 - 1 / (1 + exp(-s))) + (a - p) * (1 - 1 / (1 + exp(s))) AS slope FROM s)"""
_ZERO = _W.replace("WHERE id % 3 <> 2", "WHERE false")
_U = "SELECT p_partkey::INTEGER AS id, p_size * 0.5::DOUBLE AS value FROM part WHERE p_partkey % {} <> 0 AND p_size <> 0"
_XGD = "SELECT s_suppkey::INTEGER AS id, (s_suppkey % 3 - 1)::DOUBLE AS x, (s_suppkey % 7 - 3)::DOUBLE AS g, (s_suppkey % 5 - 2)::DOUBLE AS d FROM supplier"

QUERIES = {
    f.__name__: f
    for f in (
        feature_dictionary, convert_features, sparse_dot, sparse_add_scaled, sparse_scale, dense_dot, dimension, objective_at_zero,
        objective_at_w, gradient_at_w, steepest_dir, dir_deriv, next_point, fix_signs, improvement_filter, predict, train_l1_logreg,
        parameter_mixture, model_text_roundtrip, recordio_roundtrip, text_places, message_dump, saved_state, text_instances, distinct_names_job,
        hybrid_dot, vector_elements,
    )
}
ORACLES = {
    "feature_dictionary": f"{_DICT} SELECT name, id FROM dict",
    "convert_features": f"""{_DICT} SELECT row_id AS row, array_to_string([p.id, s.id, g.id], ',') AS ids FROM inst
        JOIN dict p ON p.name = 'prio:' || o_orderpriority JOIN dict s ON s.name = 'stat:' || o_orderstatus JOIN dict g ON g.name = 'seg:' || c_mktsegment WHERE o_orderpriority <> '5-LOW'""",
    "sparse_dot": f"SELECT sum(u.value * v.value) AS dot FROM ({_U.format(2)}) u JOIN ({_U.format(3)}) v USING (id)",
    "sparse_add_scaled": f"SELECT id, coalesce(u.value, 0) - coalesce(v.value, 0) AS value FROM ({_U.format(2)}) u FULL JOIN ({_U.format(3)}) v USING (id) WHERE coalesce(u.value, 0) <> coalesce(v.value, 0)",
    "sparse_scale": f"SELECT id, value * 0.25::DOUBLE AS value FROM ({_U.format(2)})",
    "dense_dot": "SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor(x::FLOAT * 64::FLOAT)::DOUBLE * floor(x::FLOAT * 64::FLOAT)::DOUBLE)) AS dot FROM embeddings",
    "hybrid_dot": "SELECT vec_id, floor(embedding[1]::FLOAT * 64::FLOAT)::DOUBLE + 2 * floor(embedding[6]::FLOAT * 64::FLOAT)::DOUBLE - 0.5 * floor(embedding[64]::FLOAT * 64::FLOAT)::DOUBLE AS dot FROM embeddings",
    "vector_elements": f"""WITH u AS (SELECT id, value, floor((id - 1) / 20.0)::INTEGER AS k FROM ({_U.format(2)})), g AS (SELECT k, count(*) AS n, (k * 20 + 3 + k % 2)::INTEGER AS a FROM u GROUP BY k)
        SELECT g.k, coalesce(u.value, 0) AS value, u.id IS NOT NULL AS there, (n - (u.id IS NOT NULL)::INTEGER + (g.k % 3 <> 0)::INTEGER)::INTEGER AS n, CASE WHEN g.k % 3 = 0 THEN 0 ELSE 7.5 END::DOUBLE AS now
        FROM g LEFT JOIN u ON u.id = g.a""",
    "dimension": f"{_DICT} SELECT max(id)::BIGINT + 1 AS dim FROM feat JOIN dict USING (name)",
    "objective_at_zero": f"{_ZERO}{_SCORED} SELECT round(1 + sum(loss), 6) AS value FROM l",
    "objective_at_w": f"{_W}{_SCORED} SELECT round(1 + sum(loss) + {L1} * (SELECT sum(abs(value)) FROM w), 6) AS value FROM l",
    "gradient_at_w": f"{_W}{_SCORED} SELECT id, round(sum(slope), 6) AS g FROM l JOIN feat USING (row_id) JOIN dict USING (name) GROUP BY id",
    "steepest_dir": f"SELECT id, CASE WHEN x < 0 THEN -g + 2 WHEN x > 0 THEN -g - 2 WHEN g < -2 THEN -g - 2 WHEN g > 2 THEN -g + 2 ELSE 0 END::DOUBLE AS d FROM ({_XGD})",
    "dir_deriv": f"SELECT sum(d * (g + 2 * CASE WHEN x <> 0 THEN sign(x) ELSE sign(d) END))::DOUBLE AS slope FROM ({_XGD})",
    "next_point": f"SELECT id, CASE WHEN x * (x + 0.5 * d) < 0 THEN 0 ELSE x + 0.5 * d END::DOUBLE AS x FROM ({_XGD})",
    "fix_signs": f"SELECT id, CASE WHEN d * g <= 0 THEN 0 ELSE d END::DOUBLE AS d FROM ({_XGD})",
    "improvement_filter": """SELECT step, round(CASE WHEN n > 5 THEN (oldest - v) / CASE WHEN n >= 10 THEN 9 ELSE n END / abs(v) ELSE 'inf'::DOUBLE END, 9) AS improvement FROM (
        SELECT step, v, row_number() OVER (ORDER BY step) - 1 AS n, first_value(v) OVER (ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS oldest
        FROM (SELECT n_nationkey AS step, 1000.0::DOUBLE / (n_nationkey + 1) AS v FROM nation))""",
    "predict": f"{_W}{_SCORED} SELECT row_id AS row, round(1 / (1 + exp(-s)), 9) AS probability FROM s",
    "model_text_roundtrip": f"{_W} SELECT id, value FROM w",
    "recordio_roundtrip": f"WITH {ORDER_SQL} SELECT num_positive, num_appearance, count(*) AS n, 3 * count(*)::BIGINT AS features FROM inst GROUP BY 1, 2",
    "text_places": "SELECT (sum(octet_length(encode(c_name)) + 1) OVER (ORDER BY c_custkey) - octet_length(encode(c_name)) - 1)::BIGINT AS place, c_name AS value FROM customer",
    "message_dump": f"WITH {ORDER_SQL} SELECT name, count(*) AS n FROM feat GROUP BY name",
    "text_instances": f"{_DICT} SELECT id, count(*) AS n, sum(num_positive::DOUBLE) AS positive FROM feat JOIN dict USING (name) GROUP BY id",
    "distinct_names_job": f"WITH {ORDER_SQL} SELECT name, count(*) AS n FROM feat GROUP BY name",
}
