"""L1-regularised logistic regression by an orthant-wise limited-memory quasi-Newton method.

An evaluation is one job over the cached instances: each partition gives its loss and
the gradient of the features that it has, which are added up by id before they reach the
driver. The driver holds vectors over the features, never instances. Two choices differ
from a literal reading of the method, so that a small problem ends well: an update
without curvature (s.y not above EPSILON) is left out, and a pseudo-gradient of zero ends
training as converged.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.objective import FAR, OFFSET, single, usable

EPSILON = 1e-12
#: The line search's slope and the improvement's window.
ARMIJO, WINDOW = 1e-4, 5
CONVERGED, NO_DESCENT, ENOUGH_STEPS, LONG_SEARCH = "converged", "direction doesn't descend", "enough iterations", "enough line-search steps"


@dataclass
class Options:
    memory: int = 10
    l1: float = 1.0
    max_line_search: int = 20
    max_iterations: int = 120
    tolerance: float = 1e-4
    duplicates: str = "last"
    local: bool = False
    binary: bool = False

    def __post_init__(self):
        for name in ("memory", "max_line_search", "max_iterations"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is 1 at least")
        if self.l1 < 0 or self.tolerance < 0:
            raise ValueError("l1 and tolerance are 0 at least")


class Improvement:
    """Mean relative improvement over the last values; infinite until enough are known.

    The oldest of ten values leaves before the mean is taken, so that ten intervals are divided by nine.
    """

    def __init__(self, values=()):
        self.values = deque(values)

    def add(self, value: float) -> float:
        out = math.inf
        if len(self.values) > WINDOW:
            oldest = self.values[0]
            if len(self.values) == 2 * WINDOW:
                self.values.popleft()
            out = (oldest - value) / len(self.values) / abs(value)
        self.values.append(value)
        return out


def steepest(x: np.ndarray, g: np.ndarray, l1: float) -> np.ndarray:
    if l1 == 0:
        return -g
    soft = np.where(g < -l1, -g - l1, np.where(g > l1, -g + l1, 0.0))
    return np.where(x < 0, -g + l1, np.where(x > 0, -g - l1, soft))


def fix_signs(d: np.ndarray, descent: np.ndarray, l1: float) -> np.ndarray:
    return np.where(d * descent <= 0, 0.0, d) if l1 > 0 else d


def directional(x: np.ndarray, g: np.ndarray, d: np.ndarray, l1: float) -> float:
    side = np.where(x != 0, np.sign(x), np.sign(d))
    return float(d @ (g + l1 * side))


def next_point(x: np.ndarray, d: np.ndarray, step: float, l1: float) -> np.ndarray:
    new = x + step * d
    return np.where(x * new < 0, 0.0, new) if l1 > 0 else new


@dataclass
class Learner:
    """The optimiser's state between evaluations; the point to evaluate next is `new_x`."""

    options: Options
    x: np.ndarray
    new_x: np.ndarray = None
    grad: np.ndarray = None
    direction: np.ndarray = None
    s: list = field(default_factory=list)
    y: list = field(default_factory=list)
    rho: list = field(default_factory=list)
    seen: list = field(default_factory=list)
    old_value: float = math.inf
    slope: float = 0.0
    step: float = 1.0
    backoff: float = 0.1
    iteration: int = 0
    searched: int = 0
    evaluations: int = 0
    reason: str | None = None

    def __post_init__(self):
        if self.new_x is None:
            self.new_x = self.x

    def tell(self, value: float, grad: np.ndarray) -> None:
        """What an evaluation at new_x gave; sets the next new_x, or the reason to stop."""
        self.evaluations += 1
        filter_ = Improvement(self.seen)
        if self.grad is None:
            self.grad = grad
            filter_.add(value)
            self.seen = list(filter_.values)
            if self._aim(value):
                self.step, self.backoff = 1 / float(np.linalg.norm(self.direction)), 0.1
                self.new_x = next_point(self.x, self.direction, self.step, self.options.l1)
            return
        if not value <= self.old_value + ARMIJO * self.slope * self.step:
            self.searched += 1
            if self.searched > self.options.max_line_search:
                self.reason = LONG_SEARCH
                return
            self.step *= self.backoff
            self.new_x = next_point(self.x, self.direction, self.step, self.options.l1)
            return
        better = filter_.add(value)
        self.seen = list(filter_.values)
        if better < self.options.tolerance:
            self.reason = CONVERGED
            return
        s, y = self.new_x - self.x, grad - self.grad
        if (rho := float(s @ y)) > EPSILON:
            self.s, self.y, self.rho = ([*old, new][-self.options.memory :] for old, new in ((self.s, s), (self.y, y), (self.rho, rho)))
        self.x, self.grad, self.searched = self.new_x, grad, 0
        self.iteration += 1
        if self.iteration > self.options.max_iterations:
            self.reason = ENOUGH_STEPS
            return
        self._ahead(value)

    def go_on(self, value: float) -> None:
        """After a run that had enough iterations: goes on where the options now allow more. value: the last one accepted."""
        if self.reason == ENOUGH_STEPS and self.iteration <= self.options.max_iterations:
            self.reason = None
            self._ahead(value)

    def _ahead(self, value: float) -> None:
        if self._aim(value):
            self.step, self.backoff = 1.0, 0.5
            self.new_x = next_point(self.x, self.direction, self.step, self.options.l1)

    def _aim(self, value: float) -> bool:
        """A new direction from x; False where there is none to go."""
        l1 = self.options.l1
        descent = steepest(self.x, self.grad, l1)
        if not descent.any():
            self.reason, self.new_x = CONVERGED, self.x
            return False
        d = descent.copy()
        alphas = [0.0] * len(self.s)
        for i in reversed(range(len(self.s))):
            alphas[i] = float(self.s[i] @ d) / self.rho[i]
            d -= alphas[i] * self.y[i]
        if self.s:
            d *= self.rho[-1] / float(self.y[-1] @ self.y[-1])
        for i in range(len(self.s)):
            d += (alphas[i] - float(self.y[i] @ d) / self.rho[i]) * self.s[i]
        self.direction = fix_signs(d, descent, l1)
        self.slope = directional(self.x, self.grad, self.direction, l1)
        self.old_value = value
        if not self.slope < 0:
            self.reason = NO_DESCENT
            return False
        return True


@dataclass
class Model:
    """Weights by feature id, and how training went."""

    ids: np.ndarray
    weights: np.ndarray
    values: list[float]
    reason: str
    iterations: int
    evaluations: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, value) of the weights that aren't zero."""
        kept = self.weights != 0
        return spark.createDataFrame([(int(i), float(w)) for i, w in zip(self.ids[kept], self.weights[kept])], "id int, value double")

    def text(self) -> str:
        entries = "".join(f"{i}:{w:.17g} " for i, w in zip(self.ids.tolist(), self.weights.tolist()) if w)
        return f"[ {entries}]"


def prepare(instances: DataFrame, options: Options) -> DataFrame:
    """pos, app, ids and vals of usable instances."""
    rows = usable(instances, options.local)
    features = F.col("features")
    if options.binary:
        features = F.transform(features, lambda x: F.struct(x["id"].alias("id"), F.lit(1.0).alias("value")))
    if options.duplicates == "last" and not options.binary:
        features = single(features)
    return rows.select(F.col("num_positive").cast("double").alias("pos"), F.col("num_appearance").cast("double").alias("app"), features.alias("f")).select(
        "pos", "app", F.transform("f", lambda x: x["id"]).alias("ids"), F.transform("f", lambda x: x["value"]).alias("vals")
    )


def _partial(batch, ids: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    pos, app = (batch.column(c).to_numpy() for c in ("pos", "app"))
    lists = batch.column("ids")
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(pos)), sizes)
    at = np.searchsorted(ids, lists.flatten().to_numpy())
    value = batch.column("vals").flatten().to_numpy()
    s = np.bincount(row, weights=x[at] * value, minlength=len(pos)) if len(row) else np.zeros(len(pos))

    def loss_and_rest(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(-np.clip(z, -FAR, FAR))
        loss = np.where(z < -FAR, -z, np.where(z > FAR, 0.0, np.log1p(e)))
        return loss, 1 - np.where(z < -FAR, 0.0, np.where(z > FAR, 1.0, 1 / (1 + e)))

    up, down = loss_and_rest(s), loss_and_rest(-s)
    loss = float((pos * up[0] + (app - pos) * down[0]).sum())
    slope = -pos * up[1] + (app - pos) * down[1]
    return loss, np.bincount(at, weights=slope[row] * value, minlength=len(ids)) if len(row) else np.zeros(len(ids))


def evaluator(prepared: DataFrame, ids: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The loss and gradient at a point, by one job."""
    spark = prepared.sparkSession

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((ids, x))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            own, point = shared.value
            loss, grad = 0.0, np.zeros(len(own))
            for batch in batches:
                more, part = _partial(batch, own, point)
                loss, grad = loss + more, grad + part
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(grad[at], loss))], ["at", "g"])

        sums = prepared.mapInArrow(run, "at bigint, g double").groupBy("at").agg(F.sum("g").alias("g")).toPandas()
        grad, at, g = np.zeros(len(ids)), sums["at"].to_numpy(), sums["g"].to_numpy()
        grad[at[at >= 0]] = g[at >= 0]
        shared.unpersist()
        return float(g[at < 0].sum()), grad

    return evaluate


def train(instances: DataFrame, options: Options | None = None, state_path: str | None = None) -> Model:
    """Trains on instances with feature ids; resumes from the newest state in state_path, and saves one after each evaluation."""
    options = options or Options()
    prepared = prepare(instances, options).persist()
    try:
        ids = np.sort(prepared.select(F.explode("ids").alias("id")).distinct().toPandas()["id"].to_numpy())
        evaluate = evaluator(prepared, ids)
        spark = instances.sparkSession
        learner, values, number = Learner(options, np.zeros(len(ids))), [], 0
        if state_path and (found := load_state(spark, state_path)):
            learner, ids_then, values, number = found
            learner.options = options
            if not np.array_equal(ids_then, ids):
                raise ValueError("the saved state is of other features")
            learner.go_on(values[-1])
        while learner.reason is None:
            loss, grad = evaluate(learner.new_x)
            value = OFFSET + loss + options.l1 * float(np.abs(learner.new_x).sum())
            before = learner.iteration, learner.evaluations
            learner.tell(value, grad)
            if before[1] == 0 or learner.iteration > before[0] or learner.reason == CONVERGED:
                values.append(value)
            if state_path:
                number += 1
                save_state(spark, state_path, number, learner, ids, values)
        point = learner.new_x if learner.reason == CONVERGED else learner.x
        return Model(ids, point, values, learner.reason, learner.iteration, learner.evaluations)
    finally:
        prepared.unpersist()


#: A state is rows of vector fragments; the row named "scalars" has the rest and the sizes of the vectors in its text.
_STATE = "number int, name string, part int, size int, text string, elements array<double>"
FRAGMENT = 1 << 20
_SCALARS = ("old_value", "slope", "step", "backoff", "iteration", "searched", "evaluations", "reason")
_VECTORS = ("x", "new_x", "grad", "direction", "rho", "seen")


def save_state(spark: SparkSession, path: str, number: int, learner: Learner, ids: np.ndarray, values: list[float], fragment: int = FRAGMENT) -> None:
    import pyarrow as pa

    vectors = {"ids": ids, "accepted": values} | {k: getattr(learner, k) for k in _VECTORS} | {f"{k}.{i}": v for k in "sy" for i, v in enumerate(getattr(learner, k))}
    vectors = {k: np.asarray(v, np.float64) for k, v in vectors.items() if v is not None}
    sizes = {k: len(v) for k, v in vectors.items()}
    rows = [("scalars", 0, json.dumps({k: getattr(learner, k) for k in _SCALARS} | {"options": asdict(learner.options), "sizes": sizes}), np.zeros(0))]
    rows += [(k, at // fragment, None, v[at : at + fragment]) for k, v in vectors.items() for at in range(0, len(v), fragment)]
    names, parts, texts, pieces = zip(*rows)
    lengths = [len(v) for v in pieces]
    whole = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64()), pa.array(np.concatenate(pieces)))
    columns = [pa.array([number] * len(rows), pa.int32()), pa.array(names), pa.array(parts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(texts, pa.string()), whole]
    frame = spark.createDataFrame(pa.table(columns, ["number", "name", "part", "size", "text", "elements"]), _STATE)
    frame.coalesce(max(1, sum(lengths) // (16 * fragment))).write.mode("append").parquet(path)


def _newest(spark: SparkSession, path: str):
    """(rows of the newest state that is there with all its fragments, its scalars), None without any."""
    from pyspark.errors import AnalysisException

    try:
        states = spark.read.schema(_STATE).parquet(path)
    except AnalysisException:
        return None
    # a row a state
    there = states.groupBy("number").agg(F.sum("size").alias("n"), F.max("text").alias("text")).where("text is not null").orderBy(F.desc("number"))
    for row in there.toLocalIterator():
        scalars = json.loads(row["text"])
        if sum(scalars["sizes"].values()) == row["n"]:
            return states.where(F.col("number") == row["number"]), scalars, row["number"]
    return None


def load_state(spark: SparkSession, path: str):
    """(learner, ids, accepted values, number) of the newest whole state, None without any."""
    found = _newest(spark, path)
    if found is None:
        return None
    rows, scalars, number = found
    sizes = scalars.pop("sizes")
    held: dict[str, list] = {k: [] for k in sizes}
    for row in rows.where("name <> 'scalars'").orderBy("name", "part").toLocalIterator():
        held[row["name"]].append(np.array(row["elements"], float))
    vectors = {k: np.concatenate(v) if v else np.zeros(0) for k, v in held.items()}
    several = lambda k: [vectors[f"{k}.{i}"] for i in range(sum(name.startswith(f"{k}.") for name in vectors))]
    options = Options(**scalars.pop("options"))
    learner = Learner(options, vectors["x"], vectors.get("new_x"), vectors.get("grad"), vectors.get("direction"), several("s"), several("y"), vectors["rho"].tolist(), vectors["seen"].tolist())
    for name, value in scalars.items():
        setattr(learner, name, value)
    return learner, vectors["ids"].astype(int), vectors["accepted"].tolist(), number


def dump_state(spark: SparkSession, path: str, model_only: bool = False) -> DataFrame:
    """The rows of the newest whole state, or only its model's (id, value); no rows without any."""
    found = _newest(spark, path)
    rows = found[0] if found else spark.createDataFrame([], _STATE)
    if not model_only:
        return rows
    ids, values = (rows.where(F.col("name") == name).select("part", F.col("elements").alias(name)) for name in ("ids", "new_x"))
    pairs = ids.join(values, "part").select(F.explode(F.arrays_zip("ids", "new_x")).alias("p"))
    return pairs.select(F.col("p.ids").cast("int").alias("id"), F.col("p.new_x").alias("value")).where("value <> 0")


def local_train(pos: np.ndarray, app: np.ndarray, features: list[list[tuple[int, float]]], options: Options) -> dict[int, float]:
    """The same optimiser on one machine's rows, for the parts of a mixture."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(pos, pa.float64()), pa.array(app, pa.float64()), pa.array([[i for i, _ in f] for f in features], pa.list_(pa.int32())), pa.array([[v for _, v in f] for f in features], pa.list_(pa.float64()))], ["pos", "app", "ids", "vals"])
    ids = np.unique(batch.column("ids").flatten().to_numpy())
    learner = Learner(options, np.zeros(len(ids)))
    while learner.reason is None:
        loss, grad = _partial(batch, ids, learner.new_x)
        learner.tell(OFFSET + loss + options.l1 * float(np.abs(learner.new_x).sum()), grad)
    point = learner.new_x if learner.reason == CONVERGED else learner.x
    return {int(i): float(w) for i, w in zip(ids, point) if w}


def mixture(instances: DataFrame, parts: int, options: Options | None = None) -> DataFrame:
    """(id, value): the mean of models trained on parts of the instances; a part without a feature counts as 0."""
    options = options or Options()
    prepared = prepare(instances, options).withColumn("part", F.pmod(F.xxhash64("pos", "app", "ids", "vals"), F.lit(parts)).cast("int"))

    def run(frame):
        import pandas as pd

        features = [list(zip(map(int, i), map(float, v))) for i, v in zip(frame["ids"], frame["vals"])]
        found = local_train(frame["pos"].to_numpy(), frame["app"].to_numpy(), features, options)
        return pd.DataFrame({"id": list(found), "w": list(found.values())}).astype({"id": "int32", "w": "float64"})

    each = prepared.groupBy("part").applyInPandas(run, "id int, w double")
    return each.groupBy("id").agg((F.sum("w") / parts).alias("value")).where("value <> 0")


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """The model as one line of text."""
    spark.createDataFrame([(model.text(),)], "value string").coalesce(1).write.text(path)


def new_state_path(base: str) -> str:
    return f"{base}/state-{uuid.uuid4().hex}"
