"""The weighted logistic loss with its gradient, by column expressions.

Instances have num_positive, num_appearance and features; weights are rows (id, value).
The objective is 1 + the losses + l1 * the sum of absolute weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Beyond this score exp isn't taken; the objective's constant.
FAR, OFFSET = 30.0, 1.0


def one_loss(z: Column) -> Column:
    return F.when(z < -FAR, -z).when(z > FAR, F.lit(0.0)).otherwise(F.log(1 + F.exp(-z)))


def one_probability(z: Column) -> Column:
    return F.when(z < -FAR, F.lit(0.0)).when(z > FAR, F.lit(1.0)).otherwise(1 / (1 + F.exp(-z)))


def usable(instances: DataFrame, local: bool = False) -> DataFrame:
    """Without invalid instances, and (unless local) without unlabelled ones."""
    rows = instances.where(F.col("num_positive") <= F.col("num_appearance"))
    return rows if local else rows.where(F.col("num_positive") >= 0)


def single(features: Column, duplicates: str = "last") -> Column:
    """Features with each id once: the last value of an id holds ("last"; a zero takes it away) or values add up ("sum").

    Features are sorted by id once, so that work is near linear in their number.
    """
    sort = F.array_sort(F.transform(features, lambda x, k: F.struct(x["id"].alias("id"), k.alias("k"), x["value"].alias("value"))))

    def once(column: Column, step) -> Column:  # a lambda's argument is computed once
        return F.get(F.transform(F.array(column), step), F.lit(0))

    if duplicates == "sum":

        def groups(x: Column) -> Column:
            begin = F.filter(F.transform(x, lambda y, k: F.when((k == 0) | (y["id"] != F.get(x, k - 1)["id"]), k)), lambda k: k.isNotNull())
            return F.struct(x.alias("x"), F.concat(begin, F.array(F.size(x))).alias("begin"))

        def sums(g: Column) -> Column:
            return F.transform(F.slice(g["begin"], 1, F.size(g["begin"]) - 1), lambda k, i: F.struct(
                F.get(g["x"], k)["k"].alias("k"), F.get(g["x"], k)["id"].alias("id"),
                F.aggregate(F.slice(g["x"], k + 1, F.get(g["begin"], i + 1) - k), F.lit(0.0), lambda s, y: s + y["value"]).alias("value"),
            ))

        kept = once(once(sort, groups), sums)
    else:
        last = once(sort, lambda x: F.filter(x, lambda y, k: (k == F.size(x) - 1) | (y["id"] != F.get(x, k + 1)["id"])))
        kept = F.transform(F.filter(last, lambda x: x["value"] != 0), lambda x: F.struct(x["k"].alias("k"), x["id"].alias("id"), x["value"].alias("value")))
    return F.transform(F.array_sort(kept), lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value")))


def scored(instances: DataFrame, weights: DataFrame, row: str = "row") -> DataFrame:
    """Each instance (with a unique `row`) with its score: weights are joined to exploded features."""
    each = instances.select(row, F.explode("features").alias("f"))
    terms = each.join(weights.select(F.col("id").alias("w_id"), F.col("value").alias("w")), F.col("f.id") == F.col("w_id"))
    sums = terms.groupBy(row).agg(F.sum(F.col("w") * F.col("f.value")).alias("s"))
    return instances.join(sums, row, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def with_loss(rows: DataFrame) -> DataFrame:
    """Adds loss and slope (the derivative by the score) to scored instances."""
    pos = F.col("num_positive").cast("double")
    neg = F.col("num_appearance").cast("double") - pos
    s = F.col("s")
    loss = pos * one_loss(s) + neg * one_loss(-s)
    slope = -pos * (1 - one_probability(s)) + neg * (1 - one_probability(-s))
    return rows.withColumns({"loss": loss, "slope": slope})


def objective(rows: DataFrame, weights: DataFrame, l1: float) -> DataFrame:
    """One row: value, of rows with their loss."""
    norm = weights.agg(F.coalesce(F.sum(F.abs("value")), F.lit(0.0)).alias("norm"))
    total = rows.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))
    return total.join(F.broadcast(norm)).select((F.lit(OFFSET) + F.col("loss") + F.lit(float(l1)) * F.col("norm")).alias("value"))


def gradient(rows: DataFrame) -> DataFrame:
    """(id, g) of rows with their slope."""
    each = rows.select("slope", F.explode("features").alias("f"))
    return each.groupBy(F.col("f.id").alias("id")).agg(F.sum(F.col("slope") * F.col("f.value")).alias("g"))


def _penalised(x: Column, g: Column, l1: float) -> Column:
    return F.when(x < 0, -g + l1).when(x > 0, -g - l1).when(g < -l1, -g - l1).when(g > l1, -g + l1).otherwise(F.lit(0.0))


def steepest(x: Column, g: Column, l1: float) -> Column:
    """The negative pseudo-gradient."""
    return -g if l1 == 0 else _penalised(x, g, l1)


def fix_signs(d: Column, descent: Column, l1: float) -> Column:
    """A direction without the parts that point away from the steepest descent."""
    return F.when(d * descent <= 0, F.lit(0.0)).otherwise(d) if l1 > 0 else d


def derivative_term(x: Column, g: Column, d: Column, l1: float) -> Column:
    """What one weight adds to the derivative along a direction."""
    if l1 == 0:
        return d * g
    side = F.when(x < 0, -1).when(x > 0, 1).when(d < 0, -1).when(d > 0, 1).otherwise(0)
    return d * (g + side * F.lit(float(l1)))


def next_point(x: Column, d: Column, step: float, l1: float) -> Column:
    """x + step * d, held at zero where it would change sign."""
    new = x + d * F.lit(float(step))
    return F.when(x * new < 0, F.lit(0.0)).otherwise(new) if l1 > 0 else new


def predict(instances: DataFrame, weights: DataFrame, row: str = "row") -> DataFrame:
    """Each instance with its probability; features without a weight count nothing."""
    return scored(instances, weights, row).withColumn("probability", 1 / (1 + F.exp(-F.col("s")))).drop("s")
