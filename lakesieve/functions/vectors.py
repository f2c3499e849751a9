"""Vector expressions over array<double> columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def mean_squared_error(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))) / F.size(x)


def cosine(x: Column, y: Column, floor: float = 1e-8) -> Column:
    return dot(x, y) / (F.greatest(norm(x), F.lit(floor)) * F.greatest(norm(y), F.lit(floor)))


def cosine_loss(x: Column, y: Column, weight: float = 1.0, power: int = 1) -> Column:
    """weight * (1 - cosine) ** power; the three losses in use are (1, 3), (30, 1) and (10, 3)."""
    return F.lit(float(weight)) * F.pow(F.lit(1.0) - cosine(x, y), F.lit(float(power)))


def log_softmax(logits: Column, temperature: float) -> Column:
    scaled = F.transform(logits, lambda v: v.cast("double") / temperature)
    return F.transform(F.array(scaled), lambda s: F.transform(s, lambda v: v - F.array_max(s) - F.log(total(F.transform(s, lambda u: F.exp(u - F.array_max(s)))))))[0]


def distillation(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """KL(teacher || student) at the temperature, summed over the vocabulary, times its square."""
    terms = F.zip_with(log_softmax(teacher, temperature), log_softmax(student, temperature), lambda t, s: F.exp(t) * (t - s))
    return total(terms) * (temperature * temperature)


def argmax(scores: Column) -> Column:
    """The first place, from 0, of the largest; null for an empty array."""
    return F.nullif(F.array_position(scores, F.array_max(scores)), F.lit(0)) - 1
