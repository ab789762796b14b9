"""Formulas over scalars and vectors, evaluated in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import let

# Term saturation and length weight of the lexical score.
K1, B = 1.5, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + B * length / mean_length))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(values: Column) -> Column:
    """Shifted by the maximum; empty stays empty."""
    exps = let(
        F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v.cast("double") - top))
    )
    return let(exps, lambda es: let(total(es), lambda s: F.transform(es, lambda e: e / s)))


def log_softmax(values: Column) -> Column:
    return let(
        F.array_max(values).cast("double"),
        lambda top: let(
            F.log(total(F.transform(values, lambda v: F.exp(v.cast("double") - top)))) + top,
            lambda lse: F.transform(values, lambda v: v.cast("double") - lse),
        ),
    )


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label)


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    """Sigmoid loss in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def smoothed_labels(label: Column, classes: int, smoothing: float, filler: int = 0) -> Column:
    """Target distribution: confidence at the label, nothing at the padding class."""
    rest = smoothing / (classes - 2)
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when((label == filler) | (i == filler), 0.0)
        .when(i == label, 1.0 - smoothing)
        .otherwise(rest),
    )


def kl_divergence(target: Column, log_probs: Column) -> Column:
    """Sum of t * (ln t - log p) with 0 * ln 0 = 0."""
    return total(
        F.zip_with(
            target, log_probs, lambda t, lp: F.when(t > 0, t * (F.log(t) - lp)).otherwise(F.lit(0.0))
        )
    )


def layer_norm(values: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (sample deviation + eps)."""
    n = F.size(values)
    return let(
        total(values) / n,
        lambda mean: let(
            F.sqrt(
                total(
                    F.transform(values, lambda v: (v.cast("double") - mean) * (v.cast("double") - mean))
                )
                / (n - 1)
            ),
            lambda dev: F.transform(values, lambda v: (v.cast("double") - mean) / (dev + eps)),
        ),
    )


def gelu_tanh(x: Column) -> Column:
    inner = math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)
    return 0.5 * x * (1 + F.tanh(inner))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def erf(x: Column) -> Column:
    """Error function as its Maclaurin series (all terms that matter for |x| < 6)."""
    z = F.least(F.abs(x), F.lit(6.0))
    # term_n = z^(2n+1) * 2^n / (1*3*..*(2n+1)), all positive: no cancellation
    state = F.struct(z.cast("double").alias("t"), z.cast("double").alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        state,
        lambda acc, n: F.struct(
            (acc["t"] * 2 * z * z / (2 * n + 1)).alias("t"),
            (acc["s"] + acc["t"] * 2 * z * z / (2 * n + 1)).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return F.signum(x) * F.exp(-z * z) * series * (2 / math.sqrt(math.pi))


def gelu_erf(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def noam_rate(step: Column, width: int, warmup: int) -> Column:
    """width^-0.5 * min(step^-0.5, step * warmup^-1.5); step 0 counts as 1."""
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(width**-0.5) * F.least(F.pow(s, F.lit(-0.5)), s * F.lit(warmup**-1.5))


def linear_rate(step: Column, base: float, total_steps: int, warmup: int) -> Column:
    """Linear warm-up, then linear decay to zero."""
    s = step.cast("double")
    decayed = base * (1 - F.least(s, F.lit(float(total_steps))) / total_steps)
    return F.when(s < warmup, base * s / warmup).otherwise(decayed)


def sinusoid(position: Column, width: int) -> Column:
    """Even components sine, odd components cosine."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: let(
            position.cast("double") * F.exp((i - i % 2) * F.lit(-math.log(10000.0) / width)),
            lambda angle: F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)),
        ),
    )


def step_counts(rows: Column, batch: int, epochs: float, warmup: float) -> tuple[Column, Column]:
    """Training steps and warm-up steps, both cut to whole numbers."""
    steps = (rows / batch * epochs).cast("int")
    return steps, (steps * warmup).cast("int")
