"""Evaluation and formula queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.operators import metrics as M
from corpusloom.plans.registry import query, table
from corpusloom.sources.writers import probability_line, rounded_layers

# Predictions come from fixed rules over the tables: the length of a document predicts its
# quality, its number predicts its language.


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    labels = table(spark, sf, "labels")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("actual"),
        (F.col("n_chars") % 7 < 4).cast("int").alias("predicted"),
        (F.col("n_chars") % 101 / 101.0).alias("score"),
        (F.col("doc_id") % 5 != 0).cast("double").alias("weight"),
    )


_PRED = """(SELECT doc_id, quality AS actual, (n_chars % 7 < 4)::INT AS predicted, (n_chars % 101) / 101.0::DOUBLE AS score,
    (doc_id % 5 <> 0)::INT::DOUBLE AS weight FROM labels JOIN documents USING (doc_id))"""
_LANGS = "(SELECT lang AS actual, CASE doc_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN 'en' ELSE 'xx' END AS predicted FROM documents)"


def languages(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.element_at(F.array(*[F.lit(x) for x in ("fr", "en", "en", "xx")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("lang").alias("actual"), guess.alias("predicted"))


@query(
    "metrics_binary",
    f"""SELECT round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
          round(CASE WHEN p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f_score FROM (
          SELECT avg((predicted = actual)::INT) AS acc,
            count(*) FILTER (predicted = 1 AND actual = 1)::DOUBLE / greatest(count(*) FILTER (predicted = 1), 1) AS p,
            count(*) FILTER (predicted = 1 AND actual = 1)::DOUBLE / greatest(count(*) FILTER (actual = 1), 1) AS r FROM {_PRED})""",
)
def metrics_binary(spark: SparkSession, sf: str) -> DataFrame:
    row = M.binary_metrics(predictions(spark, sf), "predicted", "actual", beta=2.0)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


_BY_LABEL = f"""(SELECT label, tp, np, na, CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS p, CASE WHEN na = 0 THEN 0 ELSE tp::DOUBLE / na END AS r
    FROM (SELECT label, sum(tp) AS tp, sum(np) AS np, sum(na) AS na FROM (
      SELECT predicted AS label, (predicted = actual)::INT AS tp, 1 AS np, 0 AS na FROM {_LANGS} UNION ALL
      SELECT actual, 0, 0, 1 FROM {_LANGS}) GROUP BY label))"""


@query(
    "metrics_by_label",
    f"""SELECT label, tp::BIGINT AS tp, np::BIGINT AS n_predicted, na::BIGINT AS n_actual, round(p, 6) AS precision, round(r, 6) AS recall,
          round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f_score FROM {_BY_LABEL}""",
)
def metrics_by_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.label_metrics(languages(spark, sf), "predicted", "actual")
    rated = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f_score")]
    return rows.select("label", "tp", "n_predicted", "n_actual", *rated)


@query(
    "metrics_macro",
    f"""SELECT (SELECT round(avg((predicted = actual)::INT), 6) FROM {_LANGS}) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
          round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f_score FROM {_BY_LABEL}""",
)
def metrics_macro(spark: SparkSession, sf: str) -> DataFrame:
    row = M.macro_metrics(languages(spark, sf), "predicted", "actual")
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "auc",
    f"""SELECT round(sum(CASE WHEN actual = 1 THEN r ELSE 0 END - CASE WHEN actual = 1 THEN (np + 1) / 2.0::DOUBLE ELSE 0 END)
            / (any_value(np) * any_value(nn)), 6) AS auc
        FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
                count(*) FILTER (actual = 1) OVER () AS np, count(*) FILTER (actual = 0) OVER () AS nn FROM {_PRED})""",
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(predictions(spark, sf), "score", "actual").select(F.round("auc", 6).alias("auc"))


@query(
    "weighted_metrics",
    f"""SELECT round(sum(weight * score) / sum(weight), 6) AS eval_loss, round(sum(weight * (predicted = actual)::INT) / sum(weight), 6) AS eval_accuracy,
          round((1 + sum(weight * (predicted = 1 AND actual = 1)::INT) / sum(weight * actual)
                   - sum(weight * (predicted = 1 AND actual = 0)::INT) / sum(weight * (1 - actual))) / 2, 6) AS eval_auc,
          round(sum(weight * (predicted = 1 AND actual = 1)::INT) / sum(weight * predicted), 6) AS eval_precision,
          round(sum(weight * (predicted = 1 AND actual = 1)::INT) / sum(weight * actual), 6) AS eval_recall FROM {_PRED}""",
)
def weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    row = M.weighted_metrics(predictions(spark, sf), "predicted", "actual", "weight", "score")
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "eval_lines",
    f"""SELECT k || ' = ' || v AS line FROM (
          SELECT 'n_rows' AS k, count(*)::VARCHAR AS v FROM {_PRED} UNION ALL
          SELECT 'n_positive', sum(actual)::VARCHAR FROM {_PRED} UNION ALL
          SELECT 'n_right', count(*) FILTER (actual = predicted)::VARCHAR FROM {_PRED})""",
)
def eval_lines(spark: SparkSession, sf: str) -> DataFrame:
    row = predictions(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("actual").alias("n_positive"),
        F.count_if(F.col("actual") == F.col("predicted")).alias("n_right"),
    )
    return M.key_value_lines(row)


@query(
    "losses",
    """SELECT event_type, round(sum(value * w) / (sum(w) + 1e-5::DOUBLE), 6) AS masked_loss,
         round(sum(value) / sum(w), 6) AS token_loss, round(coalesce(avg(value), 0), 6) AS mean_loss
       FROM (SELECT *, (event_id % 3)::DOUBLE AS w FROM events) GROUP BY event_type""",
)
def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted, per-token and plain means of a loss column."""
    rows = table(spark, sf, "events").select("event_type", "value", (F.col("event_id") % 3).cast("double").alias("w"))
    means = rows.groupBy("event_type").agg(
        M.masked_loss(F.col("value"), F.col("w")).alias("masked_loss"),
        M.token_weighted_loss(F.col("value"), F.col("w")).alias("token_loss"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_loss"),
    )
    return means.select("event_type", *[F.round(c, 6).alias(c) for c in ("masked_loss", "token_loss", "mean_loss")])


@query(
    "running_avg",
    """SELECT user_id, event_id, round(avg(value) OVER w, 5) AS mean_loss,
         round(100.0::DOUBLE * sum(event_id % 2) OVER w / count(*) OVER w, 5) AS percent_correct
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Users stand for epochs; a user with a third of all events is still spread over tasks."""
    steps = table(spark, sf, "events").select(
        "user_id", "event_id", "value", (F.col("event_id") % 2).alias("right"), F.lit(1).cast("bigint").alias("size")
    )
    means = M.running_means(steps, "user_id", "event_id", "value", "right", "size")
    return means.select(
        "user_id", "event_id", F.round("mean_loss", 5).alias("mean_loss"), F.round("percent_correct", 5).alias("percent_correct")
    )


# -- formulas ---------------------------------------------------------------------------------------

_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_SM = "[exp(x - list_max(e)) / list_sum([exp(y - list_max(e)) for y in e]) for x in e]"


@query(
    "softmax",
    f"""SELECT vec_id, round(list_max({_SM}), 6) AS top, round(list_sum({_SM}), 6) AS total,
          round(-ln({_SM}[label + 1]), 6) AS cross_entropy,
          round(greatest(e[1], 0) - e[1] * (label % 2) + ln(1 + exp(-abs(e[1]))), 6) AS binary_loss, (e[1] >= 0)::INT AS positive FROM {_E}""",
)
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities, cross entropy, binary loss and thresholding of logits."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("p", N.softmax(F.col("e")))
    first = F.get("e", F.lit(0))
    return rows.select(
        "vec_id",
        F.round(F.array_max("p"), 6).alias("top"),
        F.round(N.total(F.col("p")), 6).alias("total"),
        F.round(N.cross_entropy(F.col("e"), F.col("label")), 6).alias("cross_entropy"),
        F.round(N.binary_cross_entropy(first, F.col("label") % 2), 6).alias("binary_loss"),
        (first >= 0).cast("int").alias("positive"),
    )


_MEAN = "list_avg(e)"
_DEV = "list_stddev_samp(e)"


@query(
    "layer_norm",
    f"""SELECT vec_id, round((e[1] - {_MEAN}) / ({_DEV} + 1e-6::DOUBLE), 5) AS first, round((e[64] - {_MEAN}) / ({_DEV} + 1e-6::DOUBLE), 5) AS last,
          round(0.5::DOUBLE * e[1] * (1 + tanh(sqrt(2 / pi()) * (e[1] + 0.044715::DOUBLE * e[1] ** 3))), 6) AS gelu, greatest(e[1], 0) AS relu,
          round(tanh(e[1]), 6) AS tanh FROM {_E}""",
)
def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("n", N.layer_norm(F.col("e")))
    first = F.get("e", F.lit(0))
    return rows.select(
        "vec_id",
        F.round(F.get("n", F.lit(0)), 5).alias("first"),
        F.round(F.get("n", F.lit(63)), 5).alias("last"),
        F.round(N.gelu_tanh(first), 6).alias("gelu"),
        N.relu(first).alias("relu"),
        F.round(F.tanh(first), 6).alias("tanh"),
    )


@query(
    "label_smoothing",
    """SELECT vec_id, round(list_sum(t), 6) AS mass, round(t[label + 1], 6) AS at_label,
         round(list_sum([CASE WHEN t[i] > 0 THEN t[i] * (ln(t[i]) - (e[i] - list_max(e) - ln(list_sum([exp(y - list_max(e)) for y in e])))) ELSE 0 END for i in range(1, 65)]), 6) AS divergence
       FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, [CASE WHEN label = 0 OR i = 0 THEN 0 WHEN i = label THEN 0.9::DOUBLE ELSE 0.1::DOUBLE / 62 END for i in range(0, 64)] AS t
             FROM embeddings)""",
)
def label_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed targets over all classes (class 0 is padding) and their divergence."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("e"),
        N.smoothed_labels(F.col("label"), 64, 0.1).alias("t"),
    )
    return rows.select(
        "vec_id",
        F.round(N.total(F.col("t")), 6).alias("mass"),
        F.round(F.get("t", F.col("label")), 6).alias("at_label"),
        F.round(N.kl_divergence(F.col("t"), N.log_softmax(F.col("e"))), 6).alias("divergence"),
    )


@query(
    "rate_schedules",
    """SELECT event_id, round(512 ** -0.5::DOUBLE * least(greatest(event_id, 1) ** -0.5::DOUBLE, greatest(event_id, 1) * 4000 ** -1.5::DOUBLE), 9) AS noam,
         round(CASE WHEN event_id < 1000 THEN 2e-5::DOUBLE * event_id / 1000 ELSE 2e-5::DOUBLE * (1 - least(event_id, 8000) / 8000.0::DOUBLE) END, 12) AS linear,
         round(sin(event_id::DOUBLE), 6) AS pos0, round(cos(event_id * exp(2 * (-ln(10000) / 8))), 6) AS pos3
       FROM events""",
)
def rate_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Learning rates and position encodings for every step number in the table."""
    step = F.col("event_id")
    positions = N.sinusoid(step, 8)
    return table(spark, sf, "events").select(
        "event_id",
        F.round(N.noam_rate(step, 512, 4000), 9).alias("noam"),
        F.round(N.linear_rate(step, 2e-5, 8000, 1000), 12).alias("linear"),
        F.round(F.get(positions, F.lit(0)), 6).alias("pos0"),
        F.round(F.get(positions, F.lit(3)), 6).alias("pos3"),
    )


@query(
    "probability_lines",
    f"""SELECT vec_id, len(string_split(line, chr(9)))::INT AS n_classes, round(list_sum([x::DOUBLE for x in string_split(line, chr(9))]), 4) AS total
        FROM (SELECT vec_id, array_to_string([round(x, 6)::VARCHAR for x in {_SM}], chr(9)) AS line FROM {_E})""",
)
def probability_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated class probabilities, read back."""
    rows = table(spark, sf, "embeddings").select("vec_id", probability_line(N.softmax(F.col("embedding")), 6).alias("line"))
    cells = F.split("line", "\t")
    return rows.select(
        "vec_id",
        F.size(cells).alias("n_classes"),
        F.round(N.total(F.transform(cells, lambda x: x.cast("double"))), 4).alias("total"),
    )


@query(
    "feature_json",
    "SELECT vec_id, round(list_sum([round(x, 6) for x in e]), 4) AS total, len(e)::INT AS width FROM " + _E,
)
def feature_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded feature layers as JSON, parsed again."""
    layers = F.array(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", rounded_layers(layers).alias("json"))
    parsed = F.get(F.from_json("json", "array<array<double>>"), F.lit(0))
    return rows.select("vec_id", F.round(N.total(parsed), 4).alias("total"), F.size(parsed).alias("width"))
