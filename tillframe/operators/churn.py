"""Recency, frequency and money per customer, churn labels and the churn model."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import quantile_row, with_scalars
from tillframe.operators.marts import money
from tillframe.sources.storage import materialize

# Limits of the labels, the model and the risk bands.
MIN_THRESHOLD_DAYS, THRESHOLD_QUANTILE, MIN_CUSTOMERS = 30, 0.70, 10
TREES, SEED, TRAIN_TENTHS = 100, 42, 7
RISK_BANDS = (("Faible", 0.33), ("Moyen", 0.66), ("Élevé", 1.0))
OK, TOO_FEW = "ok", "too few customers"  # status of a label
FEATURES = ("recency_days", "frequency", "monetary", "relation_days")


def customer_rfm_base(customers: DataFrame, sales: DataFrame, min_orders: int = 1) -> DataFrame:
    """Orders, money, first and last order, days since the last order of anyone."""
    per_invoice = sales.groupBy("customer_id", "invoice_no").agg(
        F.sum("revenue").alias("revenue"), F.min("invoice_ts").alias("first"), F.max("invoice_ts").alias("last")
    )
    per_customer = per_invoice.groupBy("customer_id").agg(
        F.count("invoice_no").alias("frequency"),
        money(F.sum("revenue")).alias("monetary"),
        F.min("first").alias("first_order"),
        F.max("last").alias("last_order"),
    )
    known = per_customer.where(F.col("frequency") >= min_orders).join(customers.select("customer_id", "country"), "customer_id")
    known = materialize(known, "rfm-known")  # read twice: for its latest order and for its rows
    latest = known.agg(F.max("last_order").alias("_ref"))

    def days(start: str, end: str) -> Column:
        return F.timestamp_diff("DAY", F.col(start), F.col(end))

    return with_scalars(known, latest).select(
        "customer_id",
        "country",
        "frequency",
        "monetary",
        "first_order",
        "last_order",
        days("last_order", "_ref").alias("recency_days"),
        F.greatest(days("first_order", "last_order"), F.lit(1)).alias("relation_days"),
    )


def churn_threshold(base: DataFrame) -> DataFrame:
    """One row: the 70 % quantile of recency in whole days, but at least 30."""
    q = quantile_row(base, {"q": ("recency_days", THRESHOLD_QUANTILE)})
    return q.select(F.greatest(F.col("q").cast("int"), F.lit(MIN_THRESHOLD_DAYS)).cast("long").alias("threshold_days"))


def churn_labels(base: DataFrame, min_customers: int = MIN_CUSTOMERS) -> DataFrame:
    """Customers silent for longer than the threshold.

    Of fewer than ``min_customers`` customers nothing can be said: they come
    without a threshold and a label, and the status says why.
    """
    enough = base.agg((F.count("*") >= min_customers).alias("_enough"))
    rows = with_scalars(with_scalars(base, churn_threshold(base)), enough)
    threshold = F.when(F.col("_enough"), F.col("threshold_days"))
    churned = (F.col("recency_days") > threshold).cast("long").alias("churned")
    status = F.when(F.col("_enough"), OK).otherwise(TOO_FEW).alias("status")
    return rows.select("customer_id", "country", *FEATURES, threshold.alias("threshold_days"), churned, status)


def churn_rate(labels: DataFrame) -> DataFrame:
    """Customers and churned customers; without labels the rate is null."""
    pct = F.sum("churned").cast("decimal(20,0)") * 100 / F.count("*").cast("decimal(20,0)")
    return labels.groupBy("threshold_days").agg(
        F.count("*").alias("customers"), F.sum("churned").alias("churned"), F.round(pct, 1).cast("double").alias("churn_rate_pct")
    )


def recency_histogram(base: DataFrame, bins: int = 30) -> DataFrame:
    """Customers per equal-width bin of recency."""
    span = base.agg(F.min("recency_days").alias("lo"), F.max("recency_days").alias("hi"))
    width = F.col("hi") - F.col("lo")
    slot = F.when(width > 0, F.floor((F.col("recency_days") - F.col("lo")) * bins / width)).otherwise(F.lit(0))
    binned = with_scalars(base, span).withColumn("bin", F.least(slot + 1, F.lit(bins)).cast("long"))
    return binned.groupBy("bin").agg(
        F.count("*").alias("customers"), F.min("recency_days").alias("min_days"), F.max("recency_days").alias("max_days")
    )


def risk_band(probability: Column) -> Column:
    """Right-closed bands from 0; a probability of exactly 0 has none."""
    band = F.when(probability <= 0, F.lit(None))
    for name, high in RISK_BANDS:
        band = band.when(probability <= high, name)
    return band


class ChurnModel:
    """A random forest on labelled customers with balanced class weights."""

    def __init__(self, labels: DataFrame, trees: int = TREES, seed: int = SEED):
        labels = materialize(labels.where(F.col("churned").isNotNull()), "churn-input")
        sizes = {r["churned"]: r["count"] for r in labels.groupBy("churned").count().collect()}
        if len(sizes) < 2:
            raise ValueError("churn needs both classes")
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labels.fillna(0, list(FEATURES)))
        slot = F.pmod(F.xxhash64(F.lit(seed), "customer_id"), F.lit(10))
        rows = rows.withColumn("train", slot < TRAIN_TENTHS)
        training = rows.where("train")
        balance = {r["churned"]: r["count"] for r in training.groupBy("churned").count().collect()}
        total = sum(balance.values())
        weight = F.when(F.col("churned") == 1, total / (2.0 * balance.get(1, 1))).otherwise(total / (2.0 * balance.get(0, 1)))
        forest = RandomForestClassifier(
            labelCol="churned", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed
        )
        self.model = forest.fit(training.withColumn("weight", weight))
        scored = self.model.transform(rows).withColumn("probability_1", vector_to_array("probability")[1])
        self.scored = materialize(scored.drop("features", "probability"), "churn-scores")  # every report reads these

    def quality(self) -> DataFrame:
        """Rows, accuracy and area under the curve for both parts of the split.

        Recency is a feature and also defines the label, so these look too good.
        """
        hit = (F.col("prediction") == F.col("churned")).cast("double")
        part = F.when(F.col("train"), "train").otherwise("test").alias("part")
        table = self.scored.groupBy(part).agg(F.count("*").alias("rows"), F.round(F.avg(hit), 4).alias("accuracy"))
        evaluator = BinaryClassificationEvaluator(labelCol="churned", rawPredictionCol="rawPrediction")
        area = evaluator.evaluate(self.scored.where(~F.col("train")))
        return table.withColumn("test_area_under_curve", F.lit(round(float(area), 4)))

    def risk(self) -> DataFrame:
        rows = self.scored.select(
            "customer_id",
            "country",
            "frequency",
            "monetary",
            "recency_days",
            F.round("probability_1", 6).alias("churn_probability"),
        )
        return rows.withColumn("risk", risk_band(F.col("churn_probability")))

    def top_risk(self, n: int = 20) -> DataFrame:
        high = self.risk().where(F.col("risk") == RISK_BANDS[-1][0])
        return high.orderBy(F.desc("churn_probability"), "customer_id").limit(n)

    def histogram(self, bins: int = 20) -> DataFrame:
        slot = F.least(F.floor(F.col("churn_probability") * bins) + 1, F.lit(bins)).cast("long")
        return self.risk().groupBy(slot.alias("bin"), "risk").agg(F.count("*").alias("customers"))

    def importance(self) -> DataFrame:
        pairs = [(f, float(v)) for f, v in zip(FEATURES, self.model.featureImportances.toArray())]
        return self.scored.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(
            F.desc("importance")
        )


