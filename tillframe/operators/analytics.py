"""Statistics, segments, scores and clusters over the marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.ordering import exact_quantiles, quantile_row, with_scalars
from tillframe.operators.marts import mean2, money
from tillframe.sources.storage import materialize

PRODUCT_METRICS = ("revenue", "margin", "quantity", "avg_rating", "reviews", "positive", "negative")
CUSTOMER_METRICS = ("orders", "products", "revenue", "avg_basket", "avg_rating", "reviews")
RADAR_METRICS = ("revenue", "margin", "quantity", "avg_rating", "reviews")
# Segment names by (high revenue, high rating), and profile names.
SEGMENTS = ("Champions", "Déçus Rentables", "Fans Peu Dépensiers", "Inactifs")
PROFILES = (("VIP", 4.5), ("Fidèle", 3.5), ("Actif", 2.5))
LAST_PROFILE = "À risque"
# Weights of the product score.
SCORE_WEIGHTS = {"revenue": 0.40, "avg_rating": 0.30, "quantity": 0.20, "negative": 0.10}


def _two(column: Column) -> Column:
    """Two decimals, half away from zero on the decimal digits."""
    return F.round(column.cast("decimal(28,6)"), 2).cast("double")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and median of each column; nulls are skipped."""
    long = df.select(*[F.col(c).cast("decimal(28,2)").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    basics = long.groupBy("column").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s"), F.count("v").alias("n")
    )
    medians = exact_quantiles(df, columns, {"median": 0.5})
    return basics.where("n > 0").join(F.broadcast(medians), "column").select(
        "column",
        _two(F.col("lo")).alias("min"),
        _two(F.col("hi")).alias("max"),
        mean2(F.col("s"), F.col("n")).cast("double").alias("mean"),
        _two(F.col("median")).alias("median"),
    )


def _pearson(a: str, b: str) -> Column:
    """Correlation over rows with both values; null when a column does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregate."""
    if len(columns) < 2:
        raise ValueError("a correlation needs at least two numeric columns")
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = doubles.agg(*[_pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{c}`").alias("v")) for a, b, c in cells]
    )
    return row.select(F.explode(entries).alias("e")).select(
        F.col("e.a").alias("column_a"),
        F.col("e.b").alias("column_b"),
        F.round("e.v", 3).alias("correlation"),
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    """Revenue per month end, with months without sales at zero."""
    day = F.last_day(F.col("invoice_ts").cast("date"))
    months = sales.groupBy(day.alias("month_end")).agg(F.sum("revenue").alias("r"))
    span = months.agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    first = F.trunc("a", "month")
    starts = F.explode(F.sequence(first, F.trunc("b", "month"), F.expr("interval 1 month"))).alias("start")
    calendar = span.where(F.col("a").isNotNull()).select(starts).select(F.last_day("start").alias("month_end"))
    return (
        calendar.join(months, "month_end", "left")
        .select(
            F.col("month_end").cast("timestamp_ntz").alias("month_end"),
            F.coalesce(money("r"), F.lit(0.0)).alias("revenue"),
        )
        .orderBy("month_end")
    )


def _thresholds(rated: DataFrame) -> DataFrame:
    return quantile_row(rated, {"revenue_threshold": ("revenue", 0.5), "rating_threshold": ("avg_rating", 0.5)})


def customer_segments(customers: DataFrame) -> DataFrame:
    """Quadrants at the medians of revenue and rating; customers missing either are left out."""
    rated = customers.where(F.col("revenue").isNotNull() & F.col("avg_rating").isNotNull())
    rich, happy = F.col("revenue") >= F.col("revenue_threshold"), F.col("avg_rating") >= F.col("rating_threshold")
    segment = (
        F.when(rich & happy, SEGMENTS[0]).when(rich, SEGMENTS[1]).when(happy, SEGMENTS[2]).otherwise(SEGMENTS[3])
    )
    return with_scalars(rated, _thresholds(rated)).select(
        "customer_id",
        "name",
        "revenue",
        "avg_rating",
        "revenue_threshold",
        "rating_threshold",
        segment.alias("segment"),
    )


def segment_profile(segments: DataFrame, top: int = 3) -> DataFrame:
    """Per segment: size, mean revenue and rating, and the customers with most revenue."""
    exact = segments.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum(F.col("revenue").cast("decimal(28,2)")).alias("r"),
        F.sum(F.col("avg_rating").cast("decimal(28,2)")).alias("a"),
    )
    order = Window.partitionBy("segment").orderBy(F.desc("revenue"), "customer_id")
    best = segments.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    leaders = best.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l"))
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    limits = segments.agg(
        F.max("revenue_threshold").alias("revenue_threshold"), F.max("rating_threshold").alias("rating_threshold")
    )
    every = limits.select(F.explode(names).alias("segment"), "revenue_threshold", "rating_threshold")
    return every.join(exact, "segment", "left").join(leaders, "segment", "left").select(
        "segment",
        F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce(mean2(F.col("r"), F.col("customers")).cast("double"), F.lit(0.0)).alias("mean_revenue"),
        F.coalesce(mean2(F.col("a"), F.col("customers")).cast("double"), F.lit(0.0)).alias("mean_rating"),
        F.coalesce(F.array_join("l.name", ", "), F.lit("")).alias("top_customers"),
        _two(F.col("revenue_threshold")).alias("revenue_threshold"),
        _two(F.col("rating_threshold")).alias("rating_threshold"),
    )


_FIFTHS = {"e0": 0.0, "e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8, "e5": 1.0}


def _quintile(value: Column, prefix: str) -> Column:
    """1 plus the inner edges below the value; edges that coincide count once."""
    low, high = F.col(f"{prefix}e0"), F.col(f"{prefix}e5")
    edges = F.array_distinct(F.array(*[F.col(f"{prefix}e{i}") for i in range(1, 5)]))
    inner = F.filter(edges, lambda e: (e > low) & (e < high))
    return F.size(F.filter(inner, lambda e: e < value)) + 1


def rfm_scores(customers: DataFrame) -> DataFrame:
    """Quintile scores of orders and revenue, their mean and the resulting profile."""
    known = customers.where(F.col("orders").isNotNull() & F.col("revenue").isNotNull())
    wanted = {f"f{e}": ("orders", p) for e, p in _FIFTHS.items()} | {f"m{e}": ("revenue", p) for e, p in _FIFTHS.items()}
    scored = with_scalars(known, quantile_row(known, wanted)).select(
        "customer_id",
        "orders",
        "revenue",
        _quintile(F.col("orders").cast("double"), "f").cast("long").alias("f_score"),
        _quintile(F.col("revenue"), "m").cast("long").alias("m_score"),
    )
    scored = scored.withColumn("rfm", (F.col("f_score") + F.col("m_score")) / F.lit(2.0))
    profile = None
    for name, floor in PROFILES:
        hit = F.col("rfm") >= floor
        profile = F.when(hit, name) if profile is None else profile.when(hit, name)
    return scored.withColumn("profile", profile.otherwise(LAST_PROFILE))


def rfm_profile(scores: DataFrame) -> DataFrame:
    sums = scores.groupBy("profile").agg(
        F.count("*").alias("customers"), F.sum(F.col("revenue").cast("decimal(28,2)")).alias("r")
    )
    return sums.select("profile", "customers", mean2(F.col("r"), F.col("customers")).cast("double").alias("mean_revenue"))


def _normalized(column: str) -> Column:
    value, low, high = F.col(column).cast("double"), F.col(f"{column}_lo"), F.col(f"{column}_hi")
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.5)


def product_score(kpi: DataFrame) -> DataFrame:
    """Weighted min-max score of reviewed products and its rank, ties at their mean rank.

    The rank is taken over the distinct scores, of which there are at most 1,001.
    """
    reviewed = kpi.where(F.col("reviews") > 0)
    spans = reviewed.agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}_lo") for c in SCORE_WEIGHTS],
        *[F.max(F.col(c).cast("double")).alias(f"{c}_hi") for c in SCORE_WEIGHTS],
    )
    w = SCORE_WEIGHTS
    total = (
        w["revenue"] * _normalized("revenue")
        + w["avg_rating"] * _normalized("avg_rating")
        + w["quantity"] * _normalized("quantity")
        + w["negative"] * (1 - _normalized("negative"))
    )
    score = F.round(total.cast("decimal(20,12)"), 3)
    scored = with_scalars(reviewed, spans).select("product_id", "product_name", "category", score.alias("score"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = scored.groupBy("score").agg(F.count("*").alias("ties"))
    ranks = ranks.withColumn("before", F.coalesce(F.sum("ties").over(above), F.lit(0)))
    place = F.floor(F.col("before") + (F.col("ties") + 1) / F.lit(2.0))
    ranks = ranks.select(F.col("score").alias("s"), place.cast("long").alias("rank"))
    return scored.join(F.broadcast(ranks), F.col("score").eqNullSafe(F.col("s"))).select(
        "product_id", "product_name", "category", F.col("score").cast("double").alias("score"), "rank"
    )


def radar_metrics(kpi: DataFrame) -> DataFrame:
    """Each metric as a share of its maximum; 0 when the maximum is not positive."""
    tops = kpi.agg(*[F.max(F.col(c).cast("double")).alias(f"{c}_top") for c in RADAR_METRICS])

    def share(c: str) -> Column:
        top = F.col(f"{c}_top")
        ratio = F.col(c).cast("double") / F.when(top > 0, top)
        return F.when(top > 0, F.round(ratio.cast("decimal(20,12)"), 4).cast("double")).otherwise(0.0).alias(c)

    return with_scalars(kpi, tops).select("product_id", *[share(c) for c in RADAR_METRICS])


# Rows needed for clusters, rows per cluster, fewest and most clusters.
MIN_CLUSTER_ROWS, ROWS_PER_CLUSTER, FEWEST, MOST = 5, 20, 2, 4


class Clusters:
    """K-means on standardised columns: labelled rows, profile and importance.

    Without ``k`` there is a cluster per 20 rows, at least 2 and at most 4. Fewer than
    five complete rows are not divided: they come back with a null cluster.
    """

    def __init__(self, rows: DataFrame, key: str, columns: Sequence[str], k: int | None = None, seed: int = 42):
        self.key, self.columns = key, list(columns)
        complete = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
        complete = materialize(complete, "cluster-input")
        count = complete.count()
        self.k = k or min(MOST, max(FEWEST, count // ROWS_PER_CLUSTER))
        if count < MIN_CLUSTER_ROWS:
            self.k, self.model = 0, None
            self.labelled = complete.withColumn("cluster", F.lit(None).cast("int"))
            return
        assembled = VectorAssembler(inputCols=self.columns, outputCol="raw").transform(complete)
        self.scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
        scaled = self.scaler.transform(assembled)
        self.model = KMeans(k=self.k, seed=seed).fit(scaled)
        self.labelled = self.model.transform(scaled).select(key, *self.columns, F.col("prediction").alias("cluster"))

    def profile(self) -> DataFrame:
        means = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in self.columns]
        return self.labelled.groupBy("cluster").agg(F.count("*").alias("rows"), *means)

    def importance(self) -> DataFrame:
        """Spread of the cluster centres per column, in the column's own unit; no rows without clusters."""
        spark = self.labelled.sparkSession
        if self.model is None:
            return spark.createDataFrame([], "column string, dispersion double")
        centres = [
            [float(c * s + m) for c, s, m in zip(centre, self.scaler.std, self.scaler.mean)]
            for centre in self.model.clusterCenters()
        ]
        table = spark.createDataFrame(centres, ", ".join(f"`{c}` double" for c in self.columns))
        spread = table.agg(*[F.round(F.stddev_samp(c), 2).alias(c) for c in self.columns])
        return spread.unpivot([], self.columns, "column", "dispersion").orderBy(F.desc("dispersion"), "column")


