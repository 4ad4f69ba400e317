"""Aggregations and evaluation metrics (AGG1-AGG17, STR6 batch form).

Everything is a grouped aggregate with partial (map-side) aggregation; no
global window is used: ordered scans go through ``functions.scan``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import (confusion_aggs, count_if, mcc_column, r6, rate_columns,
                               ratio_or_null, snapshot_metric_columns)
from ..functions.scan import (buckets_for_rows, digits_for_rows, hash_prefix_bucket, prefix_sums,
                              quantile_buckets)
from ..session import shared_path, written
from ..sources import taxonomy as tx


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG1: counts by value, descending (value breaks ties)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)))


def class_histogram(df: DataFrame, col: str = "attack_class") -> DataFrame:
    """AGG2: class counts, zero bars included (left join from the class list,
    which is a fixed 5-row dimension)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    classes = tx.classes_frame(df.sparkSession).select(F.col("attack_class").alias(col))
    return (classes.join(counts, col, "left")
            .select(col, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """AGG3: tn, fp, fn, tp in one pass, optionally per segment/run."""
    return df.groupBy(*(by or [])).agg(*confusion_aggs(y, pred))


def rates(conf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """AGG4 over AGG3 output."""
    return conf.select(*(keep or []), "tn", "fp", "fn", "tp", *rate_columns())


def with_mcc(conf: DataFrame) -> DataFrame:
    """AGG5."""
    return conf.withColumn("mcc", r6(mcc_column()))


def snapshot_metrics(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """AGG6 over (tp, fp, tn, fn) rows."""
    return counts.select(*(keep or []), *snapshot_metric_columns())


def counts_all_layers(long_counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG17: one outcome summed over both layers."""
    return long_counts.groupBy(*(by or []), "outcome").agg(F.sum("n").cast("bigint").alias("n"))


def detection_rate_by_class(df: DataFrame, pred: str = "pred", cls: str = "attack_class") -> DataFrame:
    """AGG10: detected / total per attack class (normal excluded)."""
    return (df.where(F.col(cls) != "normal").groupBy(cls).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col(pred)).cast("bigint").alias("detected"),
    ).withColumn("ratio", r6(ratio_or_null("detected", "total"))))


def detection_rate_seen_unseen(test: DataFrame, train: DataFrame, pred: str = "pred",
                               label: str = "label") -> DataFrame:
    """AGG11: unseen = attack labels of test absent from train.

    The rows are counted per label before the join, so one row per distinct
    label moves, however many rows a label has.
    """
    train_labels = train.select(label).distinct().withColumn("_seen", F.lit(1))
    counts = test.where(F.col(label) != "normal").groupBy(label).agg(
        F.count(F.lit(1)).alias("_total"), F.sum(F.col(pred)).alias("_detected"))
    flagged = counts.join(train_labels, label, "left").withColumn(
        "seen", F.when(F.col("_seen") == 1, F.lit("seen")).otherwise(F.lit("unseen")))
    return flagged.groupBy("seen").agg(
        F.sum("_total").alias("total"),
        F.sum("_detected").cast("bigint").alias("detected"),
    ).withColumn("ratio", r6(ratio_or_null("detected", "total")))


def average_runs(metrics: DataFrame, metric_cols: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG12: mean of each metric over runs (rows carry ``run_id``)."""
    return metrics.groupBy(*(by or [])).agg(
        F.countDistinct("run_id").alias("runs"),
        *[r6(F.avg(c)).alias(f"avg_{c}") for c in metric_cols])


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """AGG14: total / (2 * class count) per target value."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # the total is one row, so this product with it has one row per target value
    return (counts.withColumn("_k", F.lit(1))
            .join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
            .select(y, "n", r6(F.col("total") / (F.lit(2.0) * F.col("n"))).alias("weight")))


def dataset_profile(df: DataFrame, name: str) -> DataFrame:
    """AGG15 / AGG16: column count, names, row count."""
    cols = df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("dataset"),
        F.lit(len(cols)).cast("int").alias("n_columns"),
        F.lit(",".join(cols)).alias("column_names"),
        F.col("n_rows"),
    )


def profile_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """AGG15: changed if any of column count, names, row count differ."""
    o = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns])
    j = o.join(new, o.old_dataset == new.dataset, "full_outer")
    return j.select(
        F.coalesce("dataset", "old_dataset").alias("dataset"), "old_n_rows", "n_rows",
        (~(F.col("old_n_columns").eqNullSafe(F.col("n_columns"))
           & F.col("old_column_names").eqNullSafe(F.col("column_names"))
           & F.col("old_n_rows").eqNullSafe(F.col("n_rows")))).cast("int").alias("changed"))


class ProfileStore:
    """AGG15: the profiles of earlier runs, a partition per run that is never changed."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "profiles")

    def last(self, before: int) -> DataFrame:
        """The latest stored profile of each dataset from runs before ``before``."""
        schema = "dataset string, n_columns int, column_names string, n_rows bigint, run int"
        try:
            stored = self.spark.read.schema(schema).parquet(self.path).where(F.col("run") < before)
        except AnalysisException:  # the first run
            stored = self.spark.createDataFrame([], schema)
        fields = F.struct("n_columns", "column_names", "n_rows")
        return stored.groupBy("dataset").agg(F.max_by(fields, "run").alias("p")).select("dataset", "p.*")

    def changes(self, frames: dict[str, DataFrame], run: int) -> DataFrame:
        """Profiles the datasets, stores them as ``run`` and compares them with the last run's;
        a dataset that is new or gone has changed."""
        new = None
        for name, df in frames.items():
            row = dataset_profile(df, name)
            new = row if new is None else new.union(row)
        new.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        stored = self.spark.read.parquet(f"{self.path}/run={run}")
        return profile_changed(self.last(run), stored)


def _score_table(df: DataFrame, score: str, y: str, bin_digits: int | None):
    """Counts per distinct (optionally binned) score, sized for the scan."""
    s = F.col(score) if bin_digits is None else F.round(F.col(score), bin_digits)
    per = df.groupBy(s.alias("threshold")).agg(
        count_if(F.col(y) == 1).alias("pos"), count_if(F.col(y) == 0).alias("neg"))
    per = written(per.withColumn("_neg_t", -F.col("threshold")), "scores")
    n_buckets = buckets_for_rows(per.count())
    return quantile_buckets(per, "_neg_t", n_buckets, out="_bucket"), n_buckets


def roc_points(df: DataFrame, score: str, y: str, bin_digits: int | None = None) -> DataFrame:
    """AGG8: (threshold, fpr, tpr) for every distinct score, descending, plus
    the (0, 0) origin with a NULL threshold.

    Rows are first pre-aggregated by distinct score (partial aggregation), then
    the cumulative counts come from a bucketed two-level scan instead of one
    global window; the bucket count grows with the number of distinct scores
    (about 10^6 per bucket).  ``bin_digits`` rounds scores first (scale mode:
    at most 10^digits points).
    """
    per, nb = _score_table(df, score, y, bin_digits)
    cum = prefix_sums(per, ["_neg_t"], ["pos", "neg"], "_bucket", n_offsets=nb)
    totals = per.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N")) \
        .withColumn("_k", F.lit(1))
    pts = cum.withColumn("_k", F.lit(1)).join(F.broadcast(totals), "_k").select(
        "threshold",
        r6(ratio_or_null("cum_neg", "N")).alias("fpr"),
        r6(ratio_or_null("cum_pos", "P")).alias("tpr"))
    origin = totals.select(F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def auc(df: DataFrame, score: str, y: str, bin_digits: int | None = None) -> DataFrame:
    """AGG9: trapezoid area under the ROC.  Equivalent to
    sum_s neg_s * (pos_above_s + pos_s / 2) / (P * N) (ties averaged)."""
    per, nb = _score_table(df, score, y, bin_digits)
    cum = prefix_sums(per, ["_neg_t"], ["pos"], "_bucket", n_offsets=nb)
    area = cum.agg(
        F.sum(F.col("neg").cast("double") * ((F.col("cum_pos") - F.col("pos")).cast("double")
                                             + F.col("pos") / F.lit(2.0))).alias("_a"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return area.select(
        F.col("P").cast("bigint").alias("positives"), F.col("N").cast("bigint").alias("negatives"),
        r6(F.try_divide(F.col("_a"), F.col("P").cast("double") * F.col("N").cast("double"))).alias("auc"))


def metric_history(scored: DataFrame, tag: str = "tag", actual: str = "y_any",
                   seq: str = "flow_id") -> DataFrame:
    """STR6 (batch form): running TPR/FPR per layer after each counted sample,
    in ``seq`` order, emitted once all four counters of the layer are
    non-zero.  ``seq`` is an md5-hex key, so hash prefixes give balanced scan
    buckets; the prefix length grows with the row count (about 10^6 rows per
    bucket)."""
    t, a = F.col(tag), F.col(actual)
    l1 = scored.where(a.isNotNull()).select(
        F.lit(1).alias("layer"), F.col(seq).alias("seq"),
        ((t == "L1_ANOMALY") & (a == 1)).cast("int").alias("tp"),
        ((t == "L1_ANOMALY") & (a == 0)).cast("int").alias("fp"),
        ((t != "L1_ANOMALY") & (a == 0)).cast("int").alias("tn"),
        ((t != "L1_ANOMALY") & (a == 1)).cast("int").alias("fn"))
    l2 = scored.where(a.isNotNull() & t.isin("L2_ANOMALY", "NOT_ANOMALY2")).select(
        F.lit(2).alias("layer"), F.col(seq).alias("seq"),
        ((t == "L2_ANOMALY") & (a == 1)).cast("int").alias("tp"),
        ((t == "L2_ANOMALY") & (a == 0)).cast("int").alias("fp"),
        ((t == "NOT_ANOMALY2") & (a == 0)).cast("int").alias("tn"),
        ((t == "NOT_ANOMALY2") & (a == 1)).cast("int").alias("fn"))
    digits = digits_for_rows(scored.count())
    both = l1.unionByName(l2).withColumn("_bucket", hash_prefix_bucket("seq", digits))
    cum = prefix_sums(both, ["seq"], ["tp", "fp", "tn", "fn"], "_bucket", ["layer"],
                      n_offsets=2 * 16 ** digits)
    ctp, cfp, ctn, cfn = (F.col(f"cum_{c}") for c in ("tp", "fp", "tn", "fn"))
    ready = (ctp > 0) & (cfp > 0) & (ctn > 0) & (cfn > 0)
    return cum.where(ready).select(
        "layer", "seq",
        r6(ctp.cast("double") / (ctp + cfn)).alias("tpr"),
        r6(cfp.cast("double") / (cfp + ctn)).alias("fpr"))


def shape(df: DataFrame) -> tuple[int, int]:
    """AGG16 (driver-side scalar pair; one count job)."""
    return df.count(), len(df.columns)


def scored_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """AGG3 + AGG4 + AGG5 in one aggregate."""
    return with_mcc(rates(confusion(df, y, pred, by), keep=by))
