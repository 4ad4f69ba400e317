"""Column expressions over confusion counts (AGG4, AGG5, AGG6, TUN3).

All are built-in JVM expressions, so they stay inside whole-stage codegen.
Zero-denominator policy: library-style rates return 0.0; per-class detection
ratios return NULL (see ``ratio_or_null``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return _c(x).cast("double")


def ratio_or_zero(num, den) -> Column:
    """num/den, 0.0 when den is 0 (ANSI-safe: try_divide never raises)."""
    return F.coalesce(F.try_divide(dbl(num), dbl(den)), F.lit(0.0))


def ratio_or_null(num, den) -> Column:
    return F.try_divide(dbl(num), dbl(den))


def r6(x) -> Column:
    """Round an aggregated double to 6 places (comparison convention)."""
    return F.round(_c(x), 6)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def confusion_aggs(y: str | Column, pred: str | Column) -> list[Column]:
    """AGG3: tn, fp, fn, tp in one pass (rows with NULL actual count nowhere)."""
    y, pred = _c(y), _c(pred)
    return [
        count_if((y == 0) & (pred == 0)).alias("tn"),
        count_if((y == 0) & (pred == 1)).alias("fp"),
        count_if((y == 1) & (pred == 0)).alias("fn"),
        count_if((y == 1) & (pred == 1)).alias("tp"),
    ]


def rate_columns(tp="tp", fp="fp", tn="tn", fn="fn", rounded: bool = True) -> list[Column]:
    """AGG4: library-style rates; TNR = tn/(tn+fp), FNR = fn/(fn+tp)."""
    tp, fp, tn, fn = _c(tp), _c(fp), _c(tn), _c(fn)
    rnd = r6 if rounded else (lambda c: c)
    return [
        rnd(ratio_or_zero(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        rnd(ratio_or_zero(tp, tp + fp)).alias("precision"),
        rnd(ratio_or_zero(tp, tp + fn)).alias("recall"),
        rnd(ratio_or_zero(F.lit(2) * tp, F.lit(2) * tp + fp + fn)).alias("f1"),
        rnd(ratio_or_zero(tn, tn + fp)).alias("tnr"),
        rnd(ratio_or_zero(fp, fp + tn)).alias("fpr"),
        rnd(ratio_or_zero(fn, fn + tp)).alias("fnr"),
    ]


def mcc_column(tp="tp", fp="fp", tn="tn", fn="fn") -> Column:
    """AGG5: Matthews correlation, 0 when the denominator is 0."""
    tp, fp, tn, fn = dbl(tp), dbl(fp), dbl(tn), dbl(fn)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio_or_zero(tp * tn - fp * fn, den)


def snapshot_metric_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> list[Column]:
    """AGG6: the online variant.  ``tnr`` is tn/(tn+fn) and ``fnr`` is
    fn/(tn+fn) (really NPV and false-omission rate).  All zeros until every
    counter is non-zero."""
    tp, fp, tn, fn = dbl(tp), dbl(fp), dbl(tn), dbl(fn)
    ready = (tp > 0) & (fp > 0) & (tn > 0) & (fn > 0)
    tpr = tp / (tp + fn)
    prec = tp / (tp + fp)
    vals = {
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "precision": prec,
        "tpr": tpr,
        "fpr": fp / (fp + tn),
        "tnr": tn / (tn + fn),
        "fnr": fn / (tn + fn),
        "fscore": F.lit(2.0) * (prec * tpr) / (prec + tpr),
    }
    return [r6(F.when(ready, v).otherwise(F.lit(0.0))).alias(k) for k, v in vals.items()]


SNAPSHOT_METRICS = ["accuracy", "precision", "tpr", "fpr", "tnr", "fnr", "fscore"]


def objective_value(name: str, tp="tp", fp="fp", tn="tn", fn="fn",
                    mode: str = "reference") -> Column:
    """TUN3: every objective is maximised.  Error rates are inverted
    (1/rate, 0 when the rate is 0) in ``reference`` mode, or ``1 - rate`` in
    ``corrected`` mode."""
    tp, fp, tn, fn = dbl(tp), dbl(fp), dbl(tn), dbl(fn)
    rates = {
        "tpr": ratio_or_zero(tp, tp + fn),
        "tnr": ratio_or_zero(tn, tn + fp),
        "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
        "precision": ratio_or_zero(tp, tp + fp),
        "fpr": ratio_or_zero(fp, fp + tn),
        "fnr": ratio_or_zero(fn, fn + tp),
    }
    r = rates[name]
    if name in ("fpr", "fnr"):
        if mode == "reference":
            return ratio_or_zero(F.lit(1.0), r)
        return F.lit(1.0) - r
    return r
