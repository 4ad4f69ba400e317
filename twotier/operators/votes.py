"""Soft and hard votes over fitted models of any kind (CLF5, CLF6).

Each voter gives one prepared row an array of class probabilities.  Votes are column
expressions over those arrays, so that any number of voters costs no shuffle.  On ties the
lowest class wins.  A voter without an answer (NULL) abstains; a row without voters has no vote.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_probabilities(df: DataFrame, models: dict[str, PipelineModel | Column]) -> DataFrame:
    """``df`` with one array column ``p_<name>`` per voter: a fitted ML pipeline over df's
    feature vector, or a column of the positive class's probability."""
    columns = list(df.columns)
    for name, model in models.items():
        if isinstance(model, Column):
            df = df.withColumn(f"p_{name}", F.when(model.isNotNull(), F.array(1.0 - model, model)))
        else:
            df = model.transform(df).select(*columns, vector_to_array("probability").alias(f"p_{name}"))
        columns.append(f"p_{name}")
    return df


def first_largest(values: Column) -> Column:
    """The index (from 0) of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def soft_vote(probabilities: list[Column], classes: int, weights: list[float] | None = None) -> Column:
    """The mean class probabilities of the voters, NULL where none answers."""
    weights = weights or [1.0] * len(probabilities)
    weight = _total([F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in zip(probabilities, weights)])
    sums = [_total([F.coalesce(p[k] * w, F.lit(0.0)) for p, w in zip(probabilities, weights)]) for k in range(classes)]
    return F.when(weight > 0, F.array(*[s / weight for s in sums]))


def hard_vote(predictions: list[Column], classes: int, weights: list[float] | None = None) -> Column:
    """The votes of each class, NULL where no voter answers."""
    weights = weights or [1.0] * len(predictions)
    any_vote = F.coalesce(*predictions).isNotNull()
    return F.when(any_vote, F.array(*[
        _total([F.when(p == k, F.lit(w)).otherwise(0.0) for p, w in zip(predictions, weights)]) for k in range(classes)]))


def voted(df: DataFrame, names: list[str], kind: str = "soft", classes: int = 2, out: str = "vote") -> DataFrame:
    """``df`` with the class that the voters ``p_<name>`` elect."""
    arrays = [F.col(f"p_{n}") for n in names]
    votes = soft_vote(arrays, classes) if kind == "soft" else hard_vote([first_largest(a) for a in arrays], classes)
    return df.withColumn(out, first_largest(votes))
