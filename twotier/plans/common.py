"""Shared plan pieces: labelled and scored flows, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import cascade as cas
from ..operators import labels as lb
from ..sources.flows import flows, lineitem_to_flows

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query with its DuckDB oracle text (None = no oracle)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def labelled_flows(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """flows + attack_class + binary targets (narrow projections only), of the whole table or of
    the given part of it."""
    f = (flows(spark, sf_dir) if lineitem is None else lineitem_to_flows(lineitem)).withColumn("attack_class", lb.class_expr())
    return lb.binary_targets(f)


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled flows + rule scores + cascade tag (CAS1) + offline pred (CAS2)."""
    f = cas.rule_scores(labelled_flows(spark, sf_dir))
    return cas.cascade_offline(cas.cascade_online(f))
