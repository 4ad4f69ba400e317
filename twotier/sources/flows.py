"""Flow sources: raw record files (SRC1, SRC4) and the derived test fixture.

The fixture maps ``lineitem`` onto the flow-record shape so every operator can
be exercised on tables that grow with the scale factor.  The Spark expression
and the oracle SQL text below describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import flow_schema

NUMERIC = ["src_bytes", "count", "serror_rate", "rerror_rate", "logged_in", "urgent"]
CATEGORICAL = ["protocol_type", "service", "flag"]
FLOW_COLUMNS = ["flow_id", *CATEGORICAL, *NUMERIC, "label", "s1", "s2"]
L1_SCORE_CUT = 0.88

# Same rows as ``flows()``; DuckDB and Spark both accept this text.
FLOWS_SQL = """select
  md5(concat('flow:', cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
             cast(l_linenumber as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string))) as flow_id,
  l_returnflag as protocol_type,
  concat('svc', cast(l_linenumber as string)) as service,
  l_linestatus as flag,
  l_extendedprice as src_bytes,
  l_quantity as count,
  l_discount as serror_rate,
  l_tax as rerror_rate,
  case when l_linestatus = 'F' then 1e0 else 0e0 end as logged_in,
  0e0 as urgent,
  case when l_quantity >= 49 and l_discount >= 9e-2 then 'rootkit'
       when l_quantity >= 47 and l_tax >= 7e-2 then 'guess_passwd'
       when l_extendedprice >= 95000 then 'neptune'
       when l_extendedprice >= 88000 then 'smurf'
       when l_discount <= 2e-3 and l_returnflag = 'R' then 'portsweep'
       when l_discount <= 2e-3 then 'satan'
       else 'normal' end as label,
  least(1e0, l_extendedprice / 1e5) as s1,
  least(1e0, 6e-1 * l_quantity / 50e0 + 2e0 * l_discount + 25e-1 * l_tax) as s2
from lineitem"""


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def lineitem_to_flows(li: DataFrame) -> DataFrame:
    """Column expressions only: works on batch and streaming frames alike."""
    q, d, t, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    flow_id = F.md5(F.concat(
        F.lit("flow:"), _s("l_orderkey"), F.lit("-"), _s("l_partkey"), F.lit("-"),
        _s("l_suppkey"), F.lit("-"), _s("l_linenumber"), F.lit("-"),
        F.round(p * F.lit(100.0)).cast("bigint").cast("string"),
    ))
    label = (
        F.when((q >= 49) & (d >= F.lit(9e-2)), "rootkit")
        .when((q >= 47) & (t >= F.lit(7e-2)), "guess_passwd")
        .when(p >= 95000, "neptune")
        .when(p >= 88000, "smurf")
        .when((d <= F.lit(2e-3)) & (F.col("l_returnflag") == "R"), "portsweep")
        .when(d <= F.lit(2e-3), "satan")
        .otherwise("normal")
    )
    s2 = F.least(F.lit(1.0), F.lit(0.6) * q / F.lit(50.0) + F.lit(2.0) * d + F.lit(2.5) * t)
    return li.select(
        flow_id.alias("flow_id"),
        F.col("l_returnflag").alias("protocol_type"),
        F.concat(F.lit("svc"), _s("l_linenumber")).alias("service"),
        F.col("l_linestatus").alias("flag"),
        p.alias("src_bytes"),
        q.alias("count"),
        d.alias("serror_rate"),
        t.alias("rerror_rate"),
        F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.lit(0.0)).alias("logged_in"),
        F.lit(0.0).alias("urgent"),
        label.alias("label"),
        F.least(F.lit(1.0), p / F.lit(1e5)).alias("s1"),
        s2.alias("s2"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main fixture: one flow per lineitem row (whole table)."""
    return lineitem_to_flows(load_table(spark, sf_dir, "lineitem"))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless raw record CSV (SRC1): explicit schema, leading blanks
    stripped, trailing difficulty and the always-empty ``num_outbound_cmds``
    dropped."""
    return (
        spark.read.schema(flow_schema(with_difficulty=True))
        .option("ignoreLeadingWhiteSpace", True)
        .option("header", False)
        .csv(path)
        .drop("difficulty", "num_outbound_cmds")
    )


def read_headered(spark: SparkSession, path: str, schema) -> DataFrame:
    """Re-exported dataset with a header row (SRC4); schema is never inferred."""
    return spark.read.option("header", True).schema(schema).csv(path)
