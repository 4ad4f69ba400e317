"""Flow-record schema (SRC2) and per-layer feature lists.

The record layout is a fixed dictionary; Spark reads raw files with this
explicit StructType and never infers types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The 41 field names of a connection record, in file order,
# and their kind.  Symbolic fields are strings; every other field is numeric.
# ---------------------------------------------------------------------------
FIELD_NAMES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
SYMBOLIC = ["protocol_type", "service", "flag"]

# Layer feature lists selected offline (17 and 11 names).
FEATURES_L1 = [
    "logged_in", "count", "serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_srv_rerror_rate",
    "dst_host_rerror_rate",
]
FEATURES_L2 = [
    "srv_count", "urgent", "root_shell", "hot", "dst_host_srv_diff_host_rate",
    "dst_host_count", "logged_in", "dst_host_same_src_port_rate", "srv_diff_host_rate",
    "num_shells", "dst_host_srv_count",
]
# Detection thresholds of the online cascade.
ANOMALY_THRESHOLD2 = 0.8
BENIGN_THRESHOLD = 0.6
# ---------------------------------------------------------------------------


def kind_of(name: str) -> str:
    return "symbolic" if name in SYMBOLIC else "continuous"


def field_dictionary(spark: SparkSession) -> DataFrame:
    """(position, name, kind) rows of the record dictionary."""
    rows = [(i + 1, n, kind_of(n)) for i, n in enumerate(FIELD_NAMES)]
    return spark.createDataFrame(rows, "position int, name string, kind string")


def read_field_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Read a headerless ``name,kind`` CSV (SRC2) with trailing blanks trimmed."""
    return (
        spark.read.schema("name string, kind string")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def schema_from_dictionary(rows: list[tuple[str, str]], with_label: bool = True,
                           with_difficulty: bool = True) -> T.StructType:
    """StructType from (name, kind) pairs; the dictionary is 41 rows, so it is
    collected (bounded metadata, never row data)."""
    fields = [
        T.StructField(n, T.StringType() if k == "symbolic" else T.DoubleType(), True)
        for n, k in rows
    ]
    if with_label:
        fields.append(T.StructField("label", T.StringType(), True))
    if with_difficulty:
        fields.append(T.StructField("difficulty", T.DoubleType(), True))
    return T.StructType(fields)


def flow_schema(with_difficulty: bool = True) -> T.StructType:
    return schema_from_dictionary([(n, kind_of(n)) for n in FIELD_NAMES],
                                  with_difficulty=with_difficulty)


def loaded_flow_schema() -> T.StructType:
    """Schema after load: 40 features + label (no difficulty, no
    ``num_outbound_cmds``)."""
    return T.StructType([f for f in flow_schema(with_difficulty=False).fields
                         if f.name != "num_outbound_cmds"])


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Comma list (possibly written as ``a,\\nb``) -> one row per feature (SRC5)."""
    text = spark.read.option("wholetext", True).text(path)
    return (
        text.select(F.posexplode(F.split(F.col("value"), ",")).alias("position", "feature"))
        .select("position", F.trim(F.col("feature")).alias("feature"))
        .where(F.col("feature") != "")
    )
