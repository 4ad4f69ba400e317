"""Label taxonomy (SRC3) as a small dimension DataFrame.

The taxonomy is a fixed, bounded table (40 labels), so broadcasting it is
always safe regardless of the size of the flow table it is joined to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Attack taxonomy that results must agree with.
# Full lists (train + test labels) and the smaller train-only lists that the
# correlation-based feature selection uses.
# ---------------------------------------------------------------------------
DOS = ["back", "land", "neptune", "pod", "smurf", "teardrop", "worm", "apache2",
       "mailbomb", "processtable", "udpstorm"]
PROBE = ["ipsweep", "mscan", "nmap", "portsweep", "saint", "satan"]
R2L = ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster",
       "snmpguess", "spy", "warezclient", "httptunnel", "named", "sendmail",
       "snmpgetattack", "xlock", "xsnoop"]
U2R = ["buffer_overflow", "loadmodule", "perl", "ps", "rootkit", "sqlattack", "xterm"]

ICFS_DOS = ["back", "land", "neptune", "pod", "smurf", "teardrop"]
ICFS_PROBE = ["ipsweep", "portsweep", "satan", "nmap"]
ICFS_U2R = ["loadmodule", "perl", "rootkit", "buffer_overflow"]
ICFS_R2L = ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy",
            "warezclient", "warezmaster"]
# ---------------------------------------------------------------------------

CLASSES = ["dos", "probe", "r2l", "u2r", "normal"]
LAYER_OF_CLASS = {"dos": 1, "probe": 1, "r2l": 2, "u2r": 2, "normal": 0}
FULL = {"dos": DOS, "probe": PROBE, "r2l": R2L, "u2r": U2R}
ICFS = {"dos": ICFS_DOS, "probe": ICFS_PROBE, "r2l": ICFS_R2L, "u2r": ICFS_U2R}
L1_LABELS = DOS + PROBE
L2_LABELS = U2R + R2L

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("attack_class", T.StringType(), False),
    T.StructField("layer", T.IntegerType(), False),
    T.StructField("source", T.StringType(), False),
])


def taxonomy_rows(source: str = "full") -> list[tuple[str, str, int, str]]:
    lists = FULL if source == "full" else ICFS
    rows = []
    for cls in ("dos", "probe", "r2l", "u2r"):
        for label in lists[cls]:
            rows.append((label, cls, LAYER_OF_CLASS[cls], source))
    rows.append(("normal", "normal", 0, source))
    return rows


def read_taxonomy(spark: SparkSession, source: str = "full") -> DataFrame:
    """fine label -> class -> layer (SRC3)."""
    return spark.createDataFrame(taxonomy_rows(source), TAXONOMY_SCHEMA)


def classes_frame(spark: SparkSession) -> DataFrame:
    rows = [(c, LAYER_OF_CLASS[c]) for c in CLASSES]
    return spark.createDataFrame(rows, "attack_class string, layer int")


def taxonomy_values_sql(source: str = "full") -> str:
    """The same table as an inline VALUES list for the DuckDB oracle."""
    vals = ",\n    ".join(f"('{l}', '{c}', {n})" for l, c, n, _ in taxonomy_rows(source))
    return f"(values\n    {vals}) as tax(label, attack_class, layer)"


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)
