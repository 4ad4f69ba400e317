"""Raw sources and sinks: field dictionary, feature lists, headerless CSV."""

from __future__ import annotations

import os
import tempfile

from twotier.sources import schema as sc
from twotier.sources.flows import read_flows


def _tmp():
    return tempfile.mkdtemp(prefix="twotier-test-")


def test_field_dictionary_to_schema(spark):
    d = _tmp()
    with open(os.path.join(d, "fields.csv"), "w") as f:
        for n in sc.FIELD_NAMES:
            f.write(f"{n},{sc.kind_of(n)}  \n")
    rows = [(r["name"], r["kind"]) for r in sc.read_field_dictionary(spark, d).collect()]
    assert len(rows) == 41 and rows[1] == ("protocol_type", "symbolic")
    schema = sc.schema_from_dictionary(rows)
    assert schema == sc.flow_schema()


def test_feature_list_written_with_newlines(spark):
    d = _tmp()
    with open(os.path.join(d, "l1.txt"), "w") as f:
        f.write(",\n".join(sc.FEATURES_L1))
    got = [r["feature"] for r in sc.read_feature_list(spark, d).orderBy("position").collect()]
    assert got == sc.FEATURES_L1


def test_read_flows_headerless_with_blanks(spark):
    d = _tmp()
    vals = []
    for n in sc.FIELD_NAMES:
        vals.append({"protocol_type": "tcp", "service": "http", "flag": "SF"}.get(n, "1"))
    line = ", ".join(vals + ["neptune", "21"])
    with open(os.path.join(d, "raw.txt"), "w") as f:
        f.write(line + "\n" + line.replace("neptune", "normal") + "\n")
    df = read_flows(spark, d)
    assert len(df.columns) == 41 and "num_outbound_cmds" not in df.columns
    r = df.orderBy("label").first()
    assert r["protocol_type"] == "tcp" and r["src_bytes"] == 1.0 and r["label"] == "neptune"
