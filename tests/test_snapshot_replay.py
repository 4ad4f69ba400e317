"""External golden: confusion counts reconstructed from the reference's
recorded performance log, replayed through the online snapshot metrics
(AGG6), must give the logged values (4 decimals as logged)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twotier.operators import metrics as mt

# (layer, tp, fp, tn, fn) -> logged accuracy, precision, tpr, fpr, fscore [, tnr, fnr]
GOLDEN = [
    ((1, 7176, 441, 8849, 5077), (0.7439, 0.9421, 0.5857, 0.0475, 0.7223)),
    ((2, 1111, 60, 8735, 3532), (0.7327, 0.9488, 0.2393, 0.0068, 0.3822)),
    ((1, 7504, 625, 12208, 5328), (0.7680, 0.9231, 0.5848, 0.0487, 0.7160, 0.6962, 0.3038)),
    ((2, 1180, 80, 12061, 3690), (0.7784, 0.9365, 0.2423, 0.0066, 0.3850)),
]


def test_replay_matches_log(spark):
    rows = [g[0] for g in GOLDEN]
    counts = spark.createDataFrame(rows, "layer int, tp long, fp long, tn long, fn long")
    out = mt.snapshot_metrics(counts, keep=["layer", "tp"]).collect()
    by_key = {(r["layer"], r["tp"]): r for r in out}
    for (layer, tp, *_), logged in GOLDEN:
        r = by_key[(layer, tp)]
        got = (r["accuracy"], r["precision"], r["tpr"], r["fpr"], r["fscore"])
        for g, want in zip(got, logged[:5]):
            assert g == pytest.approx(want, abs=6e-5)
        if len(logged) > 5:  # the online tnr/fnr are NPV and false-omission rate
            assert r["tnr"] == pytest.approx(logged[5], abs=6e-5)
            assert r["fnr"] == pytest.approx(logged[6], abs=6e-5)


def test_quarantine_identity_of_log():
    # layer-1 negatives = layer-2 total + quarantined (525 at the last snapshot)
    l1_neg = 12208 + 5328
    l2_total = 1180 + 80 + 12061 + 3690
    assert l1_neg - l2_total == 525


def test_gate_zeros_until_all_counters_positive(spark):
    counts = spark.createDataFrame([(1, 5, 0, 7, 2)], "layer int, tp long, fp long, tn long, fn long")
    r = mt.snapshot_metrics(counts).first()
    assert all(r[k] == 0.0 for k in ("accuracy", "precision", "tpr", "fpr", "tnr", "fnr", "fscore"))
    assert F is not None
