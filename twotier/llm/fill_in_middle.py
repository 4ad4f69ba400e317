"""Fill-in-the-middle transformation over a learned rank index.

Texts are cut at code points but stored as UTF-8, so a cut needs the byte offset of a
code point.  Each text gets a rank index: piecewise-linear segments, fitted to the offsets
of all its code-point boundaries within a fixed error, predict the offset of a rank, and
the stored residual of that rank (one byte each) makes it exact.  A text of ASCII letters
is one segment.  Only the two offsets come back from Python; the JVM cuts the bytes and
joins the pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, row_udf

QUERY = "op11_fill_in_middle"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Largest distance of a segment from a boundary offset; residuals fit into one byte.
ERROR = 63
#: Boundaries looked at in one step of a fit, at first and at most.
FIRST_STEP, LAST_STEP = 256, 1 << 20


def boundaries(data: bytes) -> np.ndarray:
    """Byte offsets of all code-point boundaries of UTF-8 ``data``, its end included."""
    unit = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((unit & 0xC0) != 0x80), len(unit)).astype(np.int32 if len(unit) < 2**31 else np.int64)


class RankIndex:
    """Offset of each rank of a sorted array of offsets: segments and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, base, slope = [], [], []
        self.residuals = np.zeros(len(offsets), np.int8)
        at = 0
        while at < len(offsets):
            end, steep = _segment(offsets, at, error)
            first.append(at)
            base.append(int(offsets[at]))
            slope.append(steep)
            for lo in range(at, end, LAST_STEP):
                hi = min(end, lo + LAST_STEP)
                guess = base[-1] + np.rint(steep * np.arange(lo - at, hi - at)).astype(np.int64)
                self.residuals[lo:hi] = offsets[lo:hi] - guess
            at = end
        self.first, self.base, self.slope = np.array(first, np.int64), np.array(base, np.int64), np.array(slope)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets by the segments alone."""
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets."""
        return self.predicted(ranks) + self.residuals[ranks]


def _segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """End and slope of the longest segment from (at, offsets[at]) that stays within
    ``error`` of the offsets: the cone of slopes narrows until it is empty."""
    low, high, end, step = -np.inf, np.inf, at + 1, FIRST_STEP
    while end < len(offsets):
        stop = min(len(offsets), end + step)
        run = np.arange(end - at, stop - at)
        rise = offsets[end:stop].astype(np.int64) - int(offsets[at])
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        closed = lows > highs
        k = int(closed.argmax()) if closed.any() else len(run)
        if k:
            low, high = lows[k - 1], highs[k - 1]
        end += k
        if k < len(run):
            break
        step = min(2 * step, LAST_STEP)
    return end, (low + high) / 2 if end > at + 1 else 0.0


def byte_cuts(spark: SparkSession, text: Column, *ranks: Column) -> Column:
    """The byte offsets (an array) of the given code-point ranks of ``text``; null for a
    null text."""
    def make():
        def cut(data, *at):
            if data is None:
                return None
            return RankIndex(boundaries(data)).offsets(np.array(at, np.int64)).tolist()
        return cut

    return row_udf(spark, make, "array<bigint>")(text.cast("binary"), *ranks)


def _draw(n: int, seed: int) -> Column:
    """The n-th 8-digit group of the hex sha256 of ``seed:doc_id`` (a null id is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (code points), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and output (the transformed text).

    The cuts are drawn from the hash of (seed, doc_id), so rows that repeat an id are cut
    by the same draws; a null id is hashed as an empty one.  A null text is an empty one;
    empty texts and texts that hold a sentinel stay plain.  Equal cuts give empty pieces.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text").cast("bigint")
    sentinel = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        sentinel |= F.contains("text", F.lit(mark))
    rows = rows.select(
        "doc_id", "text", n.alias("n"),
        F.when((n == 0) | sentinel | (_draw(3, seed) % 100 >= 100 - plain_percent), "plain")
        .when(_draw(4, seed) % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        F.pmod(_draw(1, seed), n + 1).alias("x"), F.pmod(_draw(2, seed), n + 1).alias("y"))
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    at = byte_cuts(docs.sparkSession, F.when(cut, F.col("text")), F.col("a"), F.col("b"))
    rows = rows.withColumn("at", at)
    data, first, second = F.col("text").cast("binary"), F.col("at")[0].cast("int"), F.col("at")[1].cast("int")
    prefix = F.substr(data, F.lit(1), first)
    middle = F.substr(data, first + 1, second - first)
    suffix = F.substr(data, second + 1, F.octet_length("text") - second)
    mark = {m: F.lit(m).cast("binary") for m in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    return rows.select(
        "doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"),
        F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(data).cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        # the text holds no sentinel and a sentinel begins nowhere inside itself: each first find is the real one
        a, b = F.locate(second, output), F.locate(MIDDLE, output)
        skip = len(first)
        return (F.substr(output, F.lit(skip + 1), a - skip - 1), F.substr(output, a + len(second), b - a - len(second)),
                F.substr(output, b + len(MIDDLE)))

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as s from documents),
h as (select doc_id, t, length(t) as n, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2,
        cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as x, substring(t, a + 1, b - a) as y, substring(t, b + 1, n - b) as z from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y
         else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
