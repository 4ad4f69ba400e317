"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on ordinary text and on what toxic text
has beyond it.  Every word of a text is a window: it is compressed with the ordinary
dictionary alone and with both, and the bytes that the toxic one saves are its
distance.  The distances of labelled windows give a log likelihood ratio for each
distance; a text's ratios, summed and as a share of its length, are calibrated into a
score by logistic regression on labelled texts.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, kept, map_rows, read, row_udf, sample_by_hash
from .words import shingle_hashes, word_hashes

QUERY = "op4_toxicity"
#: The classifier is fitted on about so many labelled documents of each class, chosen
#: by the hash of their id.
TRAIN_DOCS = 6000
ORDINARY_BYTES = 3000
ORDINARY_WINDOWS = 20_000
#: A toxic window stands in so many toxic texts at least, and so many times as often
#: there as in ordinary ones.
LEAST_TEXTS = 4
LEAST_LIFT = 60
#: Distances outside count as these.
LOW, HIGH = -8, 15
#: Common context that starts every window, so that short ones are compressed at all.
CONTEXT = 32
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]{1,64}")


def windows(text: str | None) -> list[str]:
    """The words of a text in lower case; longer ones in pieces of 64 letters."""
    return _WORD.findall(text.lower()) if text else []


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary, without the header and entropy tables
    before it; the samples themselves where they are too few to train."""
    joined = b"".join(samples)
    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        start = next(at for at in range(8, len(whole) - 12) if whole[at:at + 12] in joined)
    except (zstandard.ZstdError, StopIteration):
        return b"".join(dict.fromkeys(samples))[:size]
    return whole[start:]


def _repeated(counts: dict[str, int], most: int, draw: random.Random) -> list[bytes]:
    out = [f" {w} ".encode() for w, n in sorted(counts.items()) for _ in range(min(n, most))]
    draw.shuffle(out)
    return out


def train_dictionaries(toxic: dict[str, int], ordinary: dict[str, int]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from windows and their counts.  Training is
    repeated on the toxic windows that the dictionary does not hold yet."""
    draw = random.Random(7)
    base = _trained(_repeated(ordinary, 5, draw), ORDINARY_BYTES, 32)
    out, left = b"", dict(toxic)
    while left:
        samples = _repeated({w: max(n, 200 // len(left)) for w, n in left.items()}, 10_000, draw)
        out += _trained(samples, 300 + sum(len(w.encode()) + 2 for w in left), 24)
        rest = {w: n for w, n in left.items() if w.encode() not in out}
        if len(rest) == len(left):  # training leaves these out
            out += b"".join(f" {w} ".encode() for w in sorted(left))
            break
        left = rest
    return base, out


class Distance:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, base: bytes, toxic: bytes):
        self.context = base[-CONTEXT:]
        self.memo: dict[str, int] = {}
        self.plain, self.both = (self._compressor(d) for d in (base, base[:-CONTEXT] + toxic + self.context))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(
            window_log=14, chain_log=13, hash_log=12, search_log=6, min_match=3, target_length=64,
            strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=settings)

    def histogram(self, text: str | None) -> np.ndarray:
        """Number of windows at each distance from LOW to HIGH."""
        out = np.zeros(HIGH - LOW + 1, np.int64)
        for window, n in Counter(windows(text)).items():
            d = self.memo.get(window)
            if d is None:
                data = self.context + b" " + window.encode("utf-8", "surrogatepass") + b" "
                d = len(self.plain.compress(data)) - len(self.both.compress(data))
                d = self.memo[window] = min(max(d, LOW), HIGH) - LOW
            out[d] += n
        if len(self.memo) > MEMO:  # only a memo: nothing depends on what it holds
            self.memo.clear()
        return out


class Model:
    """Dictionaries, ratios and calibration.  Without both classes it answers with
    the share of toxic training texts, 0 without any."""

    def __init__(self, base: bytes = b"", toxic: bytes = b"", prior: float = 0.0):
        self.base, self.toxic, self.prior = base, toxic, prior
        self.ratios = np.zeros(HIGH - LOW + 1)
        self.mean = self.scale = self.weights = None

    def features(self, counts: np.ndarray) -> np.ndarray:
        """From histograms: the ratios' sum, their positive part by length and by its
        root, the largest distance, and the length."""
        n = counts.sum(axis=1)
        gain = counts @ np.maximum(self.ratios, 0)
        top = np.where(n > 0, (counts > 0).cumsum(axis=1).argmax(axis=1) + LOW, 0)
        return np.column_stack([np.sign(s := counts @ self.ratios) * np.log1p(np.abs(s)), gain / (n + 5),
                                gain / np.sqrt(n + 1), np.log1p(gain), top, np.log1p(n)])

    def calibrate(self, counts: np.ndarray, labels: np.ndarray) -> None:
        hot, cold = counts[labels == 1].sum(axis=0), counts[labels == 0].sum(axis=0)
        self.ratios = np.log((hot + 0.5) / (hot + 0.5).sum()) - np.log((cold + 0.5) / (cold + 0.5).sum())
        self.ratios[(hot + cold) < 5] = 0
        x = self.features(counts)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (labels - p) - 0.1 * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, counts: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        x = (self.features(counts[None, :])[0] - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents that are not held out."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = {k: totals.get(k, 0) for k in (0, 1)}
    if not all(sizes.values()):
        return Model(prior=float(bool(sizes[1])))
    chosen = sample_by_hash(known.where("toxic = 0"), "doc_id", train_docs, sizes[0]).union(
        sample_by_hash(known.where("toxic = 1"), "doc_id", train_docs, sizes[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * train_docs ids

    def keys():
        def work(ids, toxic, texts):
            hashes = [shingle_hashes(word_hashes(t)) for t in texts]
            return [ids, toxic, texts, [int((h >> np.uint64(1)).min()) if len(h) else 0 for h in hashes]]
        return work

    # near copies share the smallest shingle hash; one of them stands for all
    sample = kept(map_rows(sample, ["doc_id", "toxic", "text"], keys, "doc_id bigint, toxic int, text string, k bigint"),
                  "labelled")
    first = sample.groupBy("toxic", "k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    sample = kept(sample.join(first, ["doc_id", "toxic"]).select("toxic", "text"), "labelled")

    def counts():
        def work(toxic, texts):
            seen = Counter()
            for label, text in zip(toxic, texts):
                seen.update((label, w) for w in set(windows(text)))
            return [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
        return work

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = kept(map_rows(sample, ["toxic", "text"], counts, "toxic int, word string, n bigint").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("hot"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("cold")), "windows")
    lift = (F.col("hot") / n[1]) / ((F.col("cold") + 0.5) / n[0])
    toxic = {r["word"]: r["hot"] for r in found.where((F.col("hot") >= LEAST_TEXTS) & (lift >= LEAST_LIFT)).collect()}
    ordinary = {r["word"]: r["cold"] for r in found.where("cold > 0").orderBy(F.desc("cold"), "word")
                .limit(ORDINARY_WINDOWS).collect()}
    model = Model(*train_dictionaries(toxic, ordinary))

    def histograms():
        distance = Distance(model.base, model.toxic)

        def work(labels, texts):
            return [labels, [distance.histogram(t) for t in texts]]
        return work

    rows = map_rows(sample, ["toxic", "text"], histograms, "toxic int, counts array<bigint>").collect()  # the sample
    model.calibrate(np.array([r["counts"] for r in rows], float), np.array([r["toxic"] for r in rows], float))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher for likelier toxic) and predicted (1 from 0.5 on)
    of every row of ``docs``.

    Every whole text is read; a null or empty text or one without letters has no
    windows and gets the score of that.  Repeated rows and null ids are rows like
    others; an empty table gives an empty result.  Only the text is an input.  Where
    no text of one class is labelled, every score is 0 (no toxic ones) or 1.
    """
    def make():
        distance = Distance(model.base, model.toxic) if model.weights is not None else None
        return lambda text: model.score(distance.histogram(text)) if distance else model.prior

    return docs.select("doc_id", row_udf(docs.sparkSession, make, "double")("text").alias("score")).select(
        "doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
