"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three
letters, words padded by a space) in rank order.  A document's own most frequent
n-grams are compared to each profile by the out-of-place distance: the sum of the
differences between ranks, the length of the profile for an n-gram that is absent
from it.  The smallest distance wins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, map_rows, read, row_udf

QUERY = "op1_language_id"
PROFILE = 400
UNDETERMINED = "und"
#: Profiles are counted over about so many labelled documents of each language,
#: chosen by hash.
TRAIN_DOCS = 3000
#: Profiles go with every task: so many languages are learned, those of the most labelled
#: documents (ties: first in the alphabet).  Documents of others get a learned one.
MAX_LANGUAGES = 2000
_TABLE = 0x3000
_LETTER = np.array([chr(c).isalpha() for c in range(_TABLE)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one
    space, a space at either end; empty if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[np.minimum(code, _TABLE - 1)]
    high = code >= _TABLE
    if high.any():
        found, back = np.unique(code[high], return_inverse=True)
        is_letter[high] = np.array([chr(c).isalpha() for c in found.tolist()])[back]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    padded = np.full(len(code) + 2, 32, np.int64)
    padded[1:-1][is_letter] = code[is_letter]
    keep = padded != 32
    keep[1:] |= keep[:-1]
    keep[0] = padded[1] != 32
    first = int(np.argmax(padded != 32))
    keep[first - 1] = True
    return padded[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as 63-bit codes, and their counts."""
    s = letters(text) if text else np.zeros(0, np.int64)
    if not len(s):
        return s, s
    pairs = s[:-1] << 21 | s[1:]
    codes = np.concatenate([s[s != 32], pairs, pairs[:-1] << 21 | s[2:]])
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes)))


class Profiles:
    """Rank-order profiles of the learned languages as one rank table."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(ranked)
        self.grams = np.unique(np.array([g for r in ranked.values() for g in r], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), size, np.int64)
        for n, lang in enumerate(self.langs):
            own = np.array(ranked[lang], np.int64)
            self.ranks[n, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 less the mean out-of-place distance as a
        share of the largest; ``und`` and 0 for a text without letters."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        top = np.lexsort((codes, -counts))[:self.size]
        own = codes[top]
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own
        rank = np.arange(len(own))
        apart = np.minimum(np.abs(self.ranks[:, at[known]] - rank[known]), self.size)
        apart[self.ranks[:, at[known]] == self.size] = self.size
        distance = apart.sum(axis=1) + self.size * int((~known).sum())
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE,
          max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Profiles from text and language of the documents that are not held out."""
    labelled = docs.where(~held_out()).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    ranked: dict[str, list[int]] = {}
    if counts:
        shares = docs.sparkSession.createDataFrame([(lang, min(1.0, train_docs / n)) for lang, n in counts.items()],
                                                   "lang string, share double")
        chosen = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1_000_000)) < F.col("share") * 1_000_000
        # one row a language
        sample = (labelled.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(chosen)
                  .select("lang", "text"))

        def make():
            def work(langs, texts):
                parts: dict[str, list] = {}
                for lang, text in zip(langs, texts):
                    parts.setdefault(lang, []).append(grams(text))
                out = [], [], []
                for lang, found in parts.items():
                    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    out[0].extend([lang] * len(codes))
                    out[1].extend(codes.tolist())
                    out[2].extend(np.bincount(back, np.concatenate([n for _, n in found])).astype(int).tolist())
                return list(out)
            return work

        counted = map_rows(sample, ["lang", "text"], make, "lang string, gram bigint, n bigint")
        ranked = {lang: [] for lang in counts}
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        top = (counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank)
               .where(F.col("rank") <= size).orderBy("lang", "rank"))
        for r in top.collect():  # at most ``size`` n-grams of each language
            ranked[r["lang"]].append(r["gram"])
    return Profiles({lang: r for lang, r in ranked.items() if r}, size)


def language(spark: SparkSession, profiles: Profiles) -> Callable[..., Column]:
    """A column function of a text: struct of lang_pred and score."""
    return row_udf(spark, lambda: profiles.predict, "struct<lang_pred string, score double>")


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``.

    Every whole text is read.  A null text, an empty one or one without a letter is
    ``und`` with score 0, and so is every text where no language was learned.  Equal
    distances go to the language first in the alphabet.  Repeated rows and null ids are
    rows like others; an empty table gives an empty result.  Only the text is an input.
    """
    return docs.select("doc_id", language(docs.sparkSession, profiles)("text").alias("found")).select(
        "doc_id", "found.lang_pred", "found.score")


#: Documents whose best profile is farther than this are no language text.
LEAST_SCORE = 0.1


def language_filter(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that are text of a learned language, unchanged.  Rejected are
    texts without a letter and texts whose score is below ``least``.  Documents stay
    where no language could be learned but they have letters."""
    profiles = learn(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))

    def make():
        def stays(text):
            lang, score = profiles.predict(text)
            return lang != UNDETERMINED and score >= least
        return stays

    return docs.where(row_udf(docs.sparkSession, make, "boolean")("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs)
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
