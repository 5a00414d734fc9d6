"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of one to three characters (words padded by blanks,
letters in lower case, all else blank) in order of frequency. A language's profile is learned from
labelled documents; a document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of the differences of ranks, with a missing n-gram counting as much
as the profile is long. The nearest profile wins, on ties the language that sorts first.

Profiles are fixed-size tables (languages times PROFILE rows) and are handed to the tasks; texts
are never shuffled. Counting for profiles adds up inside each task before the shuffle.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text
when nothing could be learned; null languages teach nothing; a null id is never held out and
teaches nothing; repeated rows are judged each on its own. Long texts are counted in stretches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of
from topicgauge.sources.storage import materialize

PROFILE = 300
#: About this many documents per language are learned from (chosen by hash of the id, all if fewer).
TRAIN_PER_LANGUAGE = 4000
STRETCH = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = None if weights is None else np.argsort(codes, kind="stable")
    codes = np.sort(codes) if order is None else codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    if weights is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(weights[order], first)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams (21 bits a character) and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    blank = np.uint32(32)
    points = np.where(_letters()[points], points, blank)
    padded = np.concatenate([[blank], points, [blank]]).astype(np.int64)
    padded = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    if len(padded) < 3:
        return np.array([], np.int64), np.array([], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(padded) - 1, STRETCH):
        part = padded[at : at + STRETCH + 2]
        own = min(STRETCH, len(part))
        pairs = part[:-1] << 21 | part[1:]
        triples = pairs[:-1] << 21 | part[2:]
        single = part[:own]
        found.append(_counted(np.concatenate([single[single != 32], pairs[:own], triples[:own]])))
    if len(found) == 1:
        return found[0]
    return _counted(np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]))


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent codes, most frequent first, ties by code."""
    if len(counts) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """The ranks of all languages' n-grams, side by side."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.languages = sorted(ranks)
        self.codes = np.array(sorted({c for codes in ranks.values() for c in codes}), np.int64)
        self.ranks = np.full((len(self.codes), len(self.languages)), -1, np.int64)
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(ranks[language], np.int64)), k] = np.arange(len(ranks[language]))

    def judge(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        codes = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.ranks[at]
        known = np.where((self.codes[at] == codes)[:, None], known, -1)
        apart = np.where(known < 0, self.size, np.abs(known - np.arange(len(codes))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.size * len(codes)))


def learn(docs: DataFrame, may_learn: Column, per_language: int = TRAIN_PER_LANGUAGE) -> Profiles:
    """Profiles from ``text, lang`` of the rows that ``may_learn``."""
    labelled = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # stored, so that Spark knows its size and hands it to the scan instead of shuffling texts by language
    counts = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = labelled.join(counts, "lang").filter(draw * F.col("_n") < F.lit(per_language << 20)).select("lang", "text")
    schema = "lang string, code long, n long"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        sums: dict[bytes, list] = {}

        def add_up(language):
            parts = sums.pop(language)
            return _counted(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))

        for language, text in rows_of(batches):
            found = ngram_counts(text.decode())
            if len(found[0]):
                parts = sums.setdefault(language, [])
                parts.append(found)
                if len(parts) >= 64:
                    total = add_up(language)
                    sums[language] = [total]
        for language in list(sums):
            codes, n = add_up(language)
            for code, k in zip(codes.tolist(), n.tolist()):
                yield from out.add((language.decode(), code, k))
        yield from out.flush()

    totals = sample.mapInArrow(scan, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranks: dict[str, list[int]] = {}
    # languages times PROFILE rows
    for language, code, _ in sorted(totals.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).select("lang", "code", "rank").collect(), key=lambda r: (r[0], r[2])):
        ranks.setdefault(language, []).append(code)
    return Profiles(ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = "doc_id long, lang_pred string, score double"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        for doc_id, text in rows_of(batches):
            yield from out.add((doc_id, *shared.value.judge(text and text.decode())))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)
