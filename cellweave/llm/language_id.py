"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's `size` most frequent n-grams (1 to 3 letters, words padded by a
blank at each end). A text's own list is compared by out-of-place distance: the sum of |rank in the text
- rank in the profile|, `size` for an n-gram that the profile lacks. The nearest profile wins, ties go to
the first language in alphabetical order; score is 1 - nearest / (the distance of a text that shares
nothing).

Profiles are learned from at most about `max_docs` rows of each language, chosen by a hash of the id (all rows of a rare
language teach) and counted in a distributed way (only languages x size rows reach the driver). Every text is judged
as a whole.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with a null language do not
teach. Repeated rows each get a row; an empty table gives an empty result; without profiles every text is
`und`. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import checkpoint, slices

SIZE = 300
#: Languages up to which their shares (a name and a double each) are broadcast.
BROADCAST_LANGUAGES = 10_000
#: 21 bits hold any code point.
_SHIFT = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter of the basic plane, 0 for other characters."""
    out = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, one 0 between and around words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    low = _letters()
    out = low[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        out[beyond] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in codes[beyond].tolist()]
    out = np.concatenate([[0], out, [0]])
    return out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of 1 to 3 letters and how often each occurs."""
    x = letters(text)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = x[x != 0]
    two = (x[:-1] << _SHIFT) | x[1:]
    three = ((x[:-2] << (2 * _SHIFT)) | (x[1:-1] << _SHIFT) | x[2:])[x[1:-1] != 0]
    # Lengths stay apart: 2-grams carry bit 62, 3-grams bit 63 as the sign. A 2-gram with its blank first differs from a letter so.
    every = np.sort(np.concatenate([one, two | (1 << 62), -three - 1]))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.diff(np.append(first, len(every)))


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def fit(docs: DataFrame, *, size: int = SIZE, max_docs: int = 5000) -> dict[str, np.ndarray]:
    """Language -> codes by falling frequency, from docs (doc_id, text, lang)."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(lang as string) lang").where("lang is not null and text is not null")
    share = checkpoint(rows.groupBy("lang").agg((F.lit(1_000_000.0) * max_docs / F.count("*")).alias("share")))
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    rows = rows.join(share, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "code", "n"])
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                for code, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    own[code] = own.get(code, 0) + n
            if sum(map(len, total.values())) > 500_000:
                yield from out()
        yield from out()

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    best = ranked.toPandas().sort_values(["lang", "r"])
    return {lang: own["code"].to_numpy(np.int64) for lang, own in best.groupby("lang")}


class Profiles:
    """The profiles merged into one sorted table: code -> its rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.codes), len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text), self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(0)
        k = int(np.argmin(apart))
        return self.names[k], float(1 - apart[k] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for batch in batches:
            for part in slices(batch, 1):
                got = [known.judge(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
