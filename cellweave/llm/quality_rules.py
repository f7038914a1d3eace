"""Quality rules: a decision list learned by sequential covering.

Statistics of a text are counted in one pass (Arrow batches); rules are conjunctions of thresholds on
ratios of them, grown by FOIL gain on two thirds of the labelled rows, pruned on the rest, accepted at a
precision of `min_precision` there, and emitted as an ordered Spark CASE expression: the first rule that
holds rejects; a text that no rule covers is kept.

Words are runs of characters other than space and U+0009-000D. The learner reads at most about
`max_labels` labelled rows, chosen by a hash of doc_id; statistics and rules cover every row.

Nulls: a null text has no words; a null or unlabelled doc_id does not take part in learning. Copies of a
label count once, the least label wins; of several texts under one doc_id the one of the least statistics teaches. Without labels of both kinds there are no rules. Repeated rows
each get a row; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded_labels, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_digits", "n_lines"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
WINDOW = 5
_SPACE = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, every occurrence included. Exact: codes are ranks, not hashes."""
    if len(words) <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code, base = ids, len(number)
    for k in range(1, window):
        if base >= 2**62 // len(number):
            code = np.unique(code, return_inverse=True)[1]
            base = int(code.max()) + 1
        code = code[:-1] * len(number) + ids[k:]
        base *= len(number)
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(code, twice)
    step = np.zeros(len(words) + 1, np.int64)
    step[:-window][hit] += 1
    step[window:][hit] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def count(text: str) -> list[int]:
    """The statistics of one text, in the order of COUNTS."""
    raw = text.encode()
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(seen[:128].sum() + seen[192:].sum())
    return [len(words), chars - int(seen[_SPACE].sum()), int(seen[_SYMBOLS].sum()), dup_lines(raw), repeat_words(words), int(seen[65:91].sum()), int(seen[_PUNCT].sum()), int(seen[48:58].sum()), int(seen[10]) + 1]


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = np.asarray([count(t or "") for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def features() -> dict[str, Column]:
    """Ratios that rules may test; all are 0 for a text without words."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    return {
        "mean_word_chars": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_share": c["n_repeat_words"] / words,
        "upper_share": c["n_upper"] / chars,
        "punct_per_word": c["n_punct"] / words,
        "digit_share": c["n_digits"] / chars,
        "words_per_line": c["n_words"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "n_words": c["n_words"],
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


Rule = tuple[Literal, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, levels: int) -> Rule:
    """Add the literal of the highest FOIL gain until no good row is covered or none gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while (~bad[inside]).any() and len(rule) < 4:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, best_gain = None, 1e-9
        for name, values in x.items():
            own = np.unique(values[inside])
            if len(own) < 2:
                continue
            middles = (own[1:] + own[:-1]) / 2
            cuts = middles if len(middles) <= levels else np.unique(np.quantile(values[inside], np.linspace(0, 1, levels + 2)[1:-1]))
            order = np.argsort(values[inside], kind="stable")
            ranked, flags = values[inside][order], bad[inside][order]
            below_bad = np.append(0, np.cumsum(flags))
            at = np.searchsorted(ranked, cuts, "left")
            for above in (True, False):
                p = p0 - below_bad[at] if above else below_bad[at]
                n = (len(ranked) - at if above else at) - p
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Literal(name, above, float(cuts[k])), float(gain[k])
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final literals as long as (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x)
        return float((2 * bad[inside].sum() - inside.sum()) / max(1, inside.sum()))

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune_row: np.ndarray, *, min_precision: float = 0.9, min_cover: int = 4, max_rules: int = 16, levels: int = 64) -> list[Rule]:
    """Sequential covering: rules that reject, in order."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        grow, prune = left & ~prune_row, left & prune_row
        if bad[grow].sum() < min_cover:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], levels)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        inside = _covers(rule, x)
        held, seen = prune & inside, left & inside
        if bad[seen].sum() < min_cover or bad[seen].sum() < min_precision * seen.sum() or bad[held].sum() + 1 < min_precision * (held.sum() + 1):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, max_labels: int = 20_000, **options: float) -> list[Rule]:
    """Rules from labels (doc_id, quality 0/1) and the texts of the labelled rows."""
    known = bounded_labels(labels, "quality", max_labels)
    # At most about max_labels rows of 12 bytes: a proven bound.
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    # Of several texts under one doc_id the one of the least statistics teaches.
    stats = text_stats(texts.select("doc_id", "text")).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    rows = stats.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", *(v.alias("f_" + k) for k, v in features().items())).toPandas().sort_values("doc_id")
    if not len(rows):
        return []
    x = {k: rows["f_" + k].to_numpy(float) for k in features()}
    return learn(x, rows["label"].to_numpy() == 0, rows["doc_id"].to_numpy() % 3 == 1, **options)


def keeps(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for literal in rule[1:]:
            held = held & literal.column()
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept of each row."""
    return text_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & keeps(rules))


def drop_rejected(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at, names = docs.columns.index("text"), docs.columns
    inner = [f"c{k}" for k in range(len(names))]
    schema = ", ".join(f"{c} {docs.schema[k].dataType.simpleString()}" for k, c in enumerate(inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                rows = np.asarray([count(t or "") for t in part.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=[*inner, *COUNTS])

    counted = docs.toDF(*inner).mapInArrow(run, f"{schema}, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.where(~base_failed() & keeps(rules)).select(*inner).toDF(*names)
