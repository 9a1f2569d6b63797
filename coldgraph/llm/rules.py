"""Quality rules: text statistics and a learned decision list.

Statistics of whole texts are counted where the texts are. From labelled statistics, sequential covering
grows rules for rejection (conjunctions of thresholds, best gain first) on two thirds of the sample, prunes each
on the other third and removes what it covers, until a rule isn't precise there. The list is emitted as a Spark
conditional expression, first match decides, the rest is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, remainder, text_of
from coldgraph.session import materialize

SAMPLE_ROWS = 20_000
LEAST_PRECISION = 0.9
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_exclaims"]
SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_UPPER = re.compile(r"[A-Z]")
_MARK = re.compile(r"[^\w\x20\x09-\x0D]")


def repeated_words(words: list, width: int = 3) -> int:
    """Words inside ``width``-word windows that the text has twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)], strict=False))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def statistics_of(text: str) -> list[int]:
    words = text.encode().split()
    seen, dups = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            if line in seen:
                dups += 1
            seen.add(line)
    return [
        len(words),
        len(text) - len(_BLANK.findall(text)),
        len(_SYMBOL.findall(text)),
        dups,
        repeated_words(words),
        len(_MARK.findall(text)),
        len(_UPPER.findall(text)),
        text.count("!"),
    ]


def statistics(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns ``keys`` and the counts of each whole text (null: empty)."""
    source = docs.select(*[column(k) for k in keys], text_of(text).alias("__text"))
    schema = source.drop("__text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = np.array([statistics_of(str(t)) for t in batch.column(len(keys))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(c) for c in found.T]], schema.names)

    return source.mapInArrow(run, schema)


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


# What rules may test, by name.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _per("word_chars", "n_words"),
    "symbols_per_word": lambda: _per("n_symbols", "n_words"),
    "marks_per_char": lambda: _per("n_marks", "word_chars"),
    "upper_per_char": lambda: _per("n_upper", "word_chars"),
    "exclaims_per_word": lambda: _per("n_exclaims", "n_words"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "dup_lines_per_word": lambda: _per("n_dup_lines", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(FEATURES).index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that meets all conditions of one is rejected."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def keeps(self) -> Column:
        """Conditional expression over the counts: false for what a rule rejects, else true."""
        decided = None
        for rule in self.rules:
            met = F.lit(True)
            for c in rule:
                met = met & c.column()
            decided = F.when(met, F.lit(False)) if decided is None else decided.when(met, F.lit(False))
        return F.lit(True) if decided is None else decided.otherwise(F.lit(True))

    def describe(self) -> list[str]:
        return [
            "reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule)
            for rule in self.rules
        ]


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), dtype=bool)
    for c in rule:
        met &= c.holds(x)
    return met


def _grow(x: np.ndarray, y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    met = np.ones(len(x), dtype=bool)
    while y[met].sum() and (~y[met]).sum() and len(rule) < 4:
        p0, n0 = y[met].sum(), (~y[met]).sum()
        before = np.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            values = np.unique(x[met, k])
            if len(values) > 64:
                values = np.unique(np.quantile(x[met, k], np.linspace(0, 1, 65)))
            for t in ((values[1:] + values[:-1]) / 2).tolist():
                high = met & (x[:, k] > t)
                for above, now in ((True, high), (False, met & ~high)):
                    p, n = y[now].sum(), (~y[now]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - before)) > gain:
                        best, gain = Condition(name, above, t), g
        if best is None:
            break
        rule.append(best)
        met &= best.holds(x)
    return rule


def learn(x: np.ndarray, reject: np.ndarray, least_precision: float = LEAST_PRECISION) -> DecisionList:
    """Decision list from features (columns in the order of FEATURES) and what is to be rejected."""
    rules: list[tuple[Condition, ...]] = []
    left = np.arange(len(x))
    while reject[left].any() and len(rules) < 16:
        # every third row prunes, class by class, so that both parts have both
        order = left[np.argsort(reject[left], kind="stable")]
        prune, grow = order[::3], np.setdiff1d(order, order[::3])
        rule = _grow(x[grow], reject[grow])
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            got = reject[prune][_covers(r, x[prune])]
            return (2 * got.sum() - len(got)) / max(1, len(got))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        judged = reject[prune][_covers(rule, x[prune])]
        if not len(judged) or judged.mean() < least_precision:
            break
        rules.append(tuple(rule))
        left = left[~_covers(rule, x[left])]
    return DecisionList(tuple(rules))


def learn_rules(
    counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS, modulus: int = 5
) -> DecisionList:
    """Learn from counts and labels (1 keep, 0 reject) of rows outside the fold 0 of crc32(key) mod ``modulus``.

    At most ``rows`` labelled keys are used, those with the smallest hash, each with one of its rows. Rows that the base
    rules reject teach nothing. Without labels of both kinds the list is empty.
    """
    known = labels.where((remainder(key, modulus) != 0) & column(key).isNotNull() & column(label).isNotNull())
    known = known.groupBy(column(key).alias("__key")).agg(F.max(column(label).cast("int")).alias("__label"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    sample = counted.where(~base_failed()).join(F.broadcast(known), column(key) == F.col("__key"))
    values = F.struct(*[f().alias(n) for n, f in FEATURES.items()])
    found = sample.groupBy("__key", "__label").agg(F.min(values).alias("__x")).select("__key", "__x.*", "__label").toPandas()
    found = found.sort_values(list(found.columns), kind="stable")
    return learn(found[list(FEATURES)].to_numpy(dtype=float), found["__label"].to_numpy() == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row.

    Null and empty texts have zero counts and fail the base rules. Rows are judged one by one, so repeated rows
    and null keys are rows like any other. An empty table gives an empty result.
    """
    counted = materialize(statistics(docs, [key], text), "rules-counts")
    rules = learn_rules(counted, labels, key)
    judged = counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())
    return judged.select(column(key), *COUNTS[:5], "base_failed", "kept")


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that base rules and decision list keep, with all columns; texts aren't moved."""
    counted = materialize(statistics(docs, [key], text), "rules-counts")
    rules = learn_rules(counted, labels, key)
    names = docs.columns
    inner = [f"__{i}" for i in range(len(names))]
    wide = statistics(docs.toDF(*inner), inner, inner[names.index(text)])
    return wide.where(~base_failed() & rules.keeps()).select(*inner).toDF(*names)
