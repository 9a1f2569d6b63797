"""Toxicity scores by a convolutional text classifier, trained in numpy on the partitions.

A word's embedding is the joined rows of two hashed tables, so that two words are told apart unless they meet in both.
Filters over 1, 2 and 3 words run over the whole text; the largest value of each goes through a rectifier into a logistic
output. Tables and filters are trained together by Adagrad; the first dimension of the tables starts at the shrunken log
odds of their words. All labelled rows are learned from: each partition trains on its own rows, and after every pass the changes are averaged.
Thresholds are chosen by language on rows kept aside, the language guessed from function words of the text alone,
and scores are bent so that the threshold is at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.linear import sigmoid
from coldgraph.llm.quality import score_with
from coldgraph.llm.rows import column, remainder, text_of
from coldgraph.llm.tiling import token, token_hashes
from coldgraph.llm.words import Words, words_of

TABLE_BITS = 16
TABLE = (1 << TABLE_BITS) + 1
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = 2
BIAS = sum(WIDTHS) * 2 * DIM * FILTERS + 2 * FILTERS * len(WIDTHS)  # its place behind the tables
LOT, LOT_WORDS = 64, 100_000
PART_ROWS, MOST_PARTS = 4_000, 256
PASSED_ROWS = 36_000
STEPS = 20_000
MAX_SLOT_BITS = 22  # at most so many words of 64 bits (32 MB) in the filter of labelled keys

# Frequent function words by language, used to guess the language of a text.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "mit", "auf", "von", "den", "zu"],
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "was", "are", "it", "this"],
    "es": ["el", "los", "las", "del", "que", "y", "una", "por", "para", "con", "se", "no"],
    "fr": ["le", "les", "des", "et", "est", "dans", "pour", "une", "sur", "du", "au", "pas"],
}
GROUPS = ["other", *sorted(FUNCTION_WORDS)]
_GROUP_OF = {w: GROUPS.index(g) for g, words in FUNCTION_WORDS.items() for w in words}


def encoded(part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, word hashes, guessed language group of each row) of a slice, words without marks."""
    h = token_hashes(part.distinct)
    group = np.array([_GROUP_OF.get(token(w.decode("utf-8", "replace")), 0) if len(w) < 12 else 0 for w in part.distinct], dtype=np.int64)
    ids = h[part.ids] if len(part.ids) else np.zeros(0, dtype=np.uint64)
    full = ids != 0
    bounds = np.concatenate([[0], np.cumsum(full)])[part.bounds]
    votes = group[part.ids] if len(part.ids) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(part.rows), np.diff(part.bounds))
    table = np.bincount(row[votes > 0] * len(GROUPS) + votes[votes > 0], minlength=part.rows * len(GROUPS)).reshape(part.rows, -1)
    return bounds, ids[full], table.argmax(axis=1)


def padded(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in table 1, places in table 2, starts): rows one after the other, each followed by blank words."""
    rows = len(bounds) - 1
    starts = bounds[:-1] + np.arange(rows) * PAD
    first = np.full(len(h) + rows * PAD, 1 << TABLE_BITS, dtype=np.int64)
    second = first.copy()
    at = np.arange(len(h)) + np.repeat(np.arange(rows) * PAD, np.diff(bounds))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    first[at] = (h >> np.uint64(8) & mask).astype(np.int64)
    second[at] = (h >> np.uint64(40) & mask).astype(np.int64)
    return first, second, starts


@dataclass
class ToxicityModel:
    tables: list[np.ndarray]  # two of (2^bits + 1) x DIM; the last row is the blank word
    filters: dict[int, np.ndarray]  # width -> width x (2 * DIM) x FILTERS
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[int, float] = field(default_factory=dict)

    def convolve(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Values of all filters at each word; windows reach into the blank words behind a text."""
        e = np.concatenate([self.tables[0][first], self.tables[1][second]], axis=1)
        e = np.concatenate([e, np.zeros((PAD, e.shape[1]), dtype=e.dtype)])
        n = len(first)
        return np.concatenate([sum(e[o : o + n] @ f[o] for o in range(w)) for w, f in self.filters.items()], axis=1)

    def logits(self, bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(bounds) - 1)
        rows = len(found)
        a = 0
        while a < rows:  # steps of about 100,000 words; a long text is folded piece by piece
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 100_000, side="right")) - 1)
            first, second, starts = padded(bounds[a : b + 1] - bounds[a], h[bounds[a] : bounds[b]])
            if b == a + 1 and len(first) > 200_000:
                pooled = np.max([self.convolve(first[i : i + 100_002], second[i : i + 100_002])[:100_000].max(axis=0) for i in range(0, len(first), 100_000)], axis=0)[None, :]
            else:
                pooled = np.maximum.reduceat(self.convolve(first, second), starts, axis=0)
            found[a:b] = np.maximum(pooled + self.shift, 0) @ self.out + self.bias
            a = b
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts))
        for part in words_of(texts, False, 4_000_000):
            bounds, h, group = encoded(part)
            p = sigmoid(self.logits(bounds, h))
            t = np.array([self.thresholds.get(g, 0.5) for g in range(len(GROUPS))])[group]
            found[part.first : part.first + part.rows] = np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))
        return found


def _cut(model: ToxicityModel) -> np.ndarray:
    """All numbers of a model as rows of DIM: both tables, then filters, shifts, weights and bias, one after the other."""
    dense = np.concatenate([*[f.ravel() for f in model.filters.values()], model.shift, model.out, [model.bias]])
    dense = np.append(dense, np.zeros(-len(dense) % DIM))
    return np.concatenate([*model.tables, dense.reshape(-1, DIM)]).astype(np.float32)


def _model(rows: np.ndarray) -> ToxicityModel:
    """The model of ``_cut``'s rows; its arrays are views of them, but for the bias."""
    dense, filters, at = rows[2 * TABLE :].reshape(-1), {}, 0
    for w in WIDTHS:
        n = w * 2 * DIM * FILTERS
        filters[w] = dense[at : at + n].reshape(w, 2 * DIM, FILTERS)
        at += n
    n = FILTERS * len(WIDTHS)
    return ToxicityModel([rows[:TABLE], rows[TABLE : 2 * TABLE]], filters, dense[at : at + n], dense[at + n : at + 2 * n], float(dense[at + 2 * n]))


def _start(seen: np.ndarray, toxic: int, others: int) -> ToxicityModel:
    """A model whose first dimension holds the log odds of ``seen`` (table, place, others and toxic: texts with a word there)."""
    draw = np.random.default_rng(5)
    tables = []
    for k in range(2):
        a = 10 / (toxic + others)
        odds = np.log((seen[k, :, 1] + a * toxic) / toxic) - np.log((seen[k, :, 0] + a * others) / others)
        table = draw.normal(0, 0.05, (TABLE, DIM))
        table[:, 0] = np.clip(odds, -1, 4) / 2
        table[-1] = 0
        tables.append(table.astype(np.float32))
    filters = {}
    for w in WIDTHS:
        f = draw.normal(0, 0.2, (w, 2 * DIM, FILTERS))
        f[0, [0, DIM], :] += 0.5
        filters[w] = f.astype(np.float32)
    n = FILTERS * len(WIDTHS)
    return ToxicityModel(tables, filters, np.full(n, -1.0, dtype=np.float32), np.full(n, 0.1, dtype=np.float32), -1.0)


def _constant(toxic: int, others: int) -> ToxicityModel:
    model = _start(np.zeros((2, TABLE, 2)), 1, 1)
    model.out[:] = 0
    share = (toxic + 1) / (toxic + others + 2)
    model.bias = float(np.log(share / (1 - share)))
    return model


class Trainer:
    """Adagrad steps on small lots of texts, from a model and its sums of squares (``_cut`` rows, which are copied)."""

    def __init__(self, rows: np.ndarray, squares: np.ndarray, weights: tuple[float, float], rate: float = 0.05):
        self.rows, self.squares = rows.copy(), squares.copy()
        self.model, against = _model(self.rows), _model(self.squares)
        self.value, self.square = self._named(self.model), self._named(against)
        self.square_bias, self.weights, self.rate = against.bias, weights, rate
        self.touched = np.zeros(len(rows), dtype=bool)
        self.touched[2 * TABLE :] = True

    @staticmethod
    def _named(model: ToxicityModel) -> dict[str, np.ndarray]:
        names = ["t0", "t1", *[f"f{w}" for w in WIDTHS], "shift", "out"]
        return dict(zip(names, [*model.tables, *model.filters.values(), model.shift, model.out], strict=True))

    def _step(self, name: str, gradient: np.ndarray, at=slice(None)) -> None:
        self.square[name][at] += gradient**2
        self.value[name][at] -= self.rate * gradient / np.sqrt(self.square[name][at])

    def _best(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the largest value of each filter in each text; a long text is folded piece by piece."""
        model = self.model
        if len(starts) == 1 and len(first) > LOT_WORDS:
            at, best = np.zeros((1, len(model.shift)), dtype=np.int64), np.full((1, len(model.shift)), -np.inf, dtype=np.float32)
            for i in range(0, len(first), LOT_WORDS):
                values = model.convolve(first[i : i + LOT_WORDS + PAD], second[i : i + LOT_WORDS + PAD])[:LOT_WORDS]
                own = values.argmax(axis=0)
                top = values[own, np.arange(values.shape[1])]
                at, best = np.where(top > best, i + own, at), np.maximum(best, top)
            return at, best
        values = model.convolve(first, second)
        ends = np.append(starts[1:], len(first))
        at = np.array([a + values[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
        return at, np.take_along_axis(values, at, axis=0)

    def learn(self, own: list[np.ndarray], toxic: np.ndarray) -> None:
        """One step on a lot. Gradients reach only the words that a filter has chosen."""
        value, model = self.value, self.model
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in own])])
        first, second, starts = padded(bounds, np.concatenate(own))
        at, best = self._best(first, second, starts)
        pooled = best + value["shift"]
        hidden = np.maximum(pooled, 0)
        p = sigmoid(hidden @ value["out"] + model.bias)
        d = ((p - toxic) * np.where(toxic, self.weights[1], self.weights[0]) / len(own)).astype(np.float32)
        inner = (d[:, None] * value["out"]) * (pooled > 0)
        self._step("out", d @ hidden + 1e-4 * value["out"])
        self._step("shift", inner.sum(axis=0))
        self.square_bias += float(d.sum()) ** 2
        model.bias -= self.rate * float(d.sum()) / self.square_bias**0.5
        first_x, second_x = np.append(first, [TABLE - 1] * PAD), np.append(second, [TABLE - 1] * PAD)
        places, grads = ([], []), ([], [])
        for k, w in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            g, where = inner[:, part], at[:, part]
            f = value[f"f{w}"]
            change = np.zeros_like(f)
            for o in range(w):
                x1, x2 = first_x[where + o], second_x[where + o]
                e = np.concatenate([value["t0"][x1], value["t1"][x2]], axis=2)
                change[o] = np.einsum("df,dfe->ef", g, e)
                back = g[:, :, None] * f[o].T[None, :, :]
                live = g != 0
                for t, x, lo in ((0, x1, 0), (1, x2, DIM)):
                    places[t].append(x[live])
                    grads[t].append(back[live][:, lo : lo + DIM])
            self._step(f"f{w}", change + 1e-4 * f)
        for t in range(2):
            x, g = np.concatenate(places[t]), np.concatenate(grads[t])
            if not len(x):
                continue
            found, inverse = np.unique(x, return_inverse=True)
            total = np.zeros((len(found), DIM), dtype=np.float32)
            np.add.at(total, inverse, g)
            total[found == TABLE - 1] = 0
            self._step(f"t{t}", total, found)
            self.touched[t * TABLE + found] = True

    def finished(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, squares) as they are now."""
        for rows, bias in ((self.rows, self.model.bias), (self.squares, self.square_bias)):
            rows[2 * TABLE :].reshape(-1)[BIAS] = bias
        return self.rows, self.squares


def _lots(stream: Iterator[pa.RecordBatch], aside: bool | None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(word hashes, toxic, language) of lots of up to ``LOT`` texts and about ``LOT_WORDS`` words; rows with ``aside`` (None: all) only."""
    texts, toxic, languages, size = [], [], [], 0
    for batch in stream:
        for words, language, label, kept in zip(*(batch.column(c) for c in ("words", "language", "label", "aside")), strict=True):
            if aside is not None and kept.as_py() != aside:
                continue
            h = unpacked(words.as_buffer())
            if texts and (len(texts) == LOT or size + len(h) > LOT_WORDS):
                yield texts, np.array(toxic, dtype=bool), np.array(languages)
                texts, toxic, languages, size = [], [], [], 0
            texts.append(h)
            toxic.append(label.as_py() == 1)
            languages.append(language.as_py())
            size += len(h)
    if texts:
        yield texts, np.array(toxic, dtype=bool), np.array(languages)


def packed(h: np.ndarray) -> bytes:
    """The places of words in both tables, which is all of their hashes that is used."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return ((h >> np.uint64(8) & mask) | (h >> np.uint64(40) & mask) << np.uint64(16)).astype(np.uint32).tobytes()


def unpacked(words) -> np.ndarray:
    h = np.frombuffer(words, dtype=np.uint32).astype(np.uint64)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return (h & mask) << np.uint64(8) | (h >> np.uint64(16)) << np.uint64(40)


def _coder(shared, slots: int):
    """(key, words, language) of rows (key, filter place, text) whose key the filter lets through, once for each key and slice: the smallest codes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in stream:
            place = batch.column(1).to_numpy()
            asked = table[place & ((1 << slots) - 1)] >> (place >> slots & 63).astype(np.uint64) & np.uint64(1)
            batch = batch.filter(pa.array(asked.astype(bool)))
            if not batch.num_rows:
                continue
            for part in words_of(batch.column(2), False):
                bounds, h, group = encoded(part)
                least = {}
                for r, k in enumerate(batch.column(0).slice(part.first, part.rows).to_pylist()):
                    found = packed(h[bounds[r] : bounds[r + 1]]), int(group[r])
                    least[k] = min(found, least.get(k, found))
                columns = [pa.array(least, batch.column(0).type), pa.array([w for w, _ in least.values()], pa.binary()), pa.array([g for _, g in least.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["__key", "words", "language"])

    return run


def labelled_words(docs: DataFrame, labels: DataFrame, count: int, key: str, text: str, parts: int) -> DataFrame:
    """(label, words, language, aside) of every row that ``labels`` (``count`` rows: __key, label) name, in ``parts`` partitions by key or, if the join raises that, the session's number, in the order of a hash of it.

    A key with several texts counts once, with the smallest codes. About every fifth key is kept aside for the thresholds. Texts that
    a filter of about 16 bits a label, 32 MB at most, keeps out are not encoded; of the others only the codes are shuffled, once.
    """
    hashed = F.xxhash64("__key")
    slots = max(10, min(MAX_SLOT_BITS, (count * 16 // 64).bit_length()))
    bit = F.expr(f"shiftleft(1L, cast(shiftright(h, {slots}) & 63 as int))")
    words = labels.select(hashed.alias("h")).groupBy(F.col("h").bitwiseAND((1 << slots) - 1).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(1 << slots, dtype=np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    texts = docs.select(column(key).alias("__key"), text_of(text).alias("__text")).where(F.col("__key").isNotNull()).select("__key", hashed, "__text")
    kind = texts.schema["__key"].dataType.simpleString()
    coded = texts.mapInArrow(_coder(shared, slots), f"__key {kind}, words binary, language long").repartition(parts, "__key")
    joined = coded.join(labels.repartition(parts, "__key"), "__key")
    once = joined.groupBy("__key", "label").agg(F.min(F.struct("words", "language")).alias("w")).select("__key", "label", "w.words", "w.language")
    dealt = once.sortWithinPartitions(hashed, "__key")
    return dealt.select("label", "words", "language", (F.pmod(F.xxhash64(F.lit(7), "__key"), F.lit(5)) == 0).alias("aside"))


def _seen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(aside, kind, place, n): texts by class (place -1) and texts of a class with a word at a place of a table."""
    count = np.zeros((2, 2, 2 * TABLE + 1), dtype=np.int64)
    for batch in stream:
        for words, label, aside in zip(*(batch.column(c) for c in ("words", "label", "aside")), strict=True):
            h = unpacked(words.as_buffer())
            own = count[int(aside.as_py()), int(label.as_py() == 1)]
            own[-1] += 1
            first, second, _ = padded(np.array([0, len(h)]), h)
            own[np.unique(first)] += 1
            own[TABLE + np.unique(second)] += 1
    aside, kind, place = np.nonzero(count)
    columns = [aside, kind, np.where(place == 2 * TABLE, -1, place), count[aside, kind, place]]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["aside", "kind", "place", "n"])


def _bytes(changes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in changes.astype(np.float32)], pa.binary())


def _matrix(changes: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(changes.to_pylist()), dtype=np.float32).reshape(-1, 2 * DIM)


def _passed(shared, aside: bool | None, weights: tuple[float, float]):
    """Changes of one pass over a partition: (worker, place, change and growth of the squares) of the rows it has touched."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, squares = shared.value
        trainer, any_rows = Trainer(rows, squares, weights), False
        for texts, toxic, _ in _lots(stream, aside):
            trainer.learn(texts, toxic)
            any_rows = True
        if any_rows:
            after, grown = trainer.finished()
            place = np.flatnonzero(trainer.touched)
            both = np.concatenate([after[place] - rows[place], grown[place] - squares[place]], axis=1)
            worker = np.full(len(place), TaskContext.get().partitionId())
            for i in range(0, len(place), 10_000):
                part = slice(i, i + 10_000)
                columns = [pa.array(worker[part].astype(np.int32)), pa.array(place[part]), _bytes(both[part])]
                yield pa.RecordBatch.from_arrays(columns, ["worker", "place", "change"])

    return run


def _mean_changes(table: pa.Table) -> pa.Table:
    """(place, change): the mean over the workers that have touched a place, summed in their order."""
    worker, place = table.column("worker").to_numpy(), table.column("place").to_numpy()
    order = np.lexsort((worker, place))
    change, place = _matrix(table.column("change"))[order].astype(np.float64), place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(starts, len(place)))
    return pa.table([pa.array(place[starts]), _bytes(np.add.reduceat(change, starts, axis=0) / n[:, None])], names=["place", "change"])


def train(rows: DataFrame, model: ToxicityModel, epochs: int, aside: bool | None, weights: tuple[float, float]) -> ToxicityModel:
    """Passes over all rows: every partition learns from its own, then the changes of each number are averaged over those that have changed it."""
    value = _cut(model)
    squares = np.full(value.shape, 1e-2, dtype=np.float32)
    context = rows.sparkSession.sparkContext
    for _ in range(epochs):
        shared = context.broadcast((value, squares))
        changes = rows.mapInArrow(_passed(shared, aside, weights), "worker int, place long, change binary")
        mean = changes.groupBy(F.shiftright("place", 10)).applyInArrow(_mean_changes, "place long, change binary").toArrow()
        place, change = mean.column("place").to_numpy(), _matrix(mean.column("change"))
        value, squares = value.copy(), squares.copy()
        value[place] += change[:, :DIM]
        squares[place] += change[:, DIM:]
        shared.unpersist()
    return _model(value)


def _best_threshold(p: np.ndarray, toxic: np.ndarray, others: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of its gap; so many toxic and other texts have the scores p, which are distinct."""
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum(toxic[order]), np.cumsum((toxic + others)[order])
    best = int(np.argmax(2 * hit / (taken + toxic.sum())))
    ranked = p[order]
    below = ranked[best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((ranked[best] + below) / 2, 0.02, 0.98))


def thresholds(rows: DataFrame, model: ToxicityModel, aside: bool | None, least: int = 20) -> dict[int, float]:
    """Thresholds by the scores (in ``STEPS`` steps) of all rows with ``aside``, by language where it has ``least`` toxic ones there."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(GROUPS), STEPS, 2), dtype=np.int64)
        for texts, toxic, language in _lots(stream, aside):
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in texts])])
            p = sigmoid(shared.value.logits(bounds, np.concatenate(texts)))
            np.add.at(count, (language, np.minimum((p * STEPS).astype(np.int64), STEPS - 1), toxic.astype(np.int64)), 1)
        language, step = np.nonzero(count.sum(axis=2))
        columns = [language, step, count[language, step, 1], count[language, step, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["language", "step", "toxic", "others"])

    counts = rows.mapInArrow(run, "language long, step long, toxic long, others long")
    got = counts.groupBy("language", "step").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others")).toArrow()
    language, step, toxic, others = (c.to_numpy() for c in got.columns)
    table = np.zeros((len(GROUPS), STEPS, 2))
    table[language, step, 0], table[language, step, 1] = toxic, others

    def best(own: np.ndarray) -> float:
        full = np.flatnonzero(own.sum(axis=1))
        return _best_threshold((full + 0.5) / STEPS, own[full, 0], own[full, 1])

    overall = best(table.sum(axis=0))
    return {g: best(table[g]) if table[g, :, 0].sum() >= least else overall for g in range(len(GROUPS))}


def learn_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 5) -> ToxicityModel:
    """Learn from all labelled rows outside fold 0 of crc32(key) mod ``modulus``: counts, model and thresholds.

    The rows' word codes stay in their partitions, of about ``PART_ROWS`` rows (``MOST_PARTS`` partitions at most), which are trained on side by side; counts and
    averaged changes of the model reach the driver. Small tables are passed over more often, every row twice at least.
    """
    known = labels.where(remainder(key, modulus) != 0).select(column(key).alias("__key"), column(label).cast("int").alias("label"))
    known = known.where(F.col("__key").isNotNull() & F.col("label").isNotNull()).groupBy("__key").agg(F.max("label").alias("label"))
    count = known.count()
    if not count:
        return _constant(0, 0)
    rows = labelled_words(docs, known, count, key, text, min(MOST_PARTS, -(-count // PART_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        got = rows.mapInArrow(_seen, "aside long, kind long, place long, n long").groupBy("aside", "kind", "place").agg(F.sum("n").alias("n")).toArrow()
        aside, kind, place, n = (c.to_numpy() for c in got.columns)
        seen = np.zeros((2, 2, 2 * TABLE + 1), dtype=np.int64)
        seen[aside, kind, place] = n  # place -1 is the last
        texts = seen[:, :, -1]
        toxic, others = int(texts[:, 1].sum()), int(texts[:, 0].sum())
        if not toxic or not others:
            return _constant(toxic, others)
        apart = min(toxic, others) >= 10 and texts.all()
        learn, judge = (False, True) if apart else (None, None)
        used = seen[0] if apart else seen.sum(axis=0)
        toxic, others = int(used[1, -1]), int(used[0, -1])
        start = _start(used[:, :-1].reshape(2, 2, TABLE).transpose(1, 2, 0), toxic, others)
        share = toxic / (toxic + others)
        epochs = int(np.clip(-(-PASSED_ROWS // count), 2, 6))
        model = train(rows, start, epochs, learn, (0.5 / (1 - share), 0.5 / share))
        model.thresholds = thresholds(rows, model, judge)
        return model
    finally:
        rows.unpersist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each row of ``docs``; whole texts are read.

    Null and empty texts get the score of blank words. Repeated rows are scored alike; a null key is held out. Without
    labels the score is constant; an empty table gives an empty result.
    """
    return score_with(docs, learn_toxicity(docs, labels, key, text), key, text, 5, 0.5)
