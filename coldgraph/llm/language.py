"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier on hashed byte trigrams of lower-cased text tells the
languages of +1 from those of -1: naive Bayes log ratios, averaged over the text and put on a logistic
curve. Bits are weighted by how often they were right on rows kept aside; the language whose
codeword has the least weighted loss is predicted. A small lead over the second marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.llm.linear import logistic_curve
from coldgraph.llm.rows import column, remainder, text_of
from coldgraph.llm.words import slices

ROWS_PER_LANGUAGE = 1_000
BITS = 15
STEP = 1 << 20


def codewords(languages: int, seed: int = 3) -> np.ndarray:
    """(languages, bits) of +1 and -1: all splits for up to 6 languages, else random codes with the widest distance."""
    if languages < 2:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= 6:
        splits = [(1, *rest) for rest in product((1, -1), repeat=languages - 1)]
        return np.array([s for s in splits if -1 in s], dtype=np.int8).T
    bits = 15 * int(np.ceil(np.log2(languages)))
    draw, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = draw.choice(np.array([1, -1], dtype=np.int8), size=(languages, bits))
        code[0, np.abs(code.sum(axis=0)) == languages] *= -1  # no bit without both sides
        apart = bits - (code.astype(int) @ code.T.astype(int) + bits) // 2
        least = apart[~np.eye(languages, dtype=bool)].min()
        if least > most:
            best, most = code, least
    return best


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each trigram, trigram) in steps of bounded size; a text is padded by blanks."""
    for start, stop in slices(texts, 4_000_000):
        part = pc.utf8_lower(pc.fill_null(texts.slice(start, stop - start), ""))
        part = pc.binary_join_element_wise(" ", part, " ", "")
        sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer("".join(part.to_pylist()).encode(), dtype=np.uint8)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(raw), STEP):
            piece = raw[a : a + STEP + 2].astype(np.uint32)
            if len(piece) < 3:
                continue
            code = piece[:-2] << np.uint32(16) | piece[1:-1] << np.uint32(8) | piece[2:]
            own = row[a : a + len(code)]
            inside = np.arange(a, a + len(code)) + 3 <= ends[own]
            place = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            yield start, own[inside], place[inside].astype(np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray  # trigrams x bits
    curve: np.ndarray  # bits x (slope, offset)
    trust: np.ndarray  # bits

    def margins(self, texts: pa.Array) -> np.ndarray:
        total = np.zeros((len(texts), self.weights.shape[1]))
        count = np.zeros(len(texts))
        for first, row, gram in trigrams(texts):
            n = int(row.max()) + 1 if len(row) else 0
            count[first : first + n] += np.bincount(row, minlength=n)
            for b in range(total.shape[1]):
                total[first : first + n, b] += np.bincount(row, self.weights[gram, b], minlength=n)
        return total / np.maximum(count, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in names, score, lead over the second)."""
        z = self.margins(texts) * self.curve[:, 0] + self.curve[:, 1]
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None, :, :]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = np.take_along_axis(loss, order, axis=1)
        likely = np.exp(-(loss - best[:, :1]) * max(1, self.code.shape[1]) / 2)
        lead = best[:, 1] - best[:, 0] if best.shape[1] > 1 else np.full(len(best), np.inf)
        return order[:, 0], 1 / likely.sum(axis=1), lead


def fit(languages: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Model of (language, trigrams, counts) rows."""
    names = sorted(languages)
    code = codewords(len(names))
    size = 1 << BITS
    place = {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(names), size))
    aside, seen = [], dict.fromkeys(names, 0)
    for name, gram, n in rows:
        seen[name] += 1
        if seen[name] % 5 == 0:
            aside.append((name, gram, n))
        else:
            np.add.at(counts[place[name]], gram, n)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    judged = aside or rows
    bits = code.shape[1]
    weights, curve, trust = np.zeros((size, bits)), np.ones((bits, 2)), np.ones(bits)
    for b in range(bits):
        up = code[:, b] > 0
        weights[:, b] = np.log(share[up].mean(axis=0)) - np.log(share[~up].mean(axis=0))
        margin = np.array([weights[g, b] @ n / max(1, n.sum()) for _, g, n in judged])
        positive = np.array([up[place[name]] for name, _, _ in judged])
        if positive.all() or not positive.any():
            curve[b] = 8.0, 0.0
        else:
            curve[b] = logistic_curve(margin, positive)
        right = ((margin * curve[b, 0] + curve[b, 1] > 0) == positive).mean()
        trust[b] = max(right - 0.5, 0.01)
    return LanguageModel(names, code, weights.astype(np.float32), curve, trust / max(trust.sum(), 1e-9))


def learn_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE, modulus: int = 4, fold: int = 2
) -> LanguageModel:
    """Learn from at most ``rows`` texts of each language outside fold ``fold`` of crc32(key) mod ``modulus``.

    Of each language the keys with the smallest hash are taken, each with one text of that language, the smallest; only these
    keys are broadcast and only trigram counts of their texts reach the driver.
    """
    known = docs.where((remainder(key, modulus) != fold) & column(lang).isNotNull() & column(key).isNotNull())
    by = Window.partitionBy("__lang").orderBy(F.xxhash64("__key"), "__key")
    ids = known.select(column(key).alias("__key"), column(lang).cast("string").alias("__lang")).distinct()
    ids = ids.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= rows).select("__key", "__lang")
    source = known.select(column(key).alias("__key"), column(lang).cast("string").alias("__lang"), text_of(text).alias("__text"))
    source = source.join(F.broadcast(ids), ["__key", "__lang"]).groupBy("__key", "__lang").agg(F.min("__text").alias("__text"))
    source = source.select("__lang", "__text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                found = [g for _, _, g in trigrams(batch.column(1).slice(i, 1))]
                gram, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
                packed = [gram.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *[pa.array([p], pa.binary()) for p in packed]], ["lang", "gram", "n"]
                )

    got = source.mapInArrow(run, "lang string, gram binary, n binary").toArrow()
    found = sorted(zip(*[c.to_pylist() for c in got.columns], strict=True))
    unpacked = [(name, np.frombuffer(g, np.int32).astype(np.int64), np.frombuffer(n, np.int32).astype(float)) for name, g, n in found]
    return fit(sorted({name for name, _, _ in unpacked}), unpacked)


def identify(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", modulus: int = 4, fold: int = 2, lead: float = 0.2
) -> DataFrame:
    """(key, held_out, lang_pred, score, ambiguous) of each row.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. Whole texts are read;
    repeated rows are predicted alike; a null key isn't held out.
    """
    letters = column(text).cast("string").rlike(r"\p{L}")
    source = docs.select(column(key), F.coalesce(letters, F.lit(False)).alias("__known"), text_of(text).alias("__text"))
    schema = docs.select(column(key)).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            m = shared.value
            known = batch.column(1).to_numpy(zero_copy_only=False)
            if m.names:
                best, score, ahead = m.predict(batch.column(2))
                names = [m.names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            else:
                names, score, ahead = ["und"] * len(known), np.zeros(len(known)), np.zeros(len(known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (ahead < lead))],
                schema.names,
            )

    return source.mapInArrow(run, schema).select(
        column(key), (remainder(key, modulus) == fold).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from ``docs`` and predict all of it; see ``learn_languages`` and ``identify``. Empty table: empty result."""
    return identify(docs, learn_languages(docs, key, text, lang), key, text)
