"""Language-model scores by deleted interpolation.

p(w | h) = l2 * c(hw) / c(h) + l1 * c(w) / N + l0 / (V + 1), h being the word before (or the begin of the text). The
weights depend on how frequent the context is: one set for each power of two of c(h). They are learned by
expectation-maximisation on texts deleted from the counts (fold 1), then the final counts take in all training texts.

Counts are exact and cover the corpus. Texts are packed into blocks of some megabytes; each block asks for the counts of its
distinct words and word pairs, as sorted 64-bit hashes, and gives its own. One shuffle by hash range adds them up
and answers each block, so no table of counts is broadcast and a frequent word is one
entry per block. A second shuffle brings blocks and answers together, where whole texts are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, remainder, text_of
from coldgraph.llm.words import hashes, words_of
from coldgraph.session import materialize

BLOCK_BYTES = 8_000_000
SHARD_BYTES = 16_000_000
WORD_BYTES = 500_000
ANSWERS = "block long, shard int, payload binary, n0 long, n1 long, v0 long, v1 long"
BEGIN = np.uint64(0x5DEECE66D1234567)
END = np.uint64(0x27D4EB2F165667C5)
BUCKETS = 64
FOLDS = 10
OCTAVE = 4


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of each word with the word before it."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + h
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them)."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    ranked = ranked[new]
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked, place


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, token, token before) of a block; each text ends with one END.

    Words are split a few texts at a time: as objects they take many times the room of their hashes.
    """
    found, sizes = [], []
    for part in words_of(texts, True, WORD_BYTES):
        found.append(hashes(part.distinct)[part.ids] if len(part.ids) else np.zeros(0, dtype=np.uint64))
        sizes.append(np.diff(part.bounds))
    sizes = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    h = np.full(bounds[-1], END, dtype=np.uint64)
    h[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1][: len(sizes)]] = BEGIN
    return bounds, h, before


def _narrow(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences of as few bytes as they need."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, dtype=np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), dtype=np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _join(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(parts)


def _cut(packed: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(packed, dtype="<u4", count=n)).tolist()
    body = packed[4 * n :]
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4" if values.max(initial=0) < 1 << 32 else "<u8").tobytes() + (b"4" if values.max(initial=0) < 1 << 32 else b"8"), 1)


def _uncounts(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw[:-1], dtype="<u" + raw[-1:].decode()).astype(np.int64)


def _pack(keys: pa.Array, parts: pa.Array, texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys, parts, texts], ["key", "part", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.decompress(blob)).read_all().combine_chunks()
    return table.to_batches()[0]


def _blocks(block_bytes: int):
    """Rows (key, part, text) to packed blocks; deleted texts (part 1) have blocks of their own."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        made = 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(dev: bool) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held[dev]).combine_chunks().to_batches()[0]
            made, held[dev], size[dev] = made + 1, [], 0
            packed = _pack(*table.columns)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([dev]), pa.array([packed], pa.binary())], ["block", "dev", "payload"]
            )

        for batch in stream:
            is_dev = pa.compute.equal(batch.column(1), 1)
            for dev, part in ((True, batch.filter(is_dev)), (False, batch.filter(pa.compute.invert(is_dev)))):
                sizes = pa.compute.binary_length(part.column(2)).to_numpy(zero_copy_only=False)
                start = 0
                for i, s in enumerate(sizes.tolist()):
                    size[dev] += s + 1
                    if size[dev] >= block_bytes:
                        held[dev].append(part.slice(start, i + 1 - start))
                        start = i + 1
                        yield close(dev)
                if start < part.num_rows:
                    held[dev].append(part.slice(start))
        for dev in (True, False):
            if held[dev]:
                yield close(dev)

    return run


def _asks(shift: int):
    """Packed blocks to (block, shard, payload): distinct hashes and their counts in core and deleted texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _unpack(blob.as_buffer())
                bounds, h, before = tokens(rows.column(2))
                part = np.repeat(rows.column(1).to_numpy().astype(np.int8), np.diff(bounds))
                del rows
                pa.default_memory_pool().release_unused()
                by_shard: dict[int, list[bytes]] = {}
                for kind in range(2):
                    own, place = distinct(pairs(before, h) if kind else h)
                    if kind:
                        del before, h
                    core = np.bincount(place[part == 2], minlength=len(own))
                    dev = np.bincount(place[part == 1], minlength=len(own))
                    del place
                    shard = (own >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(own), dtype=np.int64)
                    cuts = np.flatnonzero(np.diff(shard)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                        if b > a:
                            got = by_shard.setdefault(int(shard[a]), [b"\x01", _counts(core[:0]), _counts(core[:0])] * 2)
                            got[3 * kind : 3 * kind + 3] = [_narrow(own[a:b]), _counts(core[a:b]), _counts(dev[a:b])]
                for shard in list(by_shard):
                    got = by_shard.pop(shard)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([_join(got)], pa.binary())],
                        ["block", "shard", "payload"],
                    )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """All asks of one hash range: total counts back to each block, and the range's share of N and V."""
    blocks = table.column("block").to_pylist()
    shard = table.column("shard")[0].as_py()
    asked = [_cut(p.as_buffer().to_pybytes(), 6) for p in table.column("payload")]
    replies: list[list[bytes]] = [[] for _ in blocks]
    totals = [0, 0, 0, 0]
    for kind in range(2):
        own = [_wide(a[3 * kind]) for a in asked]
        ends = np.cumsum([len(x) for x in own])
        keys, place = distinct(np.concatenate(own))
        core = np.bincount(place, np.concatenate([_uncounts(a[3 * kind + 1]) for a in asked]), len(keys)).astype(np.int64)
        dev = np.bincount(place, np.concatenate([_uncounts(a[3 * kind + 2]) for a in asked]), len(keys)).astype(np.int64)
        if kind == 0:
            totals = [int(core.sum()), int((core + dev).sum()), int((core > 0).sum()), int((core + dev > 0).sum())]
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            replies[i] += [_counts(core[place[a:b]]), _counts(dev[place[a:b]])]
    n = len(blocks)
    columns = [
        pa.array([*blocks, -1], pa.int64()),
        pa.array([shard] * (n + 1), pa.int32()),
        pa.array([*[_join(r) for r in replies], b""], pa.binary()),
        *[pa.array([0] * n + [t], pa.int64()) for t in totals],
    ]
    return pa.Table.from_arrays(columns, ["block", "shard", "payload", "n0", "n1", "v0", "v1"])


def _met(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Block and answers of one group: (rows, bounds, token, token before, counts: core and deleted of words, of pairs).

    Counts stand at the tokens; those of the context are words' counts one token before.
    """
    table = table.sort_by("shard")
    payloads = table.column("payload")
    rows = _unpack(payloads[0].as_buffer())
    bounds, h, before = tokens(rows.column(2))
    answers = [_cut(payloads[i].as_buffer().to_pybytes(), 4) for i in range(1, len(payloads))]
    place = [distinct(values)[1] for values in (h, pairs(before, h))]
    counts = [np.concatenate([_uncounts(a[k]) for a in answers])[place[k // 2]] for k in range(4)]
    return rows, bounds, h, before, counts


def _context(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Count of each token's context: a word's own count, as each word is followed by a token; at the begin, the number of texts."""
    found = np.empty_like(counts)
    found[1:] = counts[:-1]
    found[bounds[:-1]] = counts[bounds[1:] - 1]  # END occurs once in each text
    return found


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 count)."""
    return np.frexp(context.astype(float))[1]


def _ratios(n: int, v: int):
    def run(table: pa.Table) -> pa.Table:
        _, bounds, _, _, (word, _, pair, _) = _met(table)
        context = _context(word, bounds)
        scale = v + 1.0
        two = pair / np.maximum(context, 1) * scale
        one = word / max(n, 1) * scale
        bins = [np.where(x > 0, np.rint(np.log2(np.maximum(x, 1e-12)) * OCTAVE), -10_000).astype(np.int64) for x in (two, one)]
        key = (bucket_of(context) * 40_000 + bins[0] + 20_000) * 40_000 + bins[1] + 20_000
        keys, count = np.unique(key, return_counts=True)
        return pa.Table.from_arrays([pa.array(keys), pa.array(count)], ["ratio", "n"])

    return run


def learn_weights(ratio: np.ndarray, count: np.ndarray, steps: int = 100) -> np.ndarray:
    """(bucket, 3): weights of pair, word and uniform share in each context bucket, by EM on the counted ratios.

    A bucket without deleted tokens takes the weights of the nearest more frequent one, else of the nearest rarer one.
    """
    bucket, rest = np.divmod(ratio, 40_000 * 40_000)
    two, one = np.divmod(rest, 40_000)
    likely = np.column_stack([np.where(x > 5_000, 2.0 ** ((x - 20_000) / OCTAVE), 0.0) for x in (two, one)] + [np.ones(len(ratio))])
    found: dict[int, np.ndarray] = {}
    for b in np.unique(bucket).tolist():
        x, n = likely[bucket == b], count[bucket == b]
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(steps):
            share = x * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            new = np.maximum(new, [0.0 if b == 0 else 1e-9, 1e-9, 1e-6])  # what was never deleted may still occur
            new /= new.sum()
            done = np.abs(new - w).max() < 1e-7
            w = new
            if done:
                break
        found[int(b)] = w
    weights = np.zeros((BUCKETS, 3))
    for b in range(BUCKETS):
        near = [k for k in found if k >= b and k] or [k for k in found if k]
        w = found.get(b)
        if w is None:
            w = found[min(near, key=lambda k: abs(k - b))] if near else np.array([0.3, 0.6, 0.1])
            if b == 0:
                w = np.array([0.0, w[0] + w[1], w[2]])
        weights[b] = w
    return weights


def _scores(n: int, v: int, weights: np.ndarray, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows, bounds, _, _, counts = _met(table)
        word, pair = counts[0] + counts[1], counts[2] + counts[3]
        context = _context(word, bounds)
        w = weights[bucket_of(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        starts = bounds[:-1]
        numbers = [np.diff(bounds), np.add.reduceat((word > 0).astype(np.int64), starts), np.full(len(starts), n)]
        logs = [np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
        held = pa.compute.equal(rows.column(1), 0)
        return pa.Table.from_arrays([rows.column(0), held, *map(pa.array, numbers), *map(pa.array, logs)], names)

    return run


def interpolated_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Fold 0 of crc32(key) mod 10 is held out, fold 1 is deleted while the weights are learned. Null texts count as
    empty: one END. Null keys are in fold 0. Repeated rows count and are scored one by one. A word never trained on has
    count 0. An empty table gives an empty result.
    """
    fold = remainder(key, FOLDS)
    part = F.when(fold == 0, 0).when(fold == 1, 1).otherwise(2).cast("long")
    source = docs.select(column(key).alias("key"), part.alias("part"), text_of(text).alias("text"))
    packed = materialize(source.mapInArrow(_blocks(block_bytes), "block long, dev boolean, payload binary"), "lm-blocks")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / shard_bytes)))))
    asks = packed.select("block", "payload").mapInArrow(_asks(64 - bits), "block long, shard int, payload binary")
    answers = materialize(asks.groupBy("shard").applyInArrow(_answer, ANSWERS), "lm-answers")
    n0, n1, v0, v1 = (x or 0 for x in answers.where("block = -1").agg(*[F.sum(c) for c in ("n0", "n1", "v0", "v1")]).first())
    answered = answers.where("block >= 0").select("block", "shard", "payload")

    def met(blocks: DataFrame, answers: DataFrame):
        own = blocks.select("block", F.lit(-1).cast("int").alias("shard"), "payload")
        return own.unionByName(answers).groupBy("block")

    dev = packed.where("dev")
    theirs = answered.join(dev.select("block"), "block", "left_semi")
    ratios = met(dev, theirs).applyInArrow(_ratios(n0, v0), "ratio long, n long").groupBy("ratio").agg(F.sum("n").alias("n"))
    found = ratios.toPandas().sort_values("ratio")
    weights = learn_weights(found["ratio"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=float))
    schema = source.select(F.col("key").alias(key)).schema
    for name, kind in (("held_out", "boolean"), *((c, "long") for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return met(packed, answered).applyInArrow(_scores(n1, v1, weights, schema.names), schema)
