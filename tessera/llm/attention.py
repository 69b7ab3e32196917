"""Quality classifier: gated attention over a document's passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import row_key

#: Bytes of a passage, and passages encoded at once.
PASSAGE, ENCODED = 512, 4096
#: Byte kinds that features count: the printable groups of `_kinds`, and pairs of them.
KINDS, LETTER_PAIRS = 13, 64


def _kinds() -> np.ndarray:
    """A kind for each byte value."""
    kind = np.full(256, 12, dtype=np.int64)
    for k, group in enumerate((b".,;:", b"!?", b"|", b"%$&#*@~^+=", b"'\"-()", b" ", b"\n", b"\t\r\x0b\x0c")):
        kind[list(group)] = k
    kind[ord("a") : ord("z") + 1] = 8
    kind[ord("A") : ord("Z") + 1] = 9
    kind[ord("0") : ord("9") + 1] = 10
    kind[128:] = 11
    return kind


KIND = _kinds()
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.int64)
FEATURES = KINDS + KINDS * KINDS + LETTER_PAIRS + 4


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every passage of texts that lie end to end; an empty text has an empty one."""
    count = np.maximum(1, -(-sizes // PASSAGE))
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(sizes) - sizes)[text]
    return text, begin + nth * PASSAGE, begin + np.minimum((nth + 1) * PASSAGE, sizes[text])


def encoded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A feature row per passage.

    Shares of byte kinds, of pairs of kinds, of letter pairs and of repeated bytes, the share of
    distinct words and of words that repeat the one before, and the length.
    """
    found = np.zeros((len(start), FEATURES), dtype=np.float32)
    size = end - start
    if not len(start):
        return found
    base = start[0]
    part = data[base : end[-1]]
    which = np.repeat(np.arange(len(size)), size)
    kind = KIND[part]
    n = np.maximum(size, 1)[:, None]
    at = KINDS
    found[:, :at] = np.bincount(which * KINDS + kind, minlength=len(size) * KINDS).reshape(-1, KINDS) / n
    inner = which[1:] == which[:-1]
    owner = which[1:][inner]
    pair = (kind[:-1] * KINDS + kind[1:])[inner]
    wide = KINDS * KINDS
    found[:, at : at + wide] = np.bincount(owner * wide + pair, minlength=len(size) * wide).reshape(-1, wide) / n
    at += wide
    folded = FOLDED[part]
    letters = ((folded[:-1] * 37 + folded[1:]) % LETTER_PAIRS)[inner]
    shape = len(size) * LETTER_PAIRS
    found[:, at : at + LETTER_PAIRS] = np.bincount(owner * LETTER_PAIRS + letters, minlength=shape).reshape(-1, LETTER_PAIRS) / n
    plain = part.tobytes()
    for row, (a, b) in enumerate(zip((start - base).tolist(), (end - base).tolist(), strict=True)):
        words = plain[a:b].split()
        if words:
            found[row, -4] = len(set(words)) / len(words)
            found[row, -3] = sum(map(eq, words, words[1:])) / len(words)
    found[:, -2] = np.bincount(owner, part[1:][inner] == part[:-1][inner], minlength=len(size)) / n[:, 0]
    found[:, -1] = size / PASSAGE
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and each text's size; null is empty."""
    column = column.cast(pa.large_binary())
    sizes = np.zeros(len(column), dtype=np.int64)
    if not len(column):
        return np.empty(0, dtype=np.uint8), sizes
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], np.diff(ends)


@dataclass(frozen=True)
class GatedAttention:
    """Weights of the network; `scores` are probabilities of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def scores(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A score per text; passages are encoded in blocks, whatever the length of a text."""
        text, start, end = passages(sizes)
        hidden, gate = [], []
        for at in range(0, len(text), ENCODED):
            some = slice(at, at + ENCODED)
            h, e = self._passages((encoded(data, start[some], end[some]) - self.mean) * self.scale)[:2]
            hidden.append(h.astype(np.float32))
            gate.append(e)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        z = _pooled(np.concatenate(hidden), np.concatenate(gate), text, first)[0]
        return _sigmoid(z @ self.weights[6] + self.weights[7][0])

    def _passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        w, b, v, bv, u, bu, _, _, a = self.weights
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v + bv), _sigmoid(h @ u + bu)
        return h, (t * g) @ a, t, g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pooled(h: np.ndarray, e: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention-weighted mean of each text's passages, and the weights."""
    power = np.exp(e - np.maximum.reduceat(e, first)[text])
    share = power / np.add.reduceat(power, first)[text]
    return np.add.reduceat(h * share[:, None], first, axis=0), share


def trained(
    data: np.ndarray, sizes: np.ndarray, labels: np.ndarray, hidden: int = 16, steps: int = 600, batch: int = 64, seed: int = 7
) -> GatedAttention:
    """A network fitted to document labels (0 to 1) by ``steps`` of Adam on the cross-entropy of batches."""
    text, start, end = passages(sizes)
    x = np.concatenate([encoded(data, start[k : k + ENCODED], end[k : k + ENCODED]) for k in range(0, len(text), ENCODED)])
    mean, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-2)
    x = (x - mean) * scale
    random = np.random.RandomState(seed)
    shapes = [(FEATURES, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden,), (1,), (hidden,)]
    weights = [random.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for s in shapes]
    weights[6], weights[8] = random.normal(0, 0.3, hidden), random.normal(0, 0.3, hidden)
    rate = np.clip(labels.mean(), 0.01, 0.99)
    weights[7][0] = np.log(rate / (1 - rate))
    slope, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    count = np.diff(begin, append=len(text))
    waiting = np.empty(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if len(waiting) < batch:
            waiting = np.concatenate((waiting, random.permutation(len(sizes))))
        docs, waiting = waiting[:batch], waiting[batch:]
        own = np.repeat(np.arange(len(docs)), count[docs])
        first = np.cumsum(count[docs]) - count[docs]
        rows = begin[docs][own] + np.arange(len(own)) - first[own]
        grads = _gradients(tuple(weights), x[rows], labels[docs], own, first)
        for k, g in enumerate(grads):
            g = g + 1e-4 * weights[k]
            slope[k] = 0.9 * slope[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            move = slope[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            weights[k] = weights[k] - 0.005 * move
    return GatedAttention(mean, scale, tuple(weights))


def _gradients(weights: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, own: np.ndarray, first: np.ndarray) -> list:
    _, _, v, _, u, _, c, c0, a = weights
    h, e, t, g = GatedAttention(np.zeros(1), np.ones(1), weights)._passages(x)
    z, share = _pooled(h, e, own, first)
    error = (_sigmoid(z @ c + c0[0]) - y) / len(y)
    dz = error[:, None] * c
    of_share = (h * dz[own]).sum(axis=1)
    de = share * (of_share - np.add.reduceat(share * of_share, first)[own])
    dt, dg = de[:, None] * a * g * (1 - t * t), de[:, None] * a * t * g * (1 - g)
    dh = (share[:, None] * dz[own] + dt @ v.T + dg @ u.T) * (1 - h * h)
    return [
        x.T @ dh, dh.sum(axis=0), h.T @ dt, dt.sum(axis=0), h.T @ dg, dg.sum(axis=0),
        z.T @ error, np.array([error.sum()]), (t * g).T @ de,
    ]


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, whose labels are never learned from; null ids belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learned(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str,
    text: str,
    label: str,
    sample: int = 3000,
    longest: int = 1 << 16,
    budget: int = 32 << 20,
) -> GatedAttention | None:
    """A network learned from at most ``sample`` labelled documents that are not held out.

    The labelled ids with the smallest hashes are taken; of several labels of one id the mean counts,
    of several texts the one with the smallest hash. Texts of over ``longest`` bytes are left out of
    the sample, and it ends, in order of the id hashes, where its texts would exceed ``budget`` bytes,
    which bounds what reaches the driver. None where nothing is labelled.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label")).dropna()
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.avg("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(size <= longest)
    some = some.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min_by("_text", row_key(F.col("_text"))).alias("_text"))
    # at most ``sample`` rows in one window
    upto = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(Window.orderBy(F.xxhash64("_id"), "_id"))
    rows = some.withColumn("_upto", upto).where(F.col("_upto") <= budget).orderBy("_id").collect()
    if not rows:
        return None
    data, sizes = text_bytes(pa.array([r["_text"] or "" for r in rows], pa.string()))
    return trained(data, sizes, np.array([r["_label"] for r in rows]))


def scored(docs: DataFrame, columns: list[str], text: str, model: GatedAttention | None, score: str = "score") -> DataFrame:
    """``columns`` of every row with its ``score``, from the whole text and nothing else.

    Null and empty texts are one empty passage. Without a model every score is one half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.mean, model.scale, model.weights))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value and GatedAttention(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, sizes = text_bytes(part.column(0))
                found = np.full(len(sizes), 0.5) if network is None else network.scores(data, sizes)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found)], names=[*part.schema.names[1:], score])

    return docs.select(F.col(text).alias("_scored_text"), *columns).mapInArrow(rated, f"{kinds}, `{score}` double")
