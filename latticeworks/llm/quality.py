"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded, groups of four bytes are convolved in
pairs (eight bytes, stride four) by learned filters, rectified, and max-pooled
within chunks of ``CHUNK`` bytes that overlap by half and cover the whole text.
A hidden layer turns each chunk's maxima into features; their maximum and their
mean over all chunks of the document give one probability.

Labels are learned only from rows outside the held-out fold (crc32 of the
doc_id as text, modulo 5, not 0). The fit uses a bounded sample of labelled
documents, chosen by a hash of their id: at most ``max_rows``, and as many as
have ``max_bytes`` bytes together. Of each it reads the whole text, all chunks,
as scoring does; chunks pass the network in blocks, so that a very long text
takes no more memory than a block and its chunks' features.

Defined cases: null and empty texts score as one chunk of padding; a label other
than 0 or 1, or of a null id, is none, and an id with both labels is left out;
of rows that repeat a labelled id the shortest, then first, text is read; a table with no
usable labels gives a constant score (the mean label, or 0.5 with none);
repeated rows get equal scores; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, tidied, unpacked

GROUP, CHUNK, EMBED, FILTERS, HIDDEN = 4, 256, 8, 48, 24
HALF = CHUNK // 2
#: Chunks that are convolved at once; bounds the memory of a task.
BLOCK = 4096
#: Texts of a batch that a task takes out at once.
ROWS = 512
#: Chunks that are trained on at once, and passes over the sample.
TRAIN_BLOCK, EPOCHS = 2048, 6
THRESHOLD = 0.3


@dataclass
class Net:
    """Weights; ``const`` replaces them where there was nothing to learn."""

    embed: np.ndarray
    conv_a: np.ndarray
    conv_b: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    const: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv_a, self.conv_b, self.bias, self.hidden, self.hidden_bias, self.out]


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)

    def w(*shape: int, scale: float) -> np.ndarray:
        return (r.standard_normal(shape) * scale).astype(np.float32)

    wide = GROUP * EMBED
    return Net(
        w(257, EMBED, scale=0.5), w(wide, FILTERS, scale=0.2), w(wide, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
        w(FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), w(2 * HIDDEN, scale=0.2), 0.0,
    )


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping chunks (rows of byte codes, 256 is padding) and each text's first row."""
    starts, rows = [], []
    n = 0
    for t in texts:
        starts.append(n)
        halves = max(2, -(-len(t) // HALF))
        codes = np.full(halves * HALF, 256, np.int16)
        codes[: len(t)] = np.frombuffer(t, np.uint8)
        pieces = codes.reshape(halves, HALF)
        rows.append(np.concatenate([pieces[:-1], pieces[1:]], axis=1))
        n += halves - 1
    return np.concatenate(rows) if rows else np.zeros((0, CHUNK), np.int16), np.array(starts, np.int64)


def pooled(net: Net, codes: np.ndarray, with_arg: bool = False):
    """Max-pooled filter responses of chunks; optionally the group each came from."""
    n = len(codes)
    x = net.embed[codes].reshape(n * (CHUNK // GROUP), GROUP * EMBED)
    a = (x @ net.conv_a).reshape(n, CHUNK // GROUP, FILTERS)
    b = (x @ net.conv_b).reshape(n, CHUNK // GROUP, FILTERS)
    y = a[:, :-1] + b[:, 1:]
    if with_arg:
        at = y.argmax(axis=1)
        top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
        return np.maximum(top + net.bias, 0), at, x.reshape(n, CHUNK // GROUP, GROUP * EMBED)
    return np.maximum(y.max(axis=1) + net.bias, 0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    if net.const is not None:
        return np.full(len(texts), net.const)
    out = np.empty(len(texts))
    lo = 0
    while lo < len(texts):  # texts that make about BLOCK chunks; a longer one alone, in blocks
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) // HALF < BLOCK):
            n += len(texts[hi]) // HALF + 1
            hi += 1
        codes, starts = chunks_of(texts[lo:hi])
        h = np.concatenate([np.maximum(pooled(net, codes[i : i + 512]) @ net.hidden + net.hidden_bias, 0) for i in range(0, len(codes), 512)])
        sizes = np.diff(np.append(starts, len(codes)))
        both = np.concatenate([np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes[:, None]], axis=1)
        out[lo:hi] = sigmoid(both @ net.out + net.out_bias)
        lo = hi
    return out


def _features(net: Net, codes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Hidden features of all chunks, block by block; with what the filters saw if there is one block."""
    h, seen = [], []
    for lo in range(0, len(codes), TRAIN_BLOCK):
        p, at, x = pooled(net, codes[lo : lo + TRAIN_BLOCK], True)
        h.append(np.maximum(p @ net.hidden + net.hidden_bias, 0))
        if len(codes) <= TRAIN_BLOCK:
            seen.append((p, at, x))
    return np.concatenate(h), seen


def _gradients(net: Net, codes: np.ndarray, dh: np.ndarray, seen: list[tuple]) -> list[np.ndarray]:
    """Of the embedding, both halves of the filters, their bias, the hidden layer and its bias."""
    total = [np.zeros_like(x) for x in (net.embed, net.conv_a, net.conv_b, net.bias, net.hidden, net.hidden_bias)]
    for lo in range(0, len(codes), TRAIN_BLOCK):
        own, d = codes[lo : lo + TRAIN_BLOCK], dh[lo : lo + TRAIN_BLOCK]
        p, at, x = seen[0] if seen else pooled(net, own, True)
        dp = (d @ net.hidden.T) * (p > 0)
        rows = np.arange(len(own))[:, None]
        groups = own.reshape(len(own), CHUNK // GROUP, GROUP)
        de = np.zeros_like(net.embed)
        halves = []
        for shift, w in ((0, net.conv_a), (1, net.conv_b)):
            halves.append(np.einsum("nfw,nf->wf", x[rows, at + shift], dp, optimize=True))
            flat = (dp[:, :, None] * w.T[None]).reshape(-1, EMBED)
            idx = groups[rows, at + shift].reshape(-1)
            for k in range(EMBED):
                de[:, k] += np.bincount(idx, flat[:, k], 257)
        for t, g in zip(total, (de, *halves, dp.sum(0), p.T @ d, d.sum(0)), strict=True):
            t += g
    return total


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Fit by Adam on the log loss, over all chunks; gradients flow through the pooled maxima only."""
    net = new_net(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.const = float(y.mean()) if len(y) else 0.5
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    weight = np.sqrt(weight)
    r = np.random.default_rng(seed)
    params = [*net.parts(), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        order = r.permutation(len(texts))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            codes, starts = chunks_of([texts[i] for i in pick])
            sizes = np.diff(np.append(starts, len(codes)))
            owner = np.repeat(np.arange(len(pick)), sizes)
            h, seen = _features(net, codes)
            top, mean = np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes[:, None]
            both = np.concatenate([top, mean], axis=1)
            net.out_bias = float(params[-1][0])
            dz = ((sigmoid(both @ net.out + net.out_bias) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dboth = dz[:, None] * net.out
            dh = np.where(h == top[owner], dboth[owner, :HIDDEN], 0) + dboth[owner, HIDDEN:] / sizes[owner][:, None]
            dh = dh * (h > 0)
            grads = [*_gradients(net, codes, dh, seen), both.T @ dz, np.array([dz.sum()], np.float32)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.out_bias = float(params[-1][0])
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is in the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """Whole texts and labels of the sample, in order of their ids' hashes: rows as long as they fit."""
    named = (
        labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
        .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    own = texts.join(F.broadcast(named), "_id")
    sizes = own.groupBy("_id", "_h").agg(F.min(F.octet_length("_t")).alias("_n")).orderBy("_h", "_id").collect()  # at most max_rows
    picked, left = [], max_bytes
    for r in sizes:
        if r["_n"] <= left:
            picked.append(r["_id"])
            left -= r["_n"]
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in picked], docs.select(F.col(id_col).alias("_id")).schema)
    rows = own.join(F.broadcast(chosen), "_id").groupBy("_id", "_h", "_y").agg(F.min_by("_t", F.struct(F.octet_length("_t"), "_t")).alias("_t")).collect()
    return [(r["_t"].encode("utf-8", "replace"), r["_y"]) for r in sorted(rows, key=lambda r: (r["_h"], r["_id"]))]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """Learn from at most ``max_rows`` labelled rows of ``max_bytes`` bytes together, outside the held-out fold."""
    rows = sampled(docs, labels, max_rows, max_bytes, id_col, text_col)
    return train([t for t, _ in rows], [y for _, y in rows])


def score(text: Column, net: Net) -> Column:
    """Column of scores, 0 to 1."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:  # thousands of whole texts, of which a few are taken out at once
            raw = t.cast(pa.binary())
            own = [score_texts(net, [x or b"" for x in raw.slice(lo, ROWS).to_pylist()]) for lo in range(0, len(raw), ROWS)]
            yield pa.array(np.concatenate([np.zeros(0), *own]))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(scores)(batches)

    return scored(text)


def keep(docs: DataFrame, net: Net, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score below the threshold; columns as they were."""
    scored = packed(docs, _t=text_col).withColumn("_score", score(F.col("_t"), net))
    return unpacked(scored.where(F.col("_score") >= threshold), docs.columns)


def classify(docs: DataFrame, net: Net, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row."""
    return (
        docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col), net).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
