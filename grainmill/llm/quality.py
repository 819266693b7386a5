"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. Each byte is embedded,
learned filters slide over a chunk and are max-pooled in it; the mean and the maximum of the
chunks' pooled values are combined into one probability by a logistic unit. Embedding, filters
and unit are trained together with Adam by backpropagation through the pooled positions.

The model is fitted on at most SAMPLE labelled rows, those with the smallest hash of their
doc_id, with all chunks of their whole texts.
Scoring takes every chunk of every text. A chunk weighs in the mean by the bytes that
it alone starts, so padding and overlap count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.words import text_bytes

CHUNK, OVERLAP, WIDTH, STRIDE = 256, 32, 8, 2
DIMS, FILTERS = 5, 24
SAMPLE, EPOCHS, BATCH = 1500, 14, 32
THRESHOLD, SEED = 0.3, 11
#: Chunks that pass through the filters at a time.
STEP = 128
_STARTS = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; one, of padding alone, if n is 0."""
    hop = CHUNK - OVERLAP
    return np.arange(0, max(1, n - OVERLAP), hop)


def chunks_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunks as rows of 1 + byte, 0 where the text has ended."""
    at = starts[:, None] + np.arange(CHUNK)[None, :]
    inside = at < len(raw)
    out = np.zeros(at.shape, np.int16)
    out[inside] = raw[at[inside]].astype(np.int16) + 1
    return out


class Network:
    def __init__(self, rng: np.random.Generator):
        f32 = np.float32
        self.w = {
            "embed": rng.normal(0, 0.5, (257, DIMS)).astype(f32),
            "filter": (rng.normal(0, 1, (WIDTH * DIMS, FILTERS)) / np.sqrt(WIDTH * DIMS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "unit": (rng.normal(0, 0.1, 2 * FILTERS)).astype(f32),
            "base": np.zeros(1, f32),
        }
        self.w["embed"][0] = 0

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Max-pooled filters of each chunk, and the windows that gave them."""
        out, arg = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int32)
        # a window is some steps of STRIDE bytes: each step meets its part of the filters once, and windows add them up
        steps = WIDTH // STRIDE
        parts = self.w["filter"].reshape(steps, STRIDE * DIMS, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIMS, steps * FILTERS)
        for a in range(0, len(chunks), STEP):
            x = self.w["embed"][chunks[a : a + STEP]].reshape(-1, STRIDE * DIMS) @ parts
            x = x.reshape(-1, CHUNK // STRIDE, steps, FILTERS)
            x = sum(x[:, k : k + len(_STARTS), k] for k in range(steps))
            if where:
                arg[a : a + STEP] = x.argmax(axis=1)
            out[a : a + STEP] = x.max(axis=1)
        out += self.w["bias"]
        return (np.tanh(out), np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE], arg) if where else np.tanh(out)

    def score(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = np.concatenate([mean, most], axis=1) @ self.w["unit"] + self.w["base"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, chunks: np.ndarray, of: np.ndarray, weight: np.ndarray, y: np.ndarray) -> dict:
        h, windows, arg = self.pooled(chunks, where=True)
        n = len(y)
        mean = np.zeros((n, FILTERS), np.float32)
        np.add.at(mean, of, h * weight[:, None])
        first = np.searchsorted(of, np.arange(n))
        most = np.maximum.reduceat(h, first, axis=0)
        dz = ((self.score(mean, most) - y) / n).astype(np.float32)
        grad = {"unit": np.concatenate([mean, most], axis=1).T @ dz, "base": dz.sum(keepdims=True)}
        dh = (dz[:, None] * self.w["unit"][None, :FILTERS])[of] * weight[:, None]
        top = h == most[of]  # of chunks that share a window in their overlap, the first one
        seen = np.cumsum(top, axis=0)
        top &= seen - (seen[first] - top[first])[of] == 1
        dh += np.where(top, (dz[:, None] * self.w["unit"][None, FILTERS:])[of], 0)
        dx = dh * (1 - h * h)
        grad["bias"] = dx.sum(0)
        win = windows[np.arange(len(chunks))[:, None], arg]  # chunk, filter, byte
        grad["filter"] = np.einsum("cf,cfx->xf", dx, self.w["embed"][win].reshape(len(chunks), FILTERS, WIDTH * DIMS))
        back = dx[:, :, None, None] * self.w["filter"].T.reshape(1, FILTERS, WIDTH, DIMS)
        grad["embed"] = np.stack([np.bincount(win.ravel(), weights=back[..., d].ravel(), minlength=257) for d in range(DIMS)], axis=1).astype(self.w["embed"].dtype)
        grad["embed"][0] = 0
        return grad


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Network:
    """Fit on documents given as their bytes."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    if not len(labels):
        return net
    rate = float(np.clip(labels.mean(), 0.02, 0.98))
    net.w["base"][:] = np.log(rate / (1 - rate))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    epochs = max(EPOCHS, min(60, 1500 * BATCH // max(1, len(labels))))
    t, total = 0, epochs * -(-len(labels) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            starts = [chunk_starts(len(texts[i])) for i in part]
            of = np.repeat(np.arange(len(part)), list(map(len, starts)))
            chunks = np.concatenate([chunks_of(texts[i], s) for i, s in zip(part, starts, strict=True)])
            weight = np.concatenate([_weights(len(texts[i]), s) for i, s in zip(part, starts, strict=True)])
            grad = net.gradients(chunks, of, weight, labels[part])
            t += 1
            step = 0.01 * (1 - t / (total + 1)) + 0.0005
            for k, g in grad.items():
                m, v = moment[k]
                if k in ("filter", "unit"):
                    g = g + 1e-5 * net.w[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.w[k] -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def _weights(n: int, starts: np.ndarray) -> np.ndarray:
    """Share of the text that each chunk alone starts."""
    ends = np.append(starts[1:], max(n, starts[-1] + 1))
    return ((ends - starts) / (ends[-1] - starts[0])).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[list, np.ndarray]:
    """The bytes and the label of at most `sample` labelled documents that aren't held out."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(known, "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that repeat a doc_id count once, so `sample` bounds what the driver gets
    rows = texts.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("one")).select("doc_id", "one.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(r["text"].encode(), np.uint8) for r in rows], np.array([r["y"] for r in rows], np.float32)


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of every text of a column, from all of its chunks."""
    raw, offs = text_bytes(texts)
    mean, most = np.zeros((len(texts), FILTERS), np.float32), np.full((len(texts), FILTERS), -np.inf, np.float32)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        starts = chunk_starts(int(b - a))
        weight = _weights(int(b - a), starts)
        for s in range(0, len(starts), STEP):
            h = net.pooled(chunks_of(raw[a:b], starts[s : s + STEP]))
            mean[i] += weight[s : s + STEP] @ h
            np.maximum(most[i], h.max(axis=0), out=most[i])
    return net.score(mean, most)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels are learnt from rows that aren't held out; a document without a text, or
    with an empty one, gets the score of a chunk of padding. Rows that repeat each give a row, a null
    doc_id is not held out and never learnt from, other columns are left aside. Without any usable
    label the score is that of the untrained network; an empty table gives an empty one.
    """
    net = train(*training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", label), label, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text the classifier doesn't reject, with all their columns.

    Null and empty texts are judged by the score of a chunk of padding, and rows that repeat or have no doc_id are
    judged like others. An empty table gives an empty one.
    """
    net = train(*training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "quality", sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(net, batch.column("text")) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
