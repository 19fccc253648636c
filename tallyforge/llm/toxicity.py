"""Toxicity by a bidirectional gated recurrent network with attention over words and characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import gru
from tallyforge.llm import words as W

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
HIDDEN, INPUTS = 8, 6
#: Buckets of the word table, and of each table of character n-grams (first 4, first 5, last 3 bytes).
WORDS, CHARS = 1 << 15, 1 << 13
TABLES = (WORDS, CHARS, CHARS, CHARS)
#: Labelled rows, first by hash of their id, from which the network learns.
FIT_ROWS = 4000
#: Rows whose crc32(doc_id as text) is a multiple of this are never learned from.
FOLDS = 5
EPOCHS, ROUNDS, BATCH, RATE = 3, 2, 128, 0.01
LANES = 2048
SEED = 3
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x tables) bucket numbers and the texts' bounds; words lose up to 4 marks at either end."""
    w = W.find_words(data, offsets, lower=True)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(4):
        starts += (ends - starts > 1) & _PUNCTUATION[w.data[starts]]
        ends -= (ends - starts > 1) & _PUNCTUATION[w.data[ends - 1]]
    spans = [(starts, ends), (starts, np.minimum(starts + 4, ends)), (starts, np.minimum(starts + 5, ends)), (np.maximum(ends - 3, starts), ends)]
    hashed = [W.span_hashes(w.data, a, b) for a, b in spans]
    return np.stack([(h % np.uint64(n)).astype(np.int32) for h, n in zip(hashed, TABLES, strict=True)], axis=1).reshape(-1, len(TABLES)), w.bounds


def cut_windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of overlapping windows that cover every word; empty texts have none."""
    count = np.diff(bounds)
    windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = bounds[text] + nth * STRIDE
    return text, first, np.minimum(WINDOW, bounds[text + 1] - first)


def _layout(first: np.ndarray, size: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """(T x windows) word numbers and mask, in reading order or from each window's last word back."""
    t = np.arange(size.max())[:, None]
    mask = t < size
    return np.where(mask, first + (size - 1 - t if reverse else t), 0), mask


def start_weights(odds: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Embeddings hold the labelled rows' log-odds in one dimension, so unseen words are neutral."""
    rng = np.random.default_rng(SEED)
    weights: dict[str, np.ndarray] = {}
    for i, o in enumerate(odds):
        weights[f"e{i}"] = np.zeros((len(o), INPUTS), np.float32)
        weights[f"e{i}"][:, i % INPUTS] = o
    for d in ("f", "b"):
        weights[f"x{d}"] = rng.normal(0, 0.4, (INPUTS, 3 * HIDDEN)).astype(np.float32)
        weights[f"u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        weights[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    weights["a"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
    weights["o"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
    weights["k"] = np.zeros(1, np.float32)
    return weights


def _embed(w: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    return sum(w[f"e{i}"][inputs[..., i]] for i in range(len(TABLES)))


def _attend(w: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention over steps, and each window's pooled state."""
    e = np.where(mask, states @ w["a"], -1e9)
    p = np.exp(e - e.max(axis=0))
    p /= p.sum(axis=0)
    return p, np.einsum("tb,tbh->bh", p, states)


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch of windows."""
    ways, states = {}, []
    for d in ("f", "b"):
        at, mask = _layout(first, size, d == "b")
        x = _embed(w, inputs[at])
        h, kept = gru.forward(x @ w[f"x{d}"] + w[f"c{d}"], np.zeros((len(first), HIDDEN), np.float32), w[f"u{d}"], mask)
        ways[d] = (at, mask, x, kept)
        states.append(h)
    at, mask = ways["f"][:2]
    back = np.where(mask, size - 1 - np.arange(len(mask))[:, None], np.arange(len(mask))[:, None])
    lane = np.arange(len(first))
    both = np.concatenate((states[0], states[1][back, lane]), axis=2)
    p, pooled = _attend(w, both, mask)
    score = 1 / (1 + np.exp(-np.clip(pooled @ w["o"] + w["k"], -30, 30)))
    loss = float(-(weight * (label * np.log(score + 1e-7) + (1 - label) * np.log(1 - score + 1e-7))).sum() / weight.sum())
    d_logit = ((score - label) * weight / weight.sum()).astype(np.float32)
    g = {"o": pooled.T @ d_logit, "k": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["o"]
    d_p = np.einsum("tbh,bh->tb", both, d_pooled)
    d_e = p * (d_p - (p * d_p).sum(axis=0))
    g["a"] = np.einsum("tb,tbh->h", d_e, both)
    d_both = p[:, :, None] * d_pooled + d_e[:, :, None] * w["a"]
    shares = {"f": d_both[:, :, :HIDDEN], "b": d_both[:, :, HIDDEN:][back, lane]}
    for i in range(len(TABLES)):
        g[f"e{i}"] = np.zeros_like(w[f"e{i}"])
    for d, (at, mask, x, kept) in ways.items():
        d_gates, g[f"u{d}"] = gru.backward(np.where(mask[:, :, None], shares[d], 0).astype(np.float32), kept, w[f"u{d}"], mask)
        flat = d_gates.reshape(-1, 3 * HIDDEN)
        g[f"x{d}"], g[f"c{d}"] = x.reshape(-1, INPUTS).T @ flat, flat.sum(axis=0)
        d_x = (flat @ w[f"x{d}"].T)[mask.ravel()]
        rows = inputs[at].reshape(-1, len(TABLES))[mask.ravel()]
        for i in range(len(TABLES)):
            np.add.at(g[f"e{i}"], rows[:, i], d_x)
    return loss, g


def window_logits(w: dict[str, np.ndarray], inputs: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logit of every window, scored LANES at a time, longest first."""
    out = np.empty(len(first), np.float32)
    tables = {d: [w[f"e{i}"] @ w[f"x{d}"] + (w[f"c{d}"] if i == 0 else 0) for i in range(len(TABLES))] for d in ("f", "b")}
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        own, n = first[lanes], size[lanes]
        steps = int(n.max())
        states = np.zeros((steps, len(lanes), 2 * HIDDEN), np.float32)
        for d, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            h = np.zeros((len(lanes), HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                live = int(np.searchsorted(-n, -t))
                rows = inputs[own[:live] + t]
                gates = tables[d][0][rows[:, 0]]
                for i in range(1, len(TABLES)):
                    gates += tables[d][i][rows[:, i]]
                h[:live] = gru.step(gates, h[:live], w[f"u{d}"])
                states[t, :live, cut] = h[:live]
        _, pooled = _attend(w, states, np.arange(steps)[:, None] < n)
        out[lanes] = pooled @ w["o"] + w["k"]
    return out


def _text_max(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    out = np.full(texts, -20.0)
    np.maximum.at(out, text, values)
    return out


def _log_odds(inputs: np.ndarray, owner: np.ndarray, label: np.ndarray, buckets: int) -> np.ndarray:
    """How much likelier toxic rows are to have the bucket; 0 for what no toxic row has."""
    pairs = np.unique(owner.astype(np.int64) * buckets + inputs)
    toxic = label[pairs // buckets] == 1
    yes, no = (np.bincount(pairs[x] % buckets, minlength=buckets) for x in (toxic, ~toxic))
    odds = np.log((yes + 0.5) / (label.sum() + 1)) - np.log((no + 0.5) / ((1 - label).sum() + 1))
    return (np.maximum(odds, 0) * yes / (yes + 4.0) / 2).astype(np.float32)


def fit(inputs: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Train on windows: of a toxic row its most telling window, of a clean row that and one more.

    The first round picks by log-odds, later ones by the network itself. At last the texts'
    largest logits are calibrated to the labels.
    """
    owner = np.repeat(np.arange(len(label)), np.diff(bounds))
    odds = [_log_odds(inputs[:, i], owner, label, n) for i, n in enumerate(TABLES)]
    w = start_weights(odds)
    w["scale"] = np.array([1.0, 0.0], np.float32)
    text, first, size = cut_windows(bounds)
    if not len(text) or label.min(initial=1) == label.max(initial=0):
        return w
    told = np.concatenate(([0], np.cumsum(sum(o[inputs[:, i]] for i, o in enumerate(odds)))))
    logits = told[first + size] - told[first]
    rng = np.random.default_rng(SEED)
    net = {k: v for k, v in w.items() if k != "scale"}
    for _ in range(ROUNDS):
        best = np.lexsort((-logits, text))
        head = best[np.concatenate(([True], text[best][1:] != text[best][:-1]))]
        other = rng.permutation(np.flatnonzero(label[text] == 0))[: len(head)]
        chosen = np.concatenate((head, other))
        y = label[text[chosen]].astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
        adam = gru.Adam(net, RATE)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chosen))
            for lo in range(0, len(order), BATCH):
                b = order[lo : lo + BATCH]
                adam.update(net, gradients(net, inputs, first[chosen[b]], size[chosen[b]], y[b], weight[b])[1])
        logits = window_logits(net, inputs, first, size)
    top = _text_max(logits, text, len(label))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        a, b = a - 0.05 * float(((p - label) * top).mean()), b - 0.3 * float((p - label).mean())
    return net | {"scale": np.array([max(a, 0.05), b], np.float32)}


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Weights learned from at most ``fit_rows`` labelled documents outside the held-out fold; of an id with several texts, from the first."""
    chosen = learnable(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_toxic").alias("_toxic")).orderBy("doc_id").select("text", "_toxic").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(np.zeros((0, len(TABLES)), np.int32), np.zeros(1, np.int64), np.zeros(0))
    inputs, bounds = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in W.chunks(rows.column("text").chunk(0)):
        x, b = word_inputs(data, offsets)
        inputs.append(x)
        bounds.append(bounds[-1][-1] + b[1:])
    return fit(np.concatenate(inputs), np.concatenate(bounds), rows.column("_toxic").to_numpy().astype(np.float64))


def score_documents(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text: its most toxic window's logit, calibrated.

    Null and empty texts, which have no window, take the lowest logit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column("text")):
                inputs, bounds = word_inputs(data, offsets)
                text, first, size = cut_windows(bounds)
                top = _text_max(window_logits(w, inputs, first, size), text, to - at)
                score = 1 / (1 + np.exp(-np.clip(w["scale"][0] * top + w["scale"][1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score and predicted.

    Repeated rows score alike; null ids count as learnable but are never learned from;
    columns beyond doc_id and text are not read.
    """
    scored = score_documents(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
