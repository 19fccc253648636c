"""Language-model scores by a gated recurrent network with a class-factored softmax.

A token's probability is that of its class given the state, times that of the token given its
class and the state. The frequent words of a class have weights of their own in the second
softmax, and as inputs; the others share its last place, and that place is divided among them
by their counts in the whole training corpus, with one added to each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import gru
from tallyforge.llm import words as W
from tallyforge.llm.shared import materialise

#: Rows with crc32(doc_id as text) mod FOLDS == HELD are held out.
FOLDS, HELD = 7, 2
#: Class 0 is the end; then the most frequent words, each alone; then groups of words.
SINGLES, GROUPS = 31, 32
CLASSES = 1 + SINGLES + GROUPS
#: Places of a group: its most frequent words, and one for all its others. A slot is a class's place.
MEMBERS = 32
SLOTS = 1 + SINGLES + GROUPS * MEMBERS
#: Most frequent words among which the groups' own are looked for.
FREQUENT = 1 << 15
HIDDEN, INPUTS = 24, 16
#: Words of whole documents that are encoded as one block; a longer document is one alone.
BLOCK_WORDS = 3_000_000
#: Tokens between truncations of the gradient, and streams of documents side by side.
STEPS, LANES = 32, 512
#: Tokens of whole documents that are laid out as streams together, and tokens in one task, by its mean.
SLAB, TASK_TOKENS = 1 << 22, 1 << 23
#: Rounds of averaging; a hash of its id gives each training document the one round that trains on it.
ROUNDS = 2
RATE = 0.02
#: Averages and profiles are summed as whole multiples of 1 / FIXED, so that no order of addition shows.
FIXED = 1 << 20
#: Weights in one part of a task's vector.
PART = 512
PROFILE = 32
SEED = 9
ENCODED = "kind int, pid long, doc_id long, held_out boolean, ids binary, key long, shape int, n long, value long"
_ARROW = pa.schema([("kind", pa.int32()), ("pid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("key", pa.int64()), ("shape", pa.int32()), ("n", pa.int64()), ("value", pa.int64())])
DOCUMENT, WORD, SHAPE = 0, 1, 2
_BUCKET = np.full(256, PROFILE - 1, np.int64)
_BUCKET[97:123] = np.arange(26)
_BUCKET[[*range(0x80, 0xC0)]] = 26 + np.arange(64) % 5


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


def encode(docs: DataFrame) -> DataFrame:
    """Documents as ranks of their words in their block's vocabulary, and what each block counts.

    Rows of kind DOCUMENT hold the ranks; of kind WORD a block's distinct word (its hash), its
    shape (last two bytes) and count in training documents; of kind SHAPE the sums of the
    letter profiles of the documents in which words of a shape stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        hashes: list = []
        shapes: list = []
        lengths: list = []
        profiles = np.zeros((1 << 16, PROFILE), np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            pid = (task << 20) + block
            size, out = np.concatenate(lengths), np.concatenate(held)
            every = np.concatenate(hashes)
            vocabulary, first, rank = np.unique(every, return_index=True, return_inverse=True)
            seen = np.bincount(rank[np.repeat(~out, size)], minlength=len(vocabulary))
            shape = np.concatenate(shapes)[first]
            ends = np.cumsum(size)
            ranks = [rank[e - s : e].astype("<u4").tobytes() for s, e in zip(size, ends, strict=True)]
            yield _rows(DOCUMENT, len(size), pid=np.full(len(size), pid), doc_id=pa.chunked_array(ids).combine_chunks(), held_out=out, ids=ranks)
            yield _rows(WORD, len(vocabulary), pid=np.full(len(vocabulary), pid), key=vocabulary.view(np.int64), shape=shape.astype(np.int32), n=seen)

        for batch in batches:
            column = batch.column("doc_id")
            for at, to, data, offsets in W.chunks(batch.column("text")):
                w = W.find_words(data, offsets, lower=True)
                hashes.append(w.hashes())
                last, before = w.data[w.ends - 1].astype(np.int64), w.data[np.maximum(w.ends - 2, w.starts)].astype(np.int64)
                shapes.append((before << 8 | last).astype(np.uint16))
                size = np.diff(w.bounds)
                lengths.append(size)
                ids.append(column.slice(at, to - at))
                held.append(batch.column("held_out").slice(at, to - at).to_numpy(zero_copy_only=False).astype(bool))
                letters = np.repeat(np.arange(to - at), np.diff(offsets))
                profile = np.bincount(letters * PROFILE + _BUCKET[w.data], minlength=(to - at) * PROFILE).reshape(-1, PROFILE).astype(float)
                profile = np.rint(profile * FIXED / np.maximum(profile.sum(axis=1, keepdims=True), 1)).astype(np.int64)
                pair, n = np.unique(w.owner()[~held[-1][w.owner()]] << 16 | shapes[-1][~held[-1][w.owner()]], return_counts=True)
                kind = pair & 0xFFFF
                order = np.argsort(kind, kind="stable")
                if len(order):
                    edge = np.flatnonzero(np.concatenate(([True], kind[order][1:] != kind[order][:-1])))
                    profiles[kind[order][edge]] += np.add.reduceat(profile[pair[order] >> 16] * n[order][:, None], edge)
                if sum(x.sum() for x in lengths) >= BLOCK_WORDS:
                    yield from close()
                    block += 1
                    for x in (ids, held, hashes, shapes, lengths):
                        x.clear()
        if lengths:
            yield from close()
        at = np.flatnonzero(profiles.any(axis=1))
        if len(at):
            yield _rows(SHAPE, len(at) * PROFILE, shape=np.repeat(at, PROFILE).astype(np.int32), key=np.tile(np.arange(PROFILE), len(at)), value=profiles[at].ravel())

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, ENCODED)


def group_shapes(profiles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Group number of each shape, by k-means over the standardised letter profiles around it."""
    if not len(profiles):
        return np.zeros(0, np.int64)
    mean = np.average(profiles, axis=0, weights=weight)
    x = (profiles - mean) / np.sqrt(np.average((profiles - mean) ** 2, axis=0, weights=weight) + 1e-12)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[[int(np.argmax(weight))]]
    while len(centres) < min(GROUPS, len(x)):
        far = (1 - (x @ centres.T).max(axis=1)) * np.sqrt(weight)
        centres = np.concatenate((centres, x[[int(np.argmax(far))]]))
    for _ in range(12):
        mine = np.argmax(x @ centres.T, axis=1)
        for k in range(len(centres)):
            own = mine == k
            if own.any():
                centres[k] = np.average(x[own], axis=0, weights=weight[own])
                centres[k] /= max(np.linalg.norm(centres[k]), 1e-9)
    return np.argmax(x @ centres.T, axis=1)


class Vocabulary:
    """What tasks need of the corpus: bounded by SLOTS and the number of shapes (65,536)."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray, shape_group: np.ndarray, tokens: int, types: int, ends: int, slot_tokens: np.ndarray, rest_types: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.slots, self.shape_group = keys[order], slots[order], shape_group
        self.tokens, self.types, self.ends = tokens, types, ends
        self.slot_tokens, self.rest_types = slot_tokens, rest_types

    def slots_of(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Slot of each word: its own, or the last of its group."""
        out = SINGLES + MEMBERS * (1 + self.shape_group[shapes])
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = self.keys[at] == keys
            out[own] = self.slots[at[own]]
        return out


_CLASS = np.concatenate((np.arange(1 + SINGLES), np.repeat(np.arange(1 + SINGLES, CLASSES), MEMBERS)))


def class_of(slots: np.ndarray) -> np.ndarray:
    return _CLASS[slots]


def count_corpus(encoded: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Each word's count in all training documents, and the vocabulary."""
    totals = materialise(encoded.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("c"), F.min("shape").alias("shape")), "totals")
    known = totals.where("c > 0")
    top = known.orderBy(F.desc("c"), "key").limit(FREQUENT).select("key", "c", "shape").toArrow()
    shapes = known.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()
    profiles = encoded.where(F.col("kind") == SHAPE).groupBy("shape", "key").agg(F.sum("value").alias("value")).toArrow()
    ends = encoded.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).count()
    table = np.zeros((1 << 16, PROFILE))
    table[profiles.column("shape").to_numpy(), profiles.column("key").to_numpy()] = profiles.column("value").to_numpy() / FIXED
    tokens, types = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = shapes.column("shape").to_numpy()
    tokens[at], types[at] = shapes.column("c").to_numpy(), shapes.column("v").to_numpy()
    used = np.flatnonzero(table.any(axis=1))
    group = np.zeros(1 << 16, np.int64)
    group[used] = group_shapes(table[used] / np.maximum(table[used].sum(axis=1, keepdims=True), 1e-12), table[used].sum(axis=1))
    keys, counts, shape = (top.column(c).to_numpy() for c in ("key", "c", "shape"))
    slots = np.arange(1, len(keys) + 1)
    own, place = group[shape[SINGLES:]], np.zeros(max(0, len(keys) - SINGLES), np.int64)
    for g in range(GROUPS):
        place[own == g] = np.arange((own == g).sum())
    slots[SINGLES:] = np.where(place < MEMBERS - 1, 1 + SINGLES + own * MEMBERS + place, -1)
    keys, counts, shape, slots = (x[slots > 0] for x in (keys, counts, shape, slots))
    slot_tokens, rest = np.zeros(SLOTS, np.int64), MEMBERS * (1 + np.arange(GROUPS)) + SINGLES
    slot_tokens[0], slot_tokens[slots] = ends, counts
    rest_types = np.bincount(group, types, GROUPS) - np.bincount(group[shape], minlength=GROUPS)
    slot_tokens[rest] = np.bincount(group, tokens, GROUPS) - np.bincount(group[shape], counts, GROUPS)
    return totals, Vocabulary(keys, slots, group, int(tokens.sum()) + ends, int(types.sum()) + (ends > 0), ends, slot_tokens, rest_types)


SEQUENCES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, slots binary"


def to_slots(encoded: DataFrame, totals: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """SEQUENCES: each document's slots, its base score and log10 of its rarer tokens' shares of their slots.

    A block's documents and words meet by its number, so what a task holds is one block.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(documents: pa.Table, own: pa.Table) -> pa.Table:
        v = shared.value
        key = own.column("key").to_numpy()
        order = np.argsort(key.view(np.uint64))
        count, shape = own.column("c").to_numpy()[order], own.column("shape").to_numpy()[order]
        slot = v.slots_of(key[order], shape)
        last = (slot > SINGLES) & ((slot - SINGLES) % MEMBERS == 0)
        group = (slot - 1 - SINGLES) // MEMBERS
        base = np.log10((count + 1) / (v.tokens + v.types + 1))
        share = np.where(last, np.log10((count + 1) / (v.slot_tokens[slot] + v.rest_types[group] + 1)), 0.0)
        one = slot.astype("<u2")
        end_base = np.log10((v.ends + 1) / (v.tokens + v.types + 1))
        documents = documents.take(pc.sort_indices(documents, [("doc_id", "ascending"), ("ids", "ascending")]))
        rows: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "within": [], "slots": []}
        for x in documents.column("ids"):
            rank = np.frombuffer(x.as_py(), "<u4")
            rows["n_tokens"].append(len(rank) + 1)
            rows["n_known"].append(int((count[rank] > 0).sum()) + (v.ends > 0))
            rows["base_score"].append(float(base[rank].sum() + end_base))
            rows["within"].append(float(share[rank].sum()))
            rows["slots"].append(one[rank].tobytes() + b"\0\0")
        columns = [pa.array(rows[c], t) for c, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("slots", pa.binary()))]
        return pa.Table.from_arrays([documents.column("doc_id"), documents.column("held_out"), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "slots"])

    documents = encoded.where(F.col("kind") == DOCUMENT).select(F.col("pid").alias("block"), "doc_id", "held_out", "ids")
    words = encoded.where(F.col("kind") == WORD).select("pid", "key", "shape").join(totals.select("key", "c"), "key")
    return documents.groupBy("block").cogroup(words.select("pid", "key", "shape", "c").groupBy("pid")).applyInArrow(run, SEQUENCES)


def start_weights(slot_tokens: np.ndarray) -> dict[str, np.ndarray]:
    """Random weights; both softmaxes start at the classes' and places' own frequencies. Row SLOTS of e stands before the first token."""
    rng = np.random.default_rng(SEED)
    classes = np.bincount(class_of(np.arange(SLOTS)), slot_tokens, CLASSES)
    places = slot_tokens[1 + SINGLES :].reshape(GROUPS, MEMBERS).astype(float)
    places[:, -1] += 1
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(places / places.sum(axis=1, keepdims=True)), -30)
    return {
        "e": rng.normal(0, 0.5, (SLOTS + 1, INPUTS)).astype(np.float32),
        "x": rng.normal(0, 0.2, (INPUTS, 3 * HIDDEN)).astype(np.float32),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "o": rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
        "k": np.log((classes + 1) / (classes.sum() + CLASSES)).astype(np.float32),
        "v": rng.normal(0, 0.1, (GROUPS, HIDDEN, MEMBERS)).astype(np.float32),
        "m": inner.astype(np.float32),
    }


def streams(rows: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of STEPS x live streams: (before, target, going, mask, document).

    Documents are dealt whole, longest first, to the stream that is shortest so far; the
    longest streams come first and drop out as they end, so the live ones are a prefix.
    """
    load = [(0, i) for i in range(min(lanes, len(rows)))]
    dealt: list[list[int]] = [[] for _ in load]
    for d in sorted(range(len(rows)), key=lambda d: -len(rows[d])):
        size, lane = heapq.heappop(load)
        dealt[lane].append(d)
        heapq.heappush(load, (size + len(rows[d]), lane))
    dealt.sort(key=lambda ds: -sum(len(rows[d]) for d in ds))
    order = [d for ds in dealt for d in ds]
    if not order:
        return
    lengths = np.array([len(rows[d]) for d in order])
    starts = np.cumsum(lengths) - lengths
    flat, owner = np.concatenate([rows[d] for d in order]).astype(np.int32), np.repeat(np.array(order, np.int32), lengths)
    previous, on = np.concatenate((flat[:1], flat[:-1])), np.ones(len(flat), np.float32)
    previous[starts], on[starts] = SLOTS, 0
    size = np.array([sum(len(rows[d]) for d in ds) for ds in dealt])
    offset = np.cumsum(size) - size
    for t0 in range(0, int(size.max()), STEPS):
        live = int(np.searchsorted(-size, -t0))
        t = t0 + np.arange(STEPS)[:, None]
        mask = t < size[:live]
        at = np.where(mask, offset[:live] + t, 0)
        yield previous[at], flat[at], on[at], mask, owner[at]


def _by_group(slots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, positions, places) of the slots that belong to a group."""
    kind = _CLASS[slots].astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[order], np.arange(1 + SINGLES, CLASSES + 1))
    for g in range(GROUPS):
        if edge[g] < edge[g + 1]:
            at = order[edge[g] : edge[g + 1]]
            yield g, at, (slots[at] - 1 - SINGLES) % MEMBERS


def run_streams(w: dict[str, np.ndarray], before: np.ndarray, going: np.ndarray, h: np.ndarray, room: gru.Room) -> Iterator[np.ndarray]:
    """States after each step of one window (H x streams), zeroed first where a document begins; the way back finds in ``room`` what it needs."""
    (steps, lanes), kind = before.shape, h.dtype
    table, share, turn = (np.ascontiguousarray(w[k].T) for k in ("e", "x", "u"))
    inputs, gates = room.array("inputs", (steps, INPUTS, lanes), kind), room.array("gates", (3 * HIDDEN, lanes), kind)
    held, zr, new, inner, after = (room.array(k, (steps, n * HIDDEN, lanes), kind) for k, n in (("held", 1), ("zr", 2), ("new", 1), ("inner", 3), ("after", 1)))
    for t in range(steps):
        np.take(table, before[t], axis=1, out=inputs[t], mode="clip")
        np.matmul(share, inputs[t], out=gates)
        gates += w["b"][:, None]
        np.multiply(h, going[t], out=held[t])
        gru.stream_step(gates, held[t], turn, zr[t], new[t], inner[t], after[t])
        h = after[t]
        yield h


def train_step(w: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray, going: np.ndarray, mask: np.ndarray, h: np.ndarray, room: gru.Room | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss, gradients and last states (H x streams) of one window; the gradient stops at its start."""
    room = gru.Room() if room is None else room
    (steps, lanes), kind = before.shape, h.dtype
    kinds, scale, lane = class_of(target), (mask / max(1, int(mask.sum()))).astype(kind), np.arange(lanes)
    loss, out = 0.0, np.ascontiguousarray(w["o"].T)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    flat, d_states, p = room.array("flat", (steps, lanes, HIDDEN), kind), room.array("d_states", (steps, HIDDEN, lanes), kind), room.array("p", (CLASSES, lanes), kind)
    for t, h in enumerate(run_streams(w, before, going, h, room)):
        flat[t] = h.T
        np.matmul(out, h, out=p)
        p += w["k"][:, None]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        loss -= float((np.log(p[kinds[t], lane] / total + 1e-12) * scale[t]).sum())
        p *= scale[t] / total
        p[kinds[t], lane] -= scale[t]
        np.matmul(w["o"], p, out=d_states[t])
        g["o"] += h @ p.T
        g["k"] += p.sum(axis=1)
    h = h.copy()
    states, d_flat, scale = flat.reshape(-1, HIDDEN), room.array("d_flat", (steps * lanes, HIDDEN), kind), scale.ravel()
    d_flat[:] = 0
    for k, at, place in _by_group(np.where(mask, target, 0).ravel()):
        own, here = states[at], np.arange(len(at))
        q = own @ w["v"][k]
        q += w["m"][k]
        np.exp(q, out=q)
        q /= (q @ np.ones(MEMBERS, q.dtype))[:, None]
        loss -= float((np.log(q[here, place] + 1e-12) * scale[at]).sum())
        q[here, place] -= 1
        q *= scale[at][:, None]
        d_flat[at] = q @ w["v"][k].T
        g["v"][k], g["m"][k] = own.T @ q, q.sum(axis=0)
    d_states += d_flat.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
    d_h, d_inputs = np.zeros((HIDDEN, lanes), kind), room.array("d_inputs", (steps, lanes, INPUTS), kind)
    d_gates, d_inner, spare = (room.array(k, (n * HIDDEN, lanes), kind) for k, n in (("d_gates", 3), ("d_inner", 3), ("spare", 1)))
    for t in range(steps - 1, -1, -1):
        d_h += d_states[t]
        gru.stream_back(d_h, *(room[k][t] for k in ("held", "zr", "new", "inner")), w["u"], d_gates, d_inner, spare)
        d_h *= going[t]
        g["u"] += room["held"][t] @ d_inner.T
        g["x"] += room["inputs"][t] @ d_gates.T
        g["b"] += d_gates.sum(axis=1)
        d_inputs[t] = (w["x"] @ d_gates).T
    words = before.ravel()
    order = np.argsort(words.astype(np.uint16), kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], words[order][1:] != words[order][:-1])))
    g["e"][words[order][edge]] = np.add.reduceat(d_inputs.reshape(-1, INPUTS)[order], edge)
    return loss, g, h


def slabs(rows: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in runs of SLAB tokens; a longer document is one alone or the last of a run."""
    held: list[np.ndarray] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= SLAB:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_on(w: dict[str, np.ndarray], rows: Iterable[np.ndarray], rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over documents, in LANES streams of whole documents; states run on from window to window."""
    adam, room = gru.Adam(w, rate), gru.Room()
    for some in slabs(rows):
        h = np.zeros((HIDDEN, min(LANES, len(some))), np.float32)
        for before, target, going, mask, _ in streams(some, LANES):
            _, grads, h = train_step(w, before, target, going, mask, h[:, : before.shape[1]], room)
            adam.update(w, grads)
    return w


def balanced(sequences: DataFrame, tokens: int) -> DataFrame:
    """``sequences`` dealt by document into tasks of TASK_TOKENS, each in an order that nothing but its rows decides."""
    dealt = sequences.repartition(max(1, -(-tokens // TASK_TOKENS)), "doc_id", "n_tokens")
    return dealt.sortWithinPartitions("doc_id", "n_tokens", "slots")


def average(trained: DataFrame) -> DataFrame:
    """(i, mean): weights averaged by size, from tasks' fixed-point vectors in parts (part, size, weights).

    A part's vectors are added up as they stream by, so a task holds one vector for each part
    it is dealt; whole numbers, so no order of addition shows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, size, weights in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist(), batch.column("weights"), strict=True):
                vector = np.frombuffer(weights.as_py(), "<i4").astype(np.float64)
                total = held.setdefault(part, [np.zeros(len(vector)), np.zeros(len(vector)), 0])
                high = np.floor(vector * size / FIXED)
                total[0] += high
                total[1] += vector * size - high * FIXED
                total[2] += size
        for part, (high, low, size) in held.items():
            n = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(part * PART + np.arange(n)), pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64)), pa.array(np.full(n, size))], names=["i", "high", "low", "size"])

    sums = trained.repartition("part").mapInArrow(add, "i long, high long, low long, size long")
    return sums.select("i", ((F.col("high") + F.col("low") / F.lit(FIXED)) / F.col("size")).alias("mean"))


def train(sequences: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights averaged over tasks, by the tokens that each trained on, ROUNDS times; every training document is seen once.

    Tasks read their documents as a stream and send their weights in parts; the driver gets one
    row per weight.
    """
    weights = start_weights(vocabulary.slot_tokens)
    source = sequences.where(~F.col("held_out"))
    for turn in range(ROUNDS):
        shared = sequences.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            size = 0

            def documents() -> Iterator[np.ndarray]:
                nonlocal size
                for batch in batches:
                    for x in batch.column("slots"):
                        row = np.frombuffer(x.as_py(), "<u2")
                        size += len(row)
                        yield row

            w = train_on({k: v.copy() for k, v in shared.value.items()}, documents(), RATE / (1 + turn))
            if size:
                flat = np.rint(np.concatenate([w[k].ravel() for k in sorted(w)]) * np.float64(FIXED)).astype("<i4")
                parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([size] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["part", "size", "weights"])

        chosen = balanced(source.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn), vocabulary.tokens // ROUNDS).select("slots")
        mean = average(chosen.mapInArrow(run, "part int, size long, weights binary")).toArrow()
        if not mean.num_rows:
            continue
        flat = np.zeros(mean.num_rows)
        flat[mean.column("i").to_numpy()] = mean.column("mean").to_numpy()
        start = 0
        for k in sorted(weights):
            size = weights[k].size
            weights[k] = flat[start : start + size].reshape(weights[k].shape).astype(np.float32)
            start += size
    return weights


def score_rows(w: dict[str, np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's slots; states run on from window to window to its end."""
    out = np.zeros(len(rows))
    h = np.zeros((HIDDEN, min(LANES, len(rows))), np.float32)
    last, room = np.ascontiguousarray(w["o"].T), gru.Room()
    for before, target, going, mask, document in streams(rows, LANES):
        steps, lanes = before.shape
        kinds, lane = class_of(target), np.arange(lanes)
        flat, told = room.array("flat", (steps, lanes, HIDDEN), h.dtype), np.empty((steps, lanes))
        h, logits = h[:, :lanes].copy(), room.array("logits", (CLASSES, lanes), h.dtype)
        for t, h in enumerate(run_streams(w, before, going, h, room)):
            flat[t] = h.T
            np.matmul(last, h, out=logits)
            logits += w["k"][:, None]
            told[t] = logits[kinds[t], lane]
            np.exp(logits, out=logits)
            told[t] -= np.log(logits.sum(axis=0))
        flat, told = flat.reshape(-1, HIDDEN), told.ravel()
        for k, at, place in _by_group(np.where(mask, target, 0).ravel()):
            inner = flat[at] @ w["v"][k]
            inner += w["m"][k]
            chosen = inner[np.arange(len(at)), place]
            np.exp(inner, out=inner)
            told[at] += chosen - np.log(inner @ np.ones(MEMBERS, inner.dtype))
        on = mask.ravel()
        out += np.bincount(document.ravel()[on], told[on], len(rows))
    return out / np.log(10)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are the end alone. Null ids belong to the training rows, repeated
    rows are counted and scored each. Without training documents all counts are 0 and
    the probabilities are those of the untrained network. Columns beyond doc_id
    and text are not read.
    """
    encoded = materialise(encode(docs), "encoded")
    totals, vocabulary = count_corpus(encoded)
    sequences = materialise(to_slots(encoded, totals, vocabulary), "slots")
    weights = train(sequences, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x.as_py()) // 2 for x in batch.column("slots")])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLAB, "right")))
                part = batch.slice(at, to - at)
                scores = score_rows(shared.value, [np.frombuffer(x.as_py(), "<u2") for x in part.column("slots")])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(scores + part.column("within").to_numpy())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                at = to

    scored = balanced(sequences, vocabulary.tokens).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
