"""Quality rules: statistics of whole texts, judged by an isolation forest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tallyforge.llm import words as W
from tallyforge.llm.shared import materialise

#: Words in a window whose repetition counts.
WINDOW = 8
#: Trees, and the rows that each is grown on: those first by a hash of their id and the tree, of all good ones.
TREES = 100
SAMPLE = 256
#: Share of labelled good rows that the threshold may reject.
FALSE_REJECTS = 0.003
SEED = 11
#: Bins of scores, counted to find the one that the threshold's quantile is in.
BINS = 1 << 14
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_adjacent", "n_distinct", "n_marks")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[list(b"!#*$%&|<>~^")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True


def _repeats(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which (owner, key) pairs occur twice or more."""
    both = W.mix(key ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, where, n = np.unique(both, return_inverse=True, return_counts=True)
    return n[where] > 1


def _distinct(owner: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    both = W.mix(key ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(both, return_index=True)
    return np.bincount(owner[first], minlength=texts)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """BASE and MORE for each text."""
    w = W.find_words(data, offsets, lower=False)
    texts, hashes, owner = w.texts, w.hashes(), w.owner()
    inside = ~W.SPACE[data]
    out = {"n_words": np.diff(w.bounds), "word_chars": W.per_text(inside & ((data & 0xC0) != 0x80), offsets)}
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK)):
        out[name] = W.per_text(flags[data], offsets)
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    ends = np.sort(np.concatenate((feeds, offsets[1:])))
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(offsets, starts, "right") - 1
    out["n_dup_lines"] = np.bincount(of, minlength=texts) - _distinct(of, W.span_hashes(data, starts, ends), texts)
    out["n_distinct"] = _distinct(owner, hashes, texts)
    n = len(hashes)
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_adjacent"] = W.per_text(same, w.bounds)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        at = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
        window = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
        twice = at[_repeats(owner[at], window)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = W.per_text(np.cumsum(covered[:n]) > 0, w.bounds)
    return out


def rule_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the statistics (long) of every whole ``text``; null and empty texts have zeros."""
    kept = docs.select(*keep, "text")
    names = [*BASE, *MORE]
    passing = [f for f in kept.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for at, to, data, offsets in W.chunks(text):
                stats = text_stats(data, offsets)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(stats[n], pa.int64()) for n in names)], names=[*keep, *names])

    schema = kept.select(*keep).schema
    for n in names:
        schema = schema.add(n, "long")
    assert len(passing) == len(keep)
    return kept.mapInArrow(run, schema)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


#: How many rates ``features`` gives.
FEATURES = 8


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that don't depend on a text's length, one row per text."""
    s = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    n = np.maximum(s["n_words"], 1)
    return np.stack(
        [
            s["word_chars"] / n,
            s["n_symbols"] / n,
            s["n_marks"] / n,
            s["n_repeat_words"] / n,
            s["n_dup_lines"] / n,
            s["n_upper"] / np.maximum(s["n_letters"], 1),
            s["n_adjacent"] / n,
            s["n_distinct"] / n**0.8,
        ],
        axis=1,
    )


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays of nodes; a negative feature marks a leaf whose ``cut`` is its path length."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: int
    scale: np.ndarray
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected): near 1 for texts that few splits isolate."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= self.cut[t][at]
                at = np.where(f < 0, at, self.child[t][at] + right)
            total += self.cut[t][at]
        return 2.0 ** (-total / len(self.feature) / float(_expected(np.array(SAMPLE))))

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) > self.threshold


def grow_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """An isolation forest over the rows of x."""
    rng = np.random.default_rng(seed)
    spread = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    drawn = (x[rng.choice(len(x), min(sample, len(x)), replace=False) if len(x) else np.zeros(0, int)] for _ in range(trees))
    return grow_trees(drawn, trees, spread, sample, rng)


def grow_trees(samples: Iterable[np.ndarray], trees: int, spread: np.ndarray, sample: int, rng: np.random.Generator) -> Forest:
    """A forest of a tree for each of the samples: random feature, random cut in a range a little
    wider than the node's, so that a text outside all that was seen is cut off early."""
    depth = int(np.ceil(np.log2(sample)))
    width = 2 ** (depth + 1)
    feature, cut, child = np.full((trees, width), -1), np.zeros((trees, width)), np.zeros((trees, width), np.int64)
    spread = np.maximum(spread, 1e-9)
    for t, rows in enumerate(samples):
        todo, used = [(0, rows, 0)], 1
        while todo:
            node, held, level = todo.pop()
            if level == depth or len(held) <= 1:
                cut[t, node] = level + float(_expected(np.array(len(held))))
                continue
            f = int(rng.integers(len(spread)))
            low, high = held[:, f].min() - spread[f] * 3, held[:, f].max() + spread[f] * 3
            at = rng.uniform(low, high)
            side = held[:, f] >= at
            feature[t, node], cut[t, node], child[t, node] = f, at, used
            todo += [(used, held[~side], level + 1), (used + 1, held[side], level + 1)]
            used += 2
    return Forest(feature, cut, child, depth, spread)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray) -> Forest:
    """Reject above the score that separates the labels best while at most FALSE_REJECTS of the good rows are lost; ``threshold`` does so over a table."""
    scores = forest.score(x)
    forest.threshold = 1.0
    if good.any() and (~good).any():
        floor = np.quantile(scores[good], 1 - FALSE_REJECTS, method="higher")
        options = np.unique(scores[scores >= floor])
        gain = [(scores[~good] > c).mean() - (scores[good] > c).mean() for c in options]
        best = options[int(np.argmax(gain))]
        above = scores[scores > best]
        forest.threshold = float((best + above.min()) / 2 if len(above) else best)
    return forest


def threshold(scored: DataFrame) -> float:
    """The score above which ``calibrate`` would reject, of rows (score, good) of any number.

    Between two good scores a higher cut only loses bad rows, so the cuts tried are the good scores of the last FALSE_REJECTS: they come
    to the driver, counted, with those of one bin below.
    """
    good, bad = scored.where("good"), scored.where("not good")
    n_bad = bad.count()
    bins = good.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").toArrow()
    each = bins.column("n").to_numpy()
    n_good = int(each.sum())
    if not n_good or not n_bad:
        return 1.0
    rank = int(np.ceil((n_good - 1) * (1 - FALSE_REJECTS)))
    at = int(np.searchsorted(np.cumsum(each), rank, "right"))
    low = int(bins.column("bin")[at].as_py()) / BINS
    top = good.where(F.col("score") >= low).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").toArrow()
    options, counts = top.column("score").to_numpy(), top.column("n").to_numpy()
    first = int(np.searchsorted(np.cumsum(counts), rank - int(each[:at].sum()), "right"))
    options, counts = options[first:], counts[first:]
    shared = scored.sparkSession.sparkContext.broadcast(options)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of the options each score is above."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(shared.value, batch.column(0).to_numpy()).astype(np.int64))], names=["above"])

    lost = np.zeros(len(options) + 1, np.int64)
    for r in bad.select("score").mapInArrow(passed, "above long").groupBy("above").agg(F.count(F.lit(1)).alias("n")).collect():
        lost[r["above"]] = r["n"]
    bad_above = np.cumsum(lost[::-1])[::-1][1:]
    good_above = counts.sum() - np.cumsum(counts)
    best = float(options[int(np.argmax(bad_above / n_bad - good_above / n_good))])
    above = scored.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best if above is None else (best + above) / 2


def fit_forest(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None) -> Forest:
    """Fit on all labelled documents, by their ``stats`` if these are known (doc_id, BASE and MORE).

    The forest is grown on the good ones that pass the base rules, of which each tree draws its sample by a hash; both labels set the
    threshold. Of an id with several texts the least statistics count. Documents and labels of null id, and labels of null quality, are left out;
    with none left, nothing is rejected by the forest.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    stats = rule_statistics(docs, ["doc_id"]) if stats is None else stats
    known = stats.join(chosen, "doc_id").groupBy("doc_id", "_quality").agg(F.min(F.struct(*BASE, *MORE)).alias("s")).select(F.col("doc_id").cast("long"), "_quality", "s.*")

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: batch.column(n).to_numpy() for n in (*BASE, *MORE)}
            passed = pa.array(~base_failed(got["n_words"], got["n_repeat_words"]))
            good = pc.equal(batch.column("_quality"), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), good, *map(pa.array, features(got).T)], names=["doc_id", "good", *names]).filter(passed)

    names = [f"x{i}" for i in range(FEATURES)]
    rows = materialise(known.mapInArrow(rates, ", ".join(["doc_id long, good boolean", *(f"{n} double" for n in names)])), "labelled-rates")
    good = rows.where("good")
    n, *spread = good.agg(F.count(F.lit(1)), *(F.stddev_pop(c) for c in names)).first()
    spread = np.array([float(f"{v:.9g}") for v in spread]) if n else np.ones(FEATURES)  # whatever the order of the sums
    # Twice a sample of candidates a tree, so that a tree that finds too few is out of the question.
    most = F.lit(min((1 << 63) - 1, (1 << 65) * SAMPLE // max(n, 1) - (1 << 63)))
    draws = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(SEED), t, "doc_id").alias("at")))
    drawn = good.select("doc_id", *names, F.inline(F.filter(draws, lambda d: d["at"] <= most)))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("at", "doc_id"))).where(F.col("k") <= SAMPLE).toArrow()
    tree, order = drawn.column("tree").to_numpy(), np.lexsort((drawn.column("k").to_numpy(), drawn.column("tree").to_numpy()))
    x = np.stack([drawn.column(c).to_numpy() for c in names], axis=1)[order]
    edges = np.searchsorted(tree[order], np.arange(TREES + 1))
    forest = grow_trees((x[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)), TREES, spread, SAMPLE, np.random.default_rng(SEED))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(x)), batch.column("good")], names=["score", "good"])

    forest.threshold = threshold(materialise(rows.mapInArrow(scores, "score double, good boolean"), "labelled-scores"))
    return forest


def judge(stats: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """``keep`` columns, BASE, base_failed, anomaly (double) and kept."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: batch.column(n).to_numpy() for n in (*BASE, *MORE)}
            failed = base_failed(got["n_words"], got["n_repeat_words"])
            score = shared.value.score(features(got))
            kept = ~failed & ~(score > shared.value.threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, *BASE)), pa.array(failed), pa.array(score), pa.array(kept)], names=[*keep, *BASE, "base_failed", "anomaly", "kept"])

    schema = stats.select(*keep, *BASE).schema.add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean")
    return stats.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base statistics, base_failed, anomaly and kept.

    Null and empty texts have no words and so fail the base rules. Repeated rows are
    judged alike, each once; columns of ``docs`` beyond doc_id and text are not read, and texts are read once.
    """
    stats = materialise(rule_statistics(docs, ["doc_id"]), "text-statistics")
    return judge(stats, fit_forest(docs, labels, stats), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    forest = fit_forest(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column(batch.schema.get_field_index("text"))):
                stats = text_stats(data, offsets)
                kept = ~base_failed(stats["n_words"], stats["n_repeat_words"]) & ~shared.value.rejects(features(stats))
                yield pa.RecordBatch.from_struct_array(pc.filter(batch.slice(at, to - at).to_struct_array(), pa.array(kept)))

    return docs.mapInArrow(run, docs.schema)
