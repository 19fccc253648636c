"""SimHash near-duplicates: fingerprints that differ in few bits meet at the anchors of a covering code.

The anchors are the codewords of the perfect Hamming code of length 31, whose covering radius is 1,
over the lower 31 bits of either half of a fingerprint. Of DISTANCE = 3 differing bits one half
has at most one, so the threshold within a half is 1: a fingerprint lies within 1 of exactly one anchor of
the half, its partner within 1 + 1 of the same anchor. Each fingerprint is sent to every anchor within 2
(one if it is an anchor itself, else 16), and what meets at an anchor is compared in all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import words as W
from tallyforge.llm.near_dup import components
from tallyforge.llm.shared import materialise, whole_groups

#: Words in a shingle, seed of its hash, and most bits in which linked fingerprints differ.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Bits of a half that its code covers.
COVERED = 31
#: Members of an anchor compared by one task at a time.
BLOCK = 2048
#: Members of an anchor up to which all its links are kept; of larger ones a spanning forest is.
FEW = 32
#: Shingles whose bits are spread out at a time.
STEP = 1 << 16


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text: bit k is 1 if more than half of its shingles' hashes have it.

    Shingles count as often as they occur; a text of fewer words has one, its whole sequence;
    one without words has fingerprint 0.
    """
    w = W.find_words(data, offsets, lower=True)
    text, first = W.joined(w.data, w.starts, w.ends)
    end, count = first + (w.ends - w.starts), np.diff(w.bounds)
    owner = w.owner()
    last = max(0, len(first) - shingle + 1)
    at = np.flatnonzero(owner[:last] == owner[len(first) - last :])
    short = np.flatnonzero((count > 0) & (count < shingle))
    of = np.concatenate((owner[at], short))
    order = np.argsort(of, kind="stable")
    of = of[order]
    begin = np.concatenate((first[at], first[w.bounds[short]]))[order]
    finish = np.concatenate((end[at + shingle - 1], end[w.bounds[short + 1] - 1]))[order]
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin.tolist(), finish.tolist(), strict=True)), np.uint64, len(of))
    ones = np.zeros((w.texts, 64), np.int64)
    for k in range(0, len(of), STEP):
        bits = np.unpackbits(hashes[k : k + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = of[k : k + STEP]
        edge = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        ones[mine[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    total = np.bincount(of, minlength=w.texts)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def sketch_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column("text")):
                found = fingerprints(data, offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(found)], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def flips() -> list[list[int]]:
    """Bits to flip to reach each anchor within 2 of a half, by the half's syndrome.

    The syndrome is the exclusive or of the numbers (from 1) of the bits set. 0 marks an anchor. Any other value
    numbers the bit that leads to the nearest anchor; pairs of numbers that give it by exclusive or lead to the others.
    """
    out = [[0]]
    for s in range(1, COVERED + 1):
        out.append([1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, COVERED + 1) if i < i ^ s and i != s])
    return out


def replicate(prints: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor within covering radius plus threshold, of both halves."""
    table = F.array(*(F.array(*(F.lit(m).cast("long") for m in row)) for row in flips()))
    masks = [sum(1 << (i - 1) for i in range(1, COVERED + 1) if i >> b & 1) for b in range(5)]
    sent = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit((1 << COVERED) - 1).cast("long"))
        syndrome = sum((F.bit_count(bits.bitwiseAND(F.lit(m).cast("long"))) % 2 * F.lit(1 << b) for b, m in enumerate(masks)), F.lit(0))
        base = bits + F.lit(half << 32)
        sent.append(F.transform(F.element_at(table, syndrome + 1), base.bitwiseXOR))
    return prints.select(F.explode(F.concat(*sent)).alias("anchor"), "fp")


def near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count((one ^ other).view(np.uint64)) <= DISTANCE


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    left, out = fp.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            now = queue.pop()
            close = near(left, now)
            if close.any():
                out += [(int(now), int(x)) for x in left[close]]
                queue += list(left[close])
                left = left[~close]
    return out


def links_within(anchor: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs within DISTANCE that share an anchor (rows sorted by it); of an anchor of many members a spanning forest."""
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    size = np.diff(edge)
    out = [pair for g in np.flatnonzero(size > FEW) for pair in forest(fp[edge[g] : edge[g + 1]])]
    few = np.repeat(size <= FEW, size)
    anchor, fp = anchor[few], fp[few]
    for k in range(1, FEW):
        same = np.flatnonzero(anchor[k:] == anchor[:-k])
        if not len(same):
            break
        same = same[near(fp[same], fp[same + k])]
        out += zip(fp[same].tolist(), fp[same + k].tolist(), strict=True)
    return out


def crossing(component: np.ndarray, fp: np.ndarray, outside: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of components that links join; only rows ``outside`` the largest are compared with all."""
    now, out = component.copy(), []
    for i in np.flatnonzero(outside):
        for j in np.flatnonzero((now != now[i]) & near(fp, fp[i])):
            if now[j] != now[i]:
                out.append((int(component[i]), int(component[j])))
                now[now == now[j]] = now[i]
    return out


def _pairs(rows: DataFrame, keys: list[str], find, order: str = "fp") -> DataFrame:
    """(a, b), a < b: what ``find`` gives for the rows of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys):
            pairs = np.array(sorted(set(find(group))), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, "a long, b long").distinct()


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def link_fingerprints(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, component): of distinct fingerprints ``prints`` those with a link, and the least one of their component.

    An anchor of more than ``block`` members is cut into blocks by a hash. Each block gives a spanning forest.
    Then the members outside the anchor's largest component so far are compared with all others, block by
    block, in two grids of cells of bounded size; members of the largest component are never compared with each other again. The
    links found so join components, a smaller graph than that of their members.

    Spark takes exploded rows to be as many as before, so it is told to deal them by shuffle and never broadcast them.
    """
    met = replicate(prints)
    sizes = met.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = materialise(met.join(sizes.hint("merge"), F.col("anchor") == F.col("_anchor")).select("anchor", "fp", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("blocks")), "anchors")
    within = lambda r: links_within(_column(r, "anchor"), _column(r, "fp"))
    pairs = _pairs(shared.where("blocks = 1").select("anchor", "fp"), ["anchor"], within)
    hot = shared.where("blocks > 1")
    if hot.isEmpty():
        return components(pairs.withColumn("graph", F.lit(0))).select(F.col("id").alias("fp"), "component")
    cut = hot.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = materialise(pairs.unionByName(_pairs(cut.select("anchor", "part", "fp"), ["anchor", "part"], within)).distinct(), "anchor-links")
    grown = materialise(components(pairs.withColumn("graph", F.lit(0))), "anchor-components")
    now = hot.select("anchor", "fp").join(grown.select(F.col("id").alias("_id"), "component"), F.col("fp") == F.col("_id"), "left").select("anchor", "fp", F.coalesce("component", "fp").alias("component"))
    each = now.groupBy("anchor", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = each.groupBy(F.col("anchor").alias("_anchor")).agg(F.sum("n").alias("_n"), F.max(F.struct("n", "component")).alias("_big"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    of = lambda n: F.ceil(n / F.lit(block)).cast("int")
    inner, outer, at = of(F.col("_big.n")), of(F.col("_n") - F.col("_big.n")), F.xxhash64("fp")
    outside = F.col("component") != F.col("_big.component")
    row, column = F.pmod(at, inner).cast("int"), F.pmod(at, outer).cast("int")
    along = F.transform(F.sequence(F.lit(0), inner - 1), lambda i: i * outer + column)
    across = F.transform(F.sequence(F.lit(0), outer - 1), lambda o: row * outer + o)
    others = F.transform(F.sequence(F.lit(0), outer - 1), lambda o: inner * outer + F.least(o, column) * outer + F.greatest(o, column))
    cells = now.join(largest, F.col("anchor") == F.col("_anchor")).select("anchor", "fp", "component", outside.cast("int").alias("outside"), F.explode(F.when(outside, F.concat(along, others)).otherwise(across)).alias("part"))

    def cross(group: pa.Table) -> list[tuple[int, int]]:
        keys = np.stack([_column(group, "anchor"), _column(group, "part")])
        edge = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        component, fp, out = _column(group, "component"), _column(group, "fp"), _column(group, "outside") > 0
        return [p for i, j in zip(edge[:-1], edge[1:], strict=True) for p in crossing(component[i:j], fp[i:j], out[i:j])]

    met = materialise(_pairs(cells, ["anchor", "part"], cross), "anchor-crossings")
    if met.isEmpty():
        return grown.select(F.col("id").alias("fp"), "component")
    joined = components(met.withColumn("graph", F.lit(0))).select(F.col("id").alias("_was"), F.col("component").alias("_now"))
    every = grown.select(F.col("id").alias("fp"), "component").unionByName(joined.select(F.col("_was").alias("fp"), F.col("_was").alias("component"))).distinct()
    return every.join(joined, F.col("component") == F.col("_was"), "left").select("fp", F.coalesce("_now", "component").alias("component"))


def find_groups(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable.

    Documents of one fingerprint are one vertex, and only distinct fingerprints are replicated. Rows of one id are
    one document even if their texts differ: their fingerprints are joined. Null, empty and wordless texts have
    fingerprint 0 and link like any other; a row of null id has a fingerprint but links with nothing, its component_id is null.
    Columns beyond doc_id and text are not read.
    """
    sketch = materialise(sketch_documents(docs, shingle), "fingerprints")
    pairs = sketch.where("doc_id is not null").distinct()
    heads = materialise(pairs.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    first = pairs.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    one = pairs.join(first, F.col("doc_id") == F.col("_doc")).where("fp <> a").select(F.lit(0).alias("graph"), "a", F.col("fp").alias("b"))
    linked = link_fingerprints(heads.select("fp"), block)
    if not one.isEmpty():
        linked = components(linked.where("fp <> component").select(F.lit(0).alias("graph"), F.col("component").alias("a"), F.col("fp").alias("b")).unionByName(one)).select(F.col("id").alias("fp"), "component")
    linked = materialise(linked, "linked-fingerprints").join(heads, "fp")
    least = linked.groupBy("component").agg(F.min("head").alias("_least"))
    named = heads.join(linked.join(least, "component").select(F.col("fp").alias("_fp"), "_least"), F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_print"), F.coalesce("_least", "head").alias("_component"))
    named = materialise(named, "fingerprint-components")  # so that both sides of the join are dealt anew, and a fingerprint that many rows have can be split
    out = sketch.join(named, F.col("fp") == F.col("_print"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))
