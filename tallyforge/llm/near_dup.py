"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import words as W
from tallyforge.llm.shared import free_name, materialise

#: Bands of ROWS coordinates each: a pair of similarity 0.8 shares none with a chance of 3 in a million.
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Words in a shingle, unless a caller says otherwise.
SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Pairs whose signatures agree in a smaller share are not verified, unless a caller sets it to 0: 4.2 standard errors below 0.8.
ESTIMATE = 0.63
#: Members of a bucket in one block; members, and their shingles, of a candidate group in one block.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES = 512, 4096, 2_000_000
#: Partners of one document that are verified together.
VERIFY_BLOCK = 256
#: Edges at one vertex from which its row is broadcast in a step of the component search, so that its edges stay where they are.
HUB, BROADCAST_HUBS = 256, 200_000
#: Ids of documents to verify are broadcast up to this number (16 MB), beyond it joined by shuffle.
BROADCAST_IDS = 2_000_000
SKETCH = "doc_id long, n_shingles long, set_key string, signature binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and the texts' bounds.

    Shingles are of ``shingle`` lower-cased words; a text of fewer words has one, its whole
    sequence; one without words has none.
    """
    w = W.find_words(data, offsets, lower=True)
    hashes, owner, count = w.hashes(), w.owner(), np.diff(w.bounds)
    last = max(0, len(hashes) - shingle + 1)
    at = np.flatnonzero(owner[:last] == owner[len(hashes) - last :])
    whole = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    short = np.flatnonzero((count > 0) & (count < shingle))
    part = count[short].astype(np.uint64)
    for k in range(shingle - 1):
        more = count[short] > k
        part[more] = part[more] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[w.bounds[short[more]] + k]
    of = np.concatenate((owner[at], short))
    values = np.concatenate((W.mix(whole), W.mix(part ^ np.uint64(0x5555555555555555))))
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(of[new], np.arange(w.texts + 1))


def _permute(x: np.ndarray) -> np.ndarray:
    """The permutation pi of 32-bit values (a bijection built of odd multiples and shifts)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(v) + k), pi shifted circularly by k.

    sigma is the shingle's mixed hash itself, taken modulo 2**32. Texts without shingles
    must not be passed.
    """
    sigma = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(_permute(sigma + np.uint32((k * 0x9E3779B1) & 0xFFFFFFFF)), bounds[:-1])
    return out


def sketch_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """SKETCH rows: set size, a 128-bit key of the set, one byte of each coordinate, and band values.

    Documents without shingles have a null key and no signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, data, offsets in W.chunks(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, shingle)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                keys: list = [None] * len(size)
                marks: list = [None] * len(size)
                bands: list = [None] * len(size)
                if len(full):
                    edges = np.append(bounds[full], bounds[-1])
                    signs = signatures(values, edges)
                    low, high = (np.add.reduceat(x, edges[:-1]) for x in (values, W.mix(values + np.uint64(77))))
                    groups = signs.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                    codes = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), groups.shape[:2]).copy()
                    for r in range(ROWS):
                        codes = W.mix(codes * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, r])
                    for i, d in enumerate(full):
                        keys[d] = f"{low[i]:016x}{high[i]:016x}"
                        marks[d] = signs[i].astype(np.uint8).tobytes()
                        bands[d] = codes[i].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(size, pa.int64()), pa.array(keys, pa.string()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SKETCH)


def bucket_members(heads: DataFrame) -> DataFrame:
    """(bucket, block, n_blocks, doc_id, n_shingles, signature) of buckets with two members or more, each member once.

    A bucket of more than BUCKET_BLOCK members is cut into blocks by a hash of the member.
    """
    members = heads.select(F.explode("bands").alias("bucket"), "doc_id")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(BUCKET_BLOCK)).cast("int")
    met = members.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("doc_id", "bucket"), blocks).cast("int").alias("block"), blocks.alias("n_blocks"), "doc_id")
    return met.join(heads.select("doc_id", "n_shingles", "signature"), "doc_id")


def _by_group(df: DataFrame, keys: tuple[str, ...], rows_of: Callable[[pa.Table], list[tuple]], out: str) -> DataFrame:
    """What ``rows_of`` gives (rows of the integer or double columns ``out``) for the rows of each value of integer keys.

    A group's rows are in doc_id order; many small groups share a task and a batch.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    fields = [f.split() for f in out.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            at = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in keys])
            edge = np.flatnonzero(np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0), [True])))
            found: list[tuple] = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                found += rows_of(rows.slice(lo, hi - lo))
            columns = list(zip(*sorted(set(found)), strict=True)) if found else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        ends = lambda b: tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            other = np.flatnonzero((at != at[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or ends(held[-1]) != ends(batch)):
                held.append(batch.slice(0, cut))
                yield close()
                held = [batch.slice(cut)]
            elif cut:
                held = [batch.slice(0, cut)]
                yield close()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield close()

    return dealt.mapInArrow(run, out)


def _near(signature: np.ndarray, size: np.ndarray, sign: np.ndarray, own: int, estimate: float) -> np.ndarray:
    """Estimated similarity of one member to others, at least a little; 0 where their sizes or estimate rule a link out."""
    agree = (signature == sign).mean(axis=1)
    small, large = np.minimum(size, own), np.maximum(size, own)
    return np.where((agree >= estimate) & (100 * small >= PERCENT * large), np.maximum(agree, 1e-9), 0.0)


def spanning_pairs(signature: np.ndarray, size: np.ndarray, estimate: float = ESTIMATE, radius: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A maximum spanning forest of the estimates (Prim), one row of the matrix at a time; pairs are (parent, child).

    Where each row is the root of a tree of some ``radius``, roots whose trees might hold members that
    pass are joined too, after all those that pass themselves.
    """
    m = len(size)
    best, link, left = np.zeros(m), np.full(m, -1), np.ones(m, bool)
    out, now = [], 0
    for _ in range(m):
        left[now] = False
        if link[now] >= 0:
            out.append((int(link[now]), now))
        near = _near(signature, size, signature[now], size[now], estimate)
        if radius is not None:
            agree, slack = (signature == signature[now]).mean(axis=1), radius + radius[now]
            near = np.where(near > 0, 1 + near, np.where((slack > 0) & (agree + slack >= estimate - 1e-9), np.maximum(agree, 1e-9), 0.0))
        closer = left & (near > best)
        best[closer], link[closer] = near[closer], now
        if not left.any():
            break
        now = int(np.argmax(np.where(left, best, -1.0)))
    return out


def _signs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _ordered(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(min(p), max(p)) for p in pairs if p[0] != p[1]]


def candidate_pairs(heads: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """(a, b), a < b: pairs whose links, once followed, reach every pair that shares a bucket and passes the estimate.

    A bucket within one block gives a spanning forest of the estimates. In a larger one each
    block gives its forest, then only the trees' roots meet, block pair by block pair, and give a
    forest again. The share of coordinates in which signatures differ is a metric, so two
    members can pass the estimate only if their roots do within both trees' radii; roots that do
    by that slack alone are joined as well, so no row is sent for a pair of trees.
    """
    members = bucket_members(heads)

    def small(rows: pa.Table) -> list[tuple]:
        ids = rows.column("doc_id").to_pylist()
        return _ordered([(ids[i], ids[j]) for i, j in spanning_pairs(_signs(rows), rows.column("n_shingles").to_numpy(), estimate)])

    pairs = _by_group(members.where("n_blocks = 1"), ("bucket",), small, "a long, b long")
    large = materialise(members.where("n_blocks > 1"), "large-buckets")
    if large.isEmpty():
        return pairs.distinct()

    def trees(rows: pa.Table) -> list[tuple]:
        """(bucket, root, radius, member, parent) of each member; a root is its own parent."""
        ids, signs = rows.column("doc_id").to_numpy(), _signs(rows)
        root, parent = np.arange(len(ids)), np.arange(len(ids))
        for i, j in spanning_pairs(signs, rows.column("n_shingles").to_numpy(), estimate):
            root[j], parent[j] = root[i], i
        away = (signs != signs[root]).mean(axis=1)
        radius = np.zeros(len(ids))
        np.maximum.at(radius, root, away)
        bucket = rows.column("bucket")[0].as_py()
        return [(bucket, int(ids[r]), float(radius[r]), int(ids[i]), int(ids[parent[i]])) for i, r in enumerate(root)]

    grown = materialise(_by_group(large, ("bucket", "block"), trees, "bucket long, root long, radius double, member long, parent long"), "trees")
    within = grown.where("member <> parent").select(F.least("member", "parent").alias("a"), F.greatest("member", "parent").alias("b"))
    roots = grown.where("member = root").select("bucket", "radius", F.col("root").alias("doc_id"))
    counts = roots.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(BUCKET_BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    met = F.transform(F.sequence(F.lit(0), blocks - F.lit(1)), lambda o: F.least(o, mine) * blocks + F.greatest(o, mine))
    sides = heads.select("doc_id", "n_shingles", "signature")
    dealt = roots.join(counts, "bucket").select("bucket", F.explode(met).alias("part"), "doc_id", "radius").join(sides, "doc_id")

    def meet(rows: pa.Table) -> list[tuple]:
        ids, radius = rows.column("doc_id").to_pylist(), rows.column("radius").to_numpy()
        return _ordered([(ids[i], ids[j]) for i, j in spanning_pairs(_signs(rows), rows.column("n_shingles").to_numpy(), estimate, radius)])

    return pairs.union(within).union(_by_group(dealt, ("bucket", "part"), meet, "a long, b long")).distinct()


def crossing_links(signature: np.ndarray, sets: list[np.ndarray], component: np.ndarray, estimate: float = ESTIMATE) -> list[tuple[int, int]]:
    """Links between components, by exact counts: each pair not yet joined that the estimates allow is compared.

    What a member shares with all others is counted over an inverted index of their shingles.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[value] > 1
    owner, value = owner[common], value[common]
    order = np.argsort(value, kind="stable")
    posting, start = owner[order], np.searchsorted(value[order], np.arange(len(count) + 1))
    mine = np.searchsorted(owner, np.arange(len(sets) + 1))
    now, out = component.copy(), []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(now[i + 1 :] != now[i]) + i + 1
        if not len(rest) or not (near := _near(signature[rest], size[rest], signature[i], size[i], estimate) > 0).any():
            continue
        lists = [posting[start[v] : start[v + 1]] for v in value[mine[i] : mine[i + 1]]]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), np.int64)
        for j in rest[near]:
            if now[j] != now[i] and 100 * shared[j] >= PERCENT * (size[i] + size[j] - shared[j]):
                out.append((int(component[i]), int(component[j])))
                now[now == now[j]] = now[i]
    return out


def crossing_components(members: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """Pairs of components that some link joins, within each candidate group (doc_id, group, component, n_shingles, signature, shingles).

    Groups of one component have nothing to join. In others the members of the largest
    component meet only those outside it, who also meet each other. Both sides are cut into
    blocks, bounded in members and in shingles; a member of the largest component is sent once
    for each block of the others.
    """
    each = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = each.groupBy(F.col("group").alias("_group")).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("_big"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    bound = lambda n, s: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_SHINGLES))).cast("int")
    inner, outer = bound(F.col("_big.n"), F.col("_big.s")), bound(F.col("_n") - F.col("_big.n"), F.col("_s") - F.col("_big.s"))
    at = F.xxhash64("doc_id")
    across = F.transform(F.sequence(F.lit(0), outer - F.lit(1)), lambda o: F.pmod(at, inner).cast("int") * outer + o)
    mine = F.pmod(at, outer).cast("int")
    along = F.transform(F.sequence(F.lit(0), inner - F.lit(1)), lambda i: i * outer + mine)
    others = F.transform(F.sequence(F.lit(0), outer - F.lit(1)), lambda o: inner * outer + F.least(o, mine) * outer + F.greatest(o, mine))
    part = F.when(F.col("component") == F.col("_big.component"), across).otherwise(F.when(outer == 1, along).otherwise(F.concat(along, others)))
    dealt = members.join(sizes, F.col("group") == F.col("_group")).withColumn("part", F.explode(part)).select("group", "part", "doc_id", "component", "signature", "shingles")

    def pairs_of(rows: pa.Table) -> list[tuple]:
        return _ordered(crossing_links(_signs(rows), [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")], rows.column("component").to_numpy(), estimate))

    return _by_group(dealt, ("group", "part"), pairs_of, "a long, b long").distinct()


def candidate_sets(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, shingles): the full shingle sets, as sorted 64-bit hashes, of the documents in ``pairs``; one row for each different set of an id."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "verify-ids")
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, shingle)
                rows = [values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(rows, pa.binary())], names=["doc", "shingles"])

    return materialise(chosen.mapInArrow(run, "doc long, shingles binary").distinct(), "verify-sets")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which some full shingle sets meet PERCENT.

    The sets of b are brought to the pairs of its a, at most VERIFY_BLOCK of them to a task's group; the sets of a come once to each group and stay
    in memory while the others pass, so that one with many partners is not copied for each.
    """
    counts = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / F.lit(VERIFY_BLOCK)).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int")
    asked = pairs.join(counts, F.col("a") == F.col("_a")).select("a", "b", part.alias("part"))
    others = asked.join(sets, F.col("b") == F.col("doc")).select("a", "part", F.lit(1).alias("side"), "b", "shingles")
    heads = counts.join(sets, F.col("_a") == F.col("doc")).select(F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("_a").alias("b"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found = []
            for a, part, side, b, raw in zip(*(batch.column(c) for c in ("a", "part", "side", "b", "shingles")), strict=True):
                a, other = a.as_py(), np.frombuffer(raw.as_py(), np.uint64)
                if side.as_py() == 0:
                    held = [*held, other] if now == (a, part.as_py()) else [other]
                    now = (a, part.as_py())
                    continue
                for one in held:
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if 100 * common >= PERCENT * (len(one) + len(other) - common):
                        found.append((a, b.as_py()))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(graph, id, component): the smallest id connected to each id within a graph of ``edges`` (graph, a, b).

    Alternating large and small stars; each round's edges are written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        one, other = e.select("graph", F.col("a").alias("u"), F.col("b").alias("v")), e.select("graph", F.col("b").alias("u"), F.col("a").alias("v"))
        near = one.union(other) if large else e.select("graph", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("graph", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = least.where(F.col("n") >= HUB).select("graph", "u", F.col("m").alias("_hub")).limit(BROADCAST_HUBS + 1).collect()
        if not hubs or len(hubs) > BROADCAST_HUBS:
            out = near.join(least.drop("n"), ["graph", "u"])
        else:
            marked = near.join(F.broadcast(e.sparkSession.createDataFrame(hubs, "graph int, u long, _hub long")), ["graph", "u"], "left")
            rest = marked.where("_hub is null").drop("_hub").join(least.where(F.col("n") < HUB).drop("n"), ["graph", "u"])
            out = marked.where("_hub is not null").withColumnRenamed("_hub", "m").unionByName(rest)
        if large:
            moved = out.where("v > u").select("graph", F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = out.select("graph", F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b")

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("graph", "a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = materialise(edges.distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = materialise(star(star(now, True), False).distinct(), "edges")
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select("graph", F.explode(F.array("a", "b")).alias("id"), F.col("b").alias("component")).groupBy("graph", "id").agg(F.min("component").alias("component"))


def find_groups(docs: DataFrame, shingle: int = SHINGLE, estimate: float = ESTIMATE) -> DataFrame:
    """One row per document: n_shingles, component_id and kept.

    Documents of one shingle set are a class, headed by its smallest id; only heads are
    banded. A spanning forest of each bucket is verified first. All pairs that share a bucket
    and may be linked lie within a tree of those forests, so the documents of a tree whose
    verified links leave several components are then compared with each other, block by
    block, until no link between components is left untried. Rows of one id are one document even if
    their texts differ: all its sets are compared, and their classes are joined. With ``estimate`` 0 all pairs of a
    bucket may be linked, whatever their signatures say. Documents without words (null,
    empty) and of null id are linked with nothing; repeated rows share their component, and
    each is kept if the id is. Columns beyond doc_id and text are not read.
    """
    sketch = materialise(sketch_documents(docs, shingle), "sketch")
    known = sketch.where("set_key is not null and doc_id is not null")
    heads = known.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature", "bands"), "doc_id").alias("h"))
    heads = materialise(heads.select("set_key", "h.*"), "heads")
    pairs = materialise(candidate_pairs(heads, estimate), "pairs")
    sets = candidate_sets(pairs, docs, shingle)
    links = verify(pairs, sets)
    several = known.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("set_key").alias("_low"), F.max("set_key").alias("_high")).where("_low <> _high").select("_doc")
    several = materialise(several, "several-texts")
    if not several.isEmpty():
        owners = known.join(several, F.col("doc_id") == F.col("_doc")).select("_doc", "set_key").distinct().join(heads.select("set_key", "doc_id"), "set_key").select("_doc", "doc_id").distinct()
        first = owners.groupBy(F.col("_doc").alias("_of")).agg(F.min("doc_id").alias("a"))
        links = links.unionByName(owners.join(first, F.col("_doc") == F.col("_of")).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))).distinct()
    both = materialise(components(pairs.withColumn("graph", F.lit(0)).unionByName(links.withColumn("graph", F.lit(1)))), "components")
    found = both.where("graph = 1").select("id", "component")
    groups = both.where("graph = 0").select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    members = groups.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "group", F.coalesce("component", "doc_id").alias("component"))
    members = members.join(heads.select("doc_id", "n_shingles", "signature"), "doc_id").join(sets, F.col("doc_id") == F.col("doc")).drop("doc")
    joined = components(crossing_components(members, estimate).withColumn("graph", F.lit(0))).select(F.col("id").alias("_was"), F.col("component").alias("_now"))
    heads = heads.select(F.col("set_key").alias("_key"), F.col("doc_id").alias("_head")).join(found, F.col("_head") == F.col("id"), "left")
    heads = heads.select("_key", F.coalesce("component", "_head").alias("_own")).join(joined, F.col("_own") == F.col("_was"), "left").select("_key", F.coalesce("_now", "_own").alias("_component"))
    out = sketch.join(heads, F.col("set_key") == F.col("_key"), "left").withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_component")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group: that of its smallest id.

    Of several rows of that id the first by text, then by a hash of the row, stays. Rows of null id are no
    group and all stay. The ids to drop, and those that repeat, are broadcast up to
    BROADCAST_IDS, beyond that joined by shuffle. Columns may have any names.
    """
    kept = F.max("kept").alias("kept")
    ids = find_groups(docs, shingle).where("doc_id is not null").groupBy("doc_id").agg(kept, F.count(F.lit(1)).alias("n"))
    mark = free_name(docs, "_id")
    ids = materialise(ids.where("not kept or n > 1").select(F.col("doc_id").alias(mark), "kept"), "lost")
    few = ids.count() <= BROADCAST_IDS
    chosen = lambda x: F.broadcast(x.select(mark)) if few else x.select(mark)
    alone = docs.join(chosen(ids), F.col("doc_id") == F.col(mark), "left_anti")
    again = ids.where("kept")
    if again.isEmpty():
        return alone
    rows = docs.join(chosen(again), F.col("doc_id") == F.col(mark), "left_semi")
    first = rows.groupBy(F.col("doc_id").alias(mark)).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias("row"))
    return alone.unionByName(first.select("row.*"))
