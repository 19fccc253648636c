"""Tokens of two tokenizers aligned by bytes, each distinct segment tokenised and aligned once.

A document is cut before each run of white space that starts with a space and follows something else. Neither vocabulary
can merge across such a place (``verify_boundaries`` looks at every entry), so a document's tokens are those of its
segments one after the other. Blocks of documents keep their distinct segments once and the documents as numbers of
them. One shuffle brings equal segments of all blocks together; each is tokenised and aligned once and its alignment
goes back to every block that holds it, where documents are composed of alignments.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import words as W
from tallyforge.llm.shared import materialise

#: The tokenizers' files, by the names that the installed collection gives them.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block of documents; a longer text is a block of its own, whole. Bytes of segments encoded in one go.
BLOCK_BYTES, ENCODED_BYTES = 8 << 20, 1 << 16
#: A pair of token ids as one number: the first id above so many bits of the second.
LOW_BITS = 20
#: Marks of a token in an alignment: it is the second tokenizer's; it ends a group.
SECOND, ENDS = np.uint32(1 << 30), np.uint32(1 << 31)
#: Tokens of the first tokenizer up to which a segment is sent in 16-bit numbers, their marks in its head.
SHORT = 12
#: A block and a segment's number in it as one number: the block above so many bits of the number.
AT_BITS = 28
#: Links of a group up to which its pairs are counted one by one; of more its distinct ids are.
FEW = 1 << 12
#: Segments of one document whose text is hashed at a time.
STEP = 1 << 17
#: Distinct pairs of the corpus up to which their counts are broadcast (17 bytes each), beyond it joined by shuffle.
BROADCAST_PAIRS = 2_000_000
CODED = "block long, ids array<long>, edges binary, codes binary, segments array<binary>"
ALIGNED = "block long, at int, tokens binary"
COMPOSED = "block long, ids array<long>, stats binary, shas array<string>, edges binary, local binary, times binary, pairs array<long>, n_docs array<long>"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of equal place."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def expand(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)


@cache
def tokenizers(byte_level: str, pieces: str) -> tuple:
    """(tokenizer A, its tokens' bytes by id, tokenizer B, its tokens' bytes by id), read once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path(byte_level))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    symbol = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = one.get_vocab(with_added_tokens=False)
    first = [b""] * one.get_vocab_size()
    for token, k in vocabulary.items():
        first[k] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
    second = [bytes([int(two.id_to_piece(k)[1:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode() for k in range(two.get_piece_size())]
    verify_boundaries(first, second)
    if len(first) > 1 << 16 or len(second) > 1 << 15:
        raise ValueError("a vocabulary is too large for 16-bit numbers")
    return one, first, two, second


def verify_boundaries(*vocabularies: list[bytes]) -> None:
    """Raise ValueError if an entry holds a place at which ``segment_starts`` cuts: only then could a merge cross it."""
    for entries in vocabularies:
        sizes = np.cumsum([0, *(len(e) for e in entries)])
        data = np.frombuffer(b"".join(entries), np.uint8)
        starts = segment_starts(data, sizes)
        if len(across := np.setdiff1d(starts, sizes)):
            raise ValueError(f"a vocabulary entry crosses the boundary of segments: {entries[int(np.searchsorted(sizes, across[0], 'right')) - 1]!r}")


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of the texts start: at each text that has a byte, and at each space after anything but white space.

    What follows a control byte or a multi-byte white space (to be safe, any character of the same lead bytes) is not cut.
    """
    before = np.concatenate((np.zeros(3, np.uint8), data))
    last, middle, lead = before[2:-1], before[1:-2], before[:-3]
    wide = (middle == 0xC2) & np.isin(last, (0x85, 0xA0)) | np.isin(lead, (0xE1, 0xE2, 0xE3)) & np.isin(middle, (0x80, 0x81, 0x9A))
    cut = (data == 0x20) & (last > 0x20) & (last != 0x7F) & ~wide
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def code_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """CODED rows: a block's ids, where the codes of each document begin, its segments' numbers, and the distinct segments.

    A segment is without its leading space, which every one has (the first that of the contract). Segments of a block
    are told apart by 64-bit hashes.
    """

    def code(block: int, ids: list, column: pa.Array) -> pa.RecordBatch:
        data, offsets = W.text_bytes(column)
        starts = segment_starts(data, offsets)
        ends = np.concatenate((starts[1:], [len(data)])).astype(np.int64)
        begin = starts + ~np.isin(starts, offsets)
        _, first, codes, often = np.unique(W.span_hashes(data, begin, ends), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # small numbers for frequent segments
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first, codes, raw = first[order], rank[codes], data.tobytes()
        segments = [raw[a:b] for a, b in zip(begin[first].tolist(), ends[first].tolist(), strict=True)]
        edges = np.searchsorted(starts, offsets)
        row = [[block], [ids], [edges.astype(np.int64).tobytes()], [squeeze(codes)], [segments]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in CODED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 14, [], [], 0
        for batch in batches:
            column = batch.column("text")
            offsets = W.text_bytes(column)[1]
            at = 0
            while at < len(column):
                room = offsets[at] + block_bytes - size
                to = int(np.searchsorted(offsets, room, "right")) - 1
                if to <= at and not ids:
                    to = at + 1
                if to > at:
                    to = min(to, len(column))
                    ids += batch.column("doc_id").slice(at, to - at).to_pylist()
                    texts.append(column.slice(at, to - at))
                    size += int(offsets[to] - offsets[at])
                    at = to
                if at < len(column):
                    yield code(block, ids, pa.concat_arrays(texts))
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield code(block, ids, pa.concat_arrays(texts))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, CODED)


def encode_segments(bodies: list[bytes], tools: tuple) -> list[bytes | None]:
    """Both tokenizers' tokens of each segment (after its space), with marks (``unpack``); None where some side does not spell it.

    Segments are encoded together, as one text cut where it would be cut; what can't be joined so goes alone.
    """
    sizes = np.array([len(b) + 1 for b in bodies])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b" " + b" ".join(bodies), np.uint8)
    cuts = segment_starts(data, np.array([0, len(data)]))
    joins = np.isin(ends[:-1], cuts)  # whether the next segment may follow at once
    out: list[bytes | None] = []
    at = 0
    while at < len(bodies):
        to = at + 1
        while to < len(bodies) and joins[to - 1] and ends[to] - (ends[at] - sizes[at]) <= ENCODED_BYTES:
            to += 1
        out += _encode(bodies[at:to], tools)
        at = to
    return out


def _encode(bodies: list[bytes], tools: tuple) -> list[bytes | None]:
    one, first, two, second = tools
    whole = b" ".join(bodies)
    text = whole.decode("utf-8", "replace")
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text, num_threads=1) if text else [two.piece_to_id("▁")]  # it adds no space to an empty text
    left, right = [first[k] for k in a], [second[k] for k in b]
    if b"".join(left) != b" " + whole or b"".join(right) != b" " + whole:
        half = len(bodies) // 2
        return [None] if len(bodies) == 1 else _encode(bodies[:half], tools) + _encode(bodies[half:], tools)
    over_a, over_b = np.cumsum([len(x) for x in left]), np.cumsum([len(x) for x in right])
    common = np.intersect1d(over_a, over_b)
    ends = np.cumsum([len(x) + 1 for x in bodies])
    if len(np.setdiff1d(ends, common)):
        raise ValueError("a token crosses the boundary of segments")
    i, j = (np.concatenate(([0], np.searchsorted(x, ends, "right"))) for x in (over_a, over_b))
    last_a, last_b = np.isin(over_a, common), np.isin(over_b, common)
    size = np.diff(i)
    place = np.minimum(np.arange(len(a)) - np.repeat(i[:-1], size), SHORT - 1)
    heads = np.add.reduceat(last_a.astype(np.int64) << (4 + place), i[:-1]) | size
    ids_a, ids_b = np.array(a, np.uint32), np.array(b, np.uint32)
    short_a, short_b = ids_a.astype("<u2"), (ids_b << np.uint32(1) | last_b).astype("<u2")
    marked_a, marked_b = ids_a | np.where(last_a, ENDS, np.uint32(0)), ids_b | SECOND | np.where(last_b, ENDS, np.uint32(0))
    out, i, j = [], i.tolist(), j.tolist()
    for k, (head, n) in enumerate(zip(heads.tolist(), size.tolist(), strict=True)):
        if n <= SHORT:
            out.append(head.to_bytes(2, "little") + short_a[i[k] : i[k + 1]].tobytes() + short_b[j[k] : j[k + 1]].tobytes())
        else:
            out.append(b"\0\0" + marked_a[i[k] : i[k + 1]].tobytes() + marked_b[j[k] : j[k + 1]].tobytes())
    return out


def unpack(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked tokens of segments and where each one's begin, from the 16-bit numbers that ``_encode`` sends.

    A head has the number of the first tokenizer's tokens, then a bit for each that ends a group; those follow, then the second's,
    each with its bit. After a head of 0 come the marked tokens themselves.
    """
    rows = np.diff(bounds)
    head = np.zeros(len(rows), np.int64)
    head[rows > 0] = flat[bounds[:-1][rows > 0]]
    first = head & 15
    long = (first == 0) & (rows > 0)
    count = np.where(rows == 0, 0, np.where(long, (rows - 1) // 2, rows - 1))
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint32)
    short = np.flatnonzero((rows > 0) & ~long)
    to = _spread(start[short], count[short])
    value, place = flat[_spread(bounds[:-1][short] + 1, count[short])].astype(np.int64), to - np.repeat(start[short], count[short])
    mine, marks = place < np.repeat(first[short], count[short]), np.repeat(head[short], count[short])
    ends = np.where(mine, marks >> np.minimum(4 + place, 62) & 1, value & 1)
    out[to] = np.where(mine, value, value >> 1 | int(SECOND)) | ends << 31
    for k in np.flatnonzero(long):
        out[start[k] : start[k] + count[k]] = flat[bounds[k] + 1 : bounds[k + 1]].astype("<u2").view("<u4")
    return out, np.append(start, len(out))


def align_segments(held: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """ALIGNED rows of (block, at, segment): equal segments meet, are tokenised and aligned once, and give each of their rows the tokens.

    A block holds a segment once, so a segment has as many rows as blocks hold it, a small share of all however common it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(byte_level, pieces)
        known: dict[bytes, bytes | None] = {}
        for batch in batches:
            rows, where = batch.column("segment").to_pylist(), batch.column("where").to_numpy()
            fresh = [x for x in dict.fromkeys(rows) if x not in known]
            known = {rows[0]: known[rows[0]]} if rows and rows[0] in known else {}  # sorted: only the last of the batch before may recur
            known |= zip(fresh, encode_segments(fresh, tools), strict=True) if fresh else {}
            yield pa.RecordBatch.from_arrays([pa.array(where >> AT_BITS), pa.array((where & (1 << AT_BITS) - 1).astype(np.int32)), pa.array([known[x] for x in rows], pa.binary())], names=["block", "at", "tokens"])
            known = {rows[-1]: known[rows[-1]]} if rows else {}

    where = (F.shiftleft("block", AT_BITS).bitwiseOR(F.col("at").cast("long"))).alias("where")
    return held.select(where, "segment").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, ALIGNED)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch of ``count``, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


class Alignments:
    """Decoded alignments of a block's segments: counts, their text, and the pairs that each links, with times."""

    def __init__(self, tokens: pa.Array) -> None:
        self.good = np.array(tokens.is_valid())
        tokens = tokens.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        raw = np.frombuffer(tokens.buffers()[2], np.uint8) if tokens.buffers()[2] is not None else np.zeros(0, np.uint8)
        flat, bounds = unpack(raw[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2)
        side, ends, ids = (flat & SECOND) > 0, (flat & ENDS) > 0, (flat & ~(SECOND | ENDS)).astype(np.int64)
        self.n_b = W.per_text(side, bounds)
        self.n_a, self.n_groups = np.diff(bounds) - self.n_b, W.per_text(ends & side, bounds)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        group = np.empty(len(flat), np.int64)
        for mine in (a, b):
            group[mine] = np.cumsum(ends[mine]) - ends[mine]
        order = np.argsort(2 * group + side, kind="stable")
        self._spell(ids[order], group[order], side[order], bounds)
        groups = int(self.n_groups.sum())
        of_row = np.repeat(np.arange(len(tokens)), self.n_groups)
        count_a, count_b = (np.bincount(group[m], minlength=groups) for m in (a, b))
        links = count_a * count_b
        self.n_links = np.bincount(of_row, links, len(tokens)).astype(np.int64)
        self._pair(ids[a], ids[b], count_a, count_b, links, of_row, len(tokens))

    def _spell(self, ids: np.ndarray, group: np.ndarray, side: np.ndarray, bounds: np.ndarray) -> None:
        """``text[start:end]`` of each row: ids between commas, the two sides between bars, groups between semicolons."""
        distinct, where = np.unique(ids, return_inverse=True)
        names = [str(k).encode() for k in distinct.tolist()]
        size = np.array([len(x) for x in names], np.int64)
        last = np.cumsum(size)
        self.text, first = W.joined(np.frombuffer(b"".join(names), np.uint8), (last - size)[where], last[where])
        behind = first + size[where]
        self.text[behind] = np.frombuffer(b",", np.uint8)
        turns = np.flatnonzero((group[1:] != group[:-1]) | (side[1:] != side[:-1]))
        self.text[behind[turns]] = np.where(group[turns + 1] != group[turns], ord(";"), ord("|"))
        edge = np.append(first, len(self.text))[bounds]
        self.start, self.end = edge[:-1], np.maximum(edge[1:] - 1, edge[:-1])

    def _pair(self, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, links: np.ndarray, of_row: np.ndarray, rows: int) -> None:
        """``pairs`` of the block, and for each row (``bounds``) the places there of its own and their times."""
        start_a, start_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        few = np.flatnonzero(links <= FEW)
        within = _spread(np.zeros(len(few), np.int64), links[few])
        wide = np.repeat(count_b[few], links[few])
        pair = a[np.repeat(start_a[few], links[few]) + within // wide] << LOW_BITS | b[np.repeat(start_b[few], links[few]) + within % wide]
        row, time = np.repeat(of_row[few], links[few]), np.ones(len(pair), np.int64)
        for g in np.flatnonzero(links > FEW):
            (x, n), (y, m) = (np.unique(ids[s : s + c], return_counts=True) for ids, s, c in ((a, start_a[g], count_a[g]), (b, start_b[g], count_b[g])))
            pair = np.append(pair, (x[:, None] << LOW_BITS | y).ravel())
            time, row = np.append(time, (n[:, None] * m).ravel()), np.append(row, np.full(len(x) * len(y), of_row[g]))
        self.pairs, local = np.unique(pair, return_inverse=True)
        width = max(1, len(self.pairs))
        key, where = np.unique(row * width + local, return_inverse=True)
        self.times = np.bincount(where, time, len(key)).astype(np.int64)
        row, self.local = np.divmod(key, width)
        self.bounds = np.searchsorted(row, np.arange(rows + 1))


def _compose(block: pa.Table, parts: pa.Table) -> pa.Table:
    """COMPOSED row of a CODED row and the ALIGNED rows of its segments."""
    tokens = parts.sort_by("at").column("tokens").combine_chunks() if parts.num_rows else pa.array([], pa.binary())
    known = Alignments(tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens)
    edges = np.frombuffer(block.column("edges")[0].as_py(), np.int64)
    codes, count = expand(block.column("codes")[0].as_py(), int(edges[-1])), np.diff(edges)
    of = lambda x: W.per_text(x[codes], edges) if len(codes) else np.zeros(len(count), np.int64)
    valid = (count > 0) & (of(~known.good) == 0)
    stats = np.stack([of(x) * valid for x in (known.n_a, known.n_b, known.n_groups, known.n_links)])
    shas = [""] * len(count)
    for d in np.flatnonzero(valid):
        digest = hashlib.sha256()
        for k in range(int(edges[d]), int(edges[d + 1]), STEP):
            mine = codes[k : min(k + STEP, int(edges[d + 1]))]
            text, first = W.joined(known.text, known.start[mine], known.end[mine])
            text[first + known.end[mine] - known.start[mine]] = ord(";")
            digest.update(text if k + STEP < edges[d + 1] else text[:-1])
        shas[d] = digest.hexdigest()
    wide = max(1, len(known.good))
    met, often = np.unique((np.repeat(np.arange(len(count)), count) * wide + codes)[np.repeat(valid, count)], return_counts=True)
    doc, code = np.divmod(met, wide)
    some = np.diff(known.bounds)[code]
    at, width = _spread(known.bounds[:-1][code], some), max(1, len(known.pairs))
    key = np.repeat(doc, some) * width + known.local[at]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (known.times[at] * np.repeat(often, some))[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    doc, local = np.divmod(key[new], width)
    if len(weight) and weight.max() >= 1 << 32:
        raise ValueError("a document links one pair more than 2**32 times")
    row = [block.column("block").to_pylist(), block.column("ids").to_pylist(), [stats.tobytes()], [shas], [np.searchsorted(doc, np.arange(len(count) + 1)).astype(np.int64).tobytes()], [squeeze(local)], [squeeze(weight)], [known.pairs], [np.bincount(local, minlength=len(known.pairs))]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
    return pa.table([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in COMPOSED.split(", ")])


def compose(coded: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """COMPOSED rows: per document its counts, digest of groups and linked pairs; per block its pairs and in how many documents each is.

    One group is one block, bounded by its text.
    """
    held = coded.select("block", F.posexplode("segments").alias("at", "segment"))
    back = align_segments(held, byte_level, pieces).withColumnRenamed("block", "of")
    return coded.select("block", "ids", "edges", "codes").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_compose, COMPOSED)


def count_pairs(composed: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each linked pair of ids is, and whether no pair of its first id is in more."""
    each = composed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", LOW_BITS))))


def _report(block: pa.RecordBatch | pa.Table, k: int, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """REPORT rows of the block in row ``k``, given its pairs' counts."""
    ids, edges = block.column("ids")[k].as_py(), np.frombuffer(block.column("edges")[k].as_py(), np.int64)
    local, times = (expand(block.column(c)[k].as_py(), int(edges[-1])) for c in ("local", "times"))
    best, total = (W.per_text(times * x[local] if len(local) else times, edges) for x in (best, count))
    stats = np.frombuffer(block.column("stats")[k].as_py(), np.int64).reshape(4, len(ids))
    columns = [pa.array(ids, pa.int64()), *map(pa.array, (*stats, best, total)), pa.array(block.column("shas")[k].as_py(), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in REPORT.split(", ")])


def align_documents(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """REPORT rows, one per row of ``docs``: counts of tokens, groups and links, and how usual the links are in the corpus.

    Text is encoded after one space by both tokenizers, special tokens' names being plain text. Null and empty texts, and those
    that some token sequence does not spell, have no tokens: zeros, and an empty digest. A pair's count is over
    rows, so repeated rows count each; a null id is reported like any other. Columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    composed = materialise(compose(materialise(code_documents(docs, block_bytes), "coded"), byte_level, pieces), "composed")
    counts = materialise(count_pairs(composed), "pair-counts")
    if counts.count() <= broadcast_pairs:
        held = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "count", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, count, best = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    at = np.searchsorted(pair, np.array(batch.column("pairs")[k].as_py(), np.int64))
                    yield _report(batch, k, count[at], best[at].astype(np.int64))

        return composed.select("ids", "stats", "shas", "edges", "local", "times", "pairs").mapInArrow(run, REPORT)
    wanted = composed.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    left = composed.select("block", "ids", "stats", "shas", "edges", "local", "times").groupBy("block")

    def join(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("at")
        return pa.Table.from_batches([_report(block, 0, found.column("count").to_numpy(), found.column("best").to_numpy().astype(np.int64))])

    return left.cogroup(wanted.groupBy("of")).applyInArrow(join, REPORT)
