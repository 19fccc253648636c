"""Packing documents into token windows by lexical retrieval."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import materialise

WINDOW = 1024
END = 0
#: Fixed value: the one token that the vocabulary's tokenizers file adds, cut out of a text before all else.
ADDED = "<|endoftext|>"
#: Remainders in one shard of the index, by its mean.
SHARD_ROWS = 4096
K1, B = 1.2, 0.75
#: Ids of a vocabulary under 65,536 are kept as little-endian unsigned 16-bit numbers.
VOCABULARY = 1 << 16
#: Ids in more than a 1 / DENSE of a shard's rows have a dense row of weights beside the postings, multiplied for BLOCK rows at once.
DENSE, BLOCK = 12, 64
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_CUT = _ARROW.append(pa.field("sketch", pa.int64())).append(pa.field("number", pa.int64()))


def load_encoder(path: str | None = None):
    """Byte-level BPE from ranks: the vocabulary and ids of the tokenizers file of that name, its added token included."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: len(ranks)})


def pair_sketch(ids: np.ndarray) -> int:
    """The least hash of a row's pairs of neighbouring ids (of its ids, if it has one only): like texts often share it."""
    row = ids.astype(np.uint32)
    pairs = (row[:-1] << np.uint32(16) | row[1:]) if len(row) > 1 else row
    return int((pairs * np.uint32(0x9E3779B1) ^ (pairs >> np.uint32(13)) * np.uint32(0x85EBCA77)).min())


def cut_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every whole document: full windows, which are sequences already, and a remainder.

    A document's ids are its text's and END; a null text has only END. Sequence ids of full
    windows are odd and unique; a remainder has none yet, but its sketch and a number of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer)
        number = own = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u2")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    full = len(piece) == window
                    rows.append((doc_id, at, len(piece), len(ids), piece.tobytes(), 2 * number + 1 if full else None, 0 if full else None, None if full else pair_sketch(piece), own))
                    number, own = number + full, own + 1
                held += len(ids)
                if held > 1 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, f"{PIECES}, sketch long, number long")


@dataclass
class Statistics:
    """What BM25 needs of all remainders; its size is bounded by the vocabulary."""

    rows: int
    mean_length: float
    document_frequency: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.rows - self.document_frequency + 0.5) / (self.document_frequency + 0.5))


def gather_statistics(rest: DataFrame) -> Statistics:
    """Count, mean length, and in how many remainders each id occurs; each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY + 2, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                row = np.frombuffer(ids.as_py(), "<u2")
                seen[np.unique(row)] += 1
                seen[VOCABULARY:] += (1, len(row))
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(seen[terms], pa.int64())], names=["term", "n"])

    counts = rest.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(VOCABULARY + 2, np.int64)
    seen[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    rows, ids = (int(n) for n in seen[VOCABULARY:])
    return Statistics(rows, ids / rows if rows else 1.0, seen[:VOCABULARY].astype(float))


class Index:
    """BM25 postings of one shard's remainders; ids in many of its rows are held as dense rows of weights."""

    def __init__(self, rows: list[np.ndarray], known: Statistics):
        lengths = np.array([len(r) for r in rows])
        keys, tf = np.unique(np.repeat(np.arange(len(rows)), lengths) * VOCABULARY + np.concatenate(rows), return_counts=True)
        owner, term = keys // VOCABULARY, keys % VOCABULARY
        idf = known.idf()
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / known.mean_length))
        self.rows = len(rows)
        common = np.flatnonzero(np.bincount(term, minlength=VOCABULARY) * DENSE > len(rows))
        place = np.full(VOCABULARY, -1)
        place[common] = np.arange(len(common))
        dense = place[term] >= 0
        self.dense, self.asked = np.zeros((len(common), len(rows)), np.float32), np.zeros((len(rows), len(common)), np.float32)
        self.dense[place[term[dense]], owner[dense]] = weight[dense]
        self.asked[owner[dense], place[term[dense]]] = 1
        self.blocks: dict[int, np.ndarray] = {}
        cut = np.searchsorted(owner, np.arange(1, len(rows)))
        self.terms = np.split(term, cut)
        owner, term, weight = owner[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every row over all of the seed's distinct terms, in single precision and to 3 places, so that equal rows tie."""
        spans = [slice(a, b) for a, b in zip(self.start[self.terms[seed]], self.start[self.terms[seed] + 1], strict=True) if a < b]
        block = seed // BLOCK
        if block not in self.blocks:
            self.blocks[block] = self.asked[block * BLOCK : (block + 1) * BLOCK] @ self.dense
        out = self.blocks[block][seed % BLOCK].astype(np.float64)
        if spans:
            out += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.rows)
        return np.round(out, 3)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused rows that share a term with the seed, by score, best first, ties in row order; found as they are asked for."""
        left = np.where(unused, self.scores(seed), 0.0)
        while left[best := int(np.argmax(left))] > 0:
            yield best
            left[best] = 0.0


def fill_windows(rows: list[np.ndarray], known: Statistics, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(sequence, offset, row, start, length): every id of every row once, windows full but the last.

    A seed's neighbours fill its window in order of score. The one that doesn't fit is cut,
    and its rest begins the next window as that window's seed. With no neighbour left, the
    next unused row becomes a seed in the same window.
    """
    index = Index(rows, known)
    unused = np.ones(len(rows), bool)
    sequence, offset, after = 0, 0, 0
    queue: Iterator[int] = iter(())
    while True:
        row = next((r for r in queue if unused[r]), None)
        seeding = row is None
        if seeding:
            while after < len(rows) and not unused[after]:
                after += 1
            if after == len(rows):
                return
            row = after
        unused[row] = False
        at = 0
        while at < len(rows[row]):
            if offset == window:
                sequence, offset, seeding = sequence + 1, 0, True
            take = min(window - offset, len(rows[row]) - at)
            yield sequence, offset, row, at, take
            at, offset = at + take, offset + take
        if seeding:
            queue = index.neighbours(row, unused)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of all documents with their place: PIECES, ids as unsigned 16-bit numbers.

    Remainders are dealt by range of a sketch of their own id pairs, so that near copies
    share a shard; ties are split by doc_id and then by the remainder's own number, so no group
    of copies or repeated rows outgrows a shard. Each shard builds an inverted index, weighed
    by statistics of all remainders, and packs itself; only its last sequence is short. Seeds are
    compared with the remainders of their shard only. Empty tables give no piece; null ids and
    repeated rows are packed as rows of their own; columns beyond doc_id and text are not
    read.
    """
    pieces = materialise(cut_documents(docs, window, tokenizer), "pieces")
    rest = pieces.where("sequence_id is null")
    known = gather_statistics(rest)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    dealt = rest.select("doc_id", "start", "doc_tokens", "ids", "sketch", "number")
    dealt = dealt.repartitionByRange(max(1, -(-known.rows // shard_rows)), "sketch", "doc_id", "number").sortWithinPartitions("sketch", "doc_id", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        held = pa.Table.from_batches(got)
        doc_ids, starts, totals = (held.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        rows = [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in held.column("ids")]
        base = TaskContext.get().partitionId() << 33
        out = []
        for sequence, offset, row, at, take in fill_windows(rows, shared.value, window):
            out.append((doc_ids[row], starts[row] + at, take, totals[row], rows[row][at : at + take].astype("<u2").tobytes(), 2 * (base + sequence), offset))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return pieces.where("sequence_id is not null").drop("sketch", "number").unionByName(dealt.mapInArrow(run, PIECES))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids as little-endian unsigned 32-bit numbers, without the ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4")) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([sums if n == "ids_crc32" else batch.column(n) for n in names], names=names)

    return pieces.mapInArrow(run, ", ".join(f"{n} long" for n in names))
