"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.shared import materialise

#: The base patterns and the least length of what must match.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
#: A string that the models judge.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])")
PLAIN = re.compile(r"[A-Za-z0-9+/_-]{6,}")
#: Documents, first by hash of their id, from which labelled strings are taken.
FIT_DOCS = 3000
#: Random strings drawn beside those that the base patterns label, and identifiers made of words of the corpus.
DRAWN, MADE = 4000, 4000
#: Ordinary words of the corpus, first by hash, of which identifiers are made.
WORDS = 5000
#: Share of ordinary strings of LEAST characters or more that the threshold may let through.
LEAST, FALSE_ALARMS = 16, 0.002
#: Different characters without which a string is a rule or a repeat ("-----", "=-=-=-"), whatever the models say: a random key of the
#: smallest alphabet here, 16 hexadecimal digits, has fewer in one of 700 cases at 16 characters, and in none of a million at 32.
DISTINCT = 7
#: Fixed value: how a UUID is written; it names something and keeps nothing secret.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CODE = np.full(256, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern, without those too short.

    A run of hex digits of 32 or more is what is left of HEX's matches, so only such runs
    are searched for; ACCESS likewise.
    """
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Models:
    """Log-odds of each character pair, random over ordinary; a string's mean decides."""

    odds: np.ndarray
    threshold: float

    def ratio(self, string: str) -> float:
        codes = _codes(string)
        return float(self.odds[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def secret(self, string: str) -> bool:
        """Whether a candidate is taken for a key: likelier random than ordinary, and neither a rule, a repeat nor a UUID."""
        return self.ratio(string) > self.threshold and len(set(string)) >= DISTINCT and not UUID.fullmatch(string.strip("+/_-"))


def _codes(string: str) -> np.ndarray:
    return _CODE[np.frombuffer(string.encode("latin-1", "replace"), np.uint8)]


def count_pairs(strings: Iterable[str]) -> np.ndarray:
    """How often each character follows each other one."""
    counts = np.zeros((len(_ALPHABET) + 1,) * 2, np.int64)
    for s in strings:
        codes = _codes(s)
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return counts


def log_odds(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """First-order Markov models of both labels from their pair counts, half a pair added to each."""
    one, two = (np.log((c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True)) for c in (random, ordinary))
    return one - two


def choose_threshold(random: np.ndarray, ordinary: np.ndarray) -> float:
    """The lowest hundredth of random ratios, so that nearly all are found, but never below the FALSE_ALARMS quantile of ordinary ones."""
    high = float(np.quantile(ordinary, 1 - FALSE_ALARMS, method="higher")) if len(ordinary) else 0.0
    return max(high, float(np.quantile(random, 0.01))) if len(random) else high


def train(random: list[str], ordinary: list[str]) -> Models:
    """Models of labelled strings at hand."""
    models = Models(log_odds(count_pairs(random), count_pairs(ordinary)), 0.0)
    models.threshold = choose_threshold(*(np.array([models.ratio(s) for s in part if len(s) >= LEAST]) for part in (random, ordinary)))
    return models


def drawn_strings(n: int = DRAWN, seed: int = 5) -> list[str]:
    """Random strings of 20 to 64 characters over the alphabets that keys use."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
    alphabets = [list(x) for x in (_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "_-", lower + digits, upper + "234567", upper[:6] + digits, lower[:6] + digits)]
    return ["".join(rng.choice(alphabets[i % len(alphabets)], int(rng.integers(20, 65)))) for i in range(n)]


def made_identifiers(words: list[str], n: int = MADE, seed: int = 6) -> list[str]:
    """Names of LEAST characters or more as people write them: words joined in the usual cases, with dates, versions and counters."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["name"]
    out = []
    for i in range(n):
        some = [words[int(k)].lower() for k in rng.integers(len(words), size=int(rng.integers(2, 6)))]
        year, month, day, number = int(rng.integers(1990, 2035)), int(rng.integers(1, 13)), int(rng.integers(1, 29)), int(rng.integers(10 ** int(rng.integers(1, 7))))
        tail = [f"{year}-{month:02}-{day:02}", f"{year}{month:02}{day:02}", f"{year}{month:02}{day:02}_{number:06}", f"v{number % 30}-{month}", str(number), ""][i % 6]
        if i % 7 == 0:  # a path: folders, some numbered, and a name
            parts = [w if rng.random() < 0.8 else f"{w}{int(rng.integers(100))}" for w in some]
            out.append("/".join(["", *parts] * (1 + LEAST // (1 + len("/".join(["", *parts])))))[:80])
            continue
        mark = "-_/+"[int(rng.integers(4)) if i % 5 == 0 else int(rng.integers(2))]
        cased = [some, [w.upper() for w in some], [w.title() for w in some], [some[0], *(w.title() for w in some[1:])]][int(rng.integers(4))]
        name = (mark if rng.random() < 0.7 else "").join(cased)
        whole = (mark.join(x for x in (name, tail) if x) if rng.random() < 0.8 else mark.join(x for x in (tail, name) if x))[:80]
        while len(whole) < LEAST:
            whole += mark + str(rng.choice(words))
        out.append(whole)
    return out


def _labelled(text: str) -> Iterator[tuple[str, bool]]:
    """(string, random) of one text: what the base patterns find, and the runs of key characters without a digit outside it."""
    at, rest = 0, []
    for start, end, kind in base_spans(text):
        found = re.search(r"[A-Za-z0-9+/_-]{16,}$", text[start:end]) if kind == "assign" else re.search(r".+", text[start:end])
        if found:
            yield found[0], True
        rest.append(text[at:start])
        at = max(at, end)
    for m in PLAIN.finditer(" ".join([*rest, text[at:]])):
        if not re.search(r"\d", m[0]):
            yield m[0], False


def fit_models(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Models:
    """Train on strings of the ``fit_docs`` documents first by a hash of their id.

    Labelled random: what the base patterns find there, and drawn strings. Labelled
    ordinary: all other runs of six or more key characters without a digit, and identifiers
    made of some of them, with and without digits. Other runs with digits bear no label. The
    strings stay where they are: tasks send counts of character pairs, then counts of ratios by
    hundredths, so what reaches the driver is bounded whatever the texts' lengths. Null
    ids and texts are left out.
    """
    chosen = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit("secret"), "doc_id"), "doc_id").limit(fit_docs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = list(_labelled(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([r for _, r in found], pa.bool_())], names=["string", "random"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").where("text is not null").mapInArrow(label, "string string, random boolean")
    strings = materialise(rows.distinct(), "labelled")
    side = len(_ALPHABET) + 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, side, side), np.int64)
        for batch in batches:
            random = batch.column("random").to_pylist()
            for way in (0, 1):
                seen[way] += count_pairs(s for s, r in zip(batch.column("string").to_pylist(), random, strict=True) if r == way)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["pair", "n"])

    got = strings.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(2 * side * side, np.int64)
    seen[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    words = strings.where("not random and length(string) between 3 and 12").orderBy(F.xxhash64("string"), "string").limit(WORDS).toArrow().column("string").to_pylist()
    drawn, made = drawn_strings(), made_identifiers(words)
    ordinary, random = seen.reshape(2, side, side)
    models = Models(log_odds(random + count_pairs(drawn), ordinary + count_pairs(made)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(r, int(np.floor(100 * shared.value.ratio(s)))) for s, r in zip(batch.column("string").to_pylist(), batch.column("random").to_pylist(), strict=True) if len(s) >= LEAST]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.bool_()), pa.array([h for _, h in held], pa.int64())], names=["random", "hundredth"])

    bins = strings.mapInArrow(ratios, "random boolean, hundredth long").groupBy("random", "hundredth").count().orderBy("random", "hundredth").collect()
    spread = {way: np.repeat([(b.hundredth + 1) / 100 for b in bins if b.random == way], [b["count"] for b in bins if b.random == way]) for way in (True, False)}
    models.threshold = choose_threshold(*(np.concatenate((spread[way], [models.ratio(s) for s in more])) for way, more in ((True, drawn), (False, made))))
    return models


def all_spans(text: str, models: Models) -> list[Span]:
    """Base spans, and the candidates whose ratio is above the threshold; of a candidate that base spans overlap, the parts outside them are judged."""
    spans = base_spans(text)
    more: list[Span] = []
    i = 0
    for m in CANDIDATE.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        at, j = m.start(), i
        while at < m.end():
            while j < len(spans) and spans[j][1] <= at:
                j += 1
            to = min(m.end(), max(at, spans[j][0])) if j < len(spans) else m.end()
            if to - at >= LEAST and models.secret(text[at:to]):
                more.append((at, to, "markov"))
            at = spans[j][1] if to < m.end() else to
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``spans`` (start, end, kind; code points, end exclusive) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in all_spans(t.as_py() or "", shared.value)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], names=[*keep, "spans"])

    spans = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string"))
    return kept.mapInArrow(run, kept.select(*keep).schema.add("spans", spans))


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans.

    Null and empty texts have no spans. Repeated rows are reported each; columns beyond
    doc_id and text are not read.
    """
    spans = find_secrets(docs, fit_models(docs), ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        of("markov").alias("n_markov"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans are one. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_models(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            out = []
            for t in batch.column(i):
                text = t.as_py()
                at, parts = 0, []
                for start, end, _ in all_spans(text or "", shared.value):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield batch.set_column(i, batch.schema.field(i).name, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(s for s in spans if s[2] != "markov").encode()).hexdigest()
