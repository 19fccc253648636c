import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import periodic
from tests.llm.conftest import same


def hashed(words):
    return np.array([zlib.crc32(str(w).encode()) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def brute(words):
    """Every maximal stretch of each period, the smallest period of each stretch."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(24, 3 * p):
                best.setdefault((i, length), p)
            i = j
    return sorted((s, length, p) for (s, length), p in best.items())


def check(words):
    got = [tuple(r) for r in periodic.find_runs(hashed(words)).tolist()]
    want = sorted(brute(words), key=lambda r: (r[0], r[2]))
    assert got == want
    return want


def test_shapes():
    rng = random.Random(3)
    assert check([]) == [] and check(["a"] * 23) == []
    assert check(["a"] * 24) == [(0, 24, 1)]
    assert check(["a"] * 500) == [(0, 500, 1)]
    assert check(list("ab") * 12 + ["x"] + list("abc") * 8) == [(0, 24, 2), (25, 24, 3)]
    for _ in range(60):
        words = []
        while len(words) < 400:
            unit = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
            words += [rng.randrange(50) for _ in range(rng.randrange(30))] + (unit * 9)[: rng.randrange(1, 9 * len(unit) + 1)]
        check(words)


def test_nested_and_overlapping():
    inner = ["a"] * 30 + ["b"]
    assert len(check(inner * 5)) == 6
    fib = ["a"]
    other = ["b"]
    while len(fib) < 600:
        fib, other = fib + other, fib
    assert check(fib) is not None
    check(list("aab" * 20 + "aabaab" * 4 + "abaab" * 11))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 9)), max_size=8))
def test_any_sequence(parts):
    check([w for unit, times in parts for w in unit * times])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=80), st.data())
def test_extensions(ids, data):
    ext = periodic.Extensions(np.array(ids, np.uint64))
    for _ in range(10):
        x, y = data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))
        if x == y:
            continue
        want = 0
        while max(x, y) + want < len(ids) and ids[x + want] == ids[y + want]:
            want += 1
        assert ext.query(np.array([x]), np.array([y]))[0] == want


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_rows(spark, rows):
    rng = random.Random(9)
    more = [(1000 + i, " \n".join(rng.choice("xyz") + str(rng.randrange(9)) for _ in range(rng.randrange(300)))) for i in range(80)]
    more += [(None, "la " * 40), (7, "do re mi\n" * 30 + "fa"), (7, "do re mi\n" * 30 + "fa"), (8, None), (9, "")]
    data = [(r[0], r[1]) for r in rows if len(r[1] or "") < 10**5] + more
    got = periodic.run_digests(periodic.collapse_runs(spark.createDataFrame(data, "doc_id long, text string").repartition(3), plant=True)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, (plain_row(*d) for d in data)))
    assert sum(r.n_runs > 0 for r in got) > 5


def test_text_is_collapsed(spark):
    row = periodic.collapse_runs(spark.createDataFrame([(1, "so " + "one two  three\n" * 9 + "end", "x")], "doc_id long, text string, runs string")).first()
    assert row.text == "so one two three end" and [tuple(r) for r in row.runs] == [(1, 27, 3)]


def test_a_long_text(spark):
    text = "w1 w2 w3 w4 " * 100_000 + "a " * 300_000
    row = periodic.run_digests(periodic.collapse_runs(spark.createDataFrame([(2, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 400_000, 300_000, 1)


def test_tables(docs, crowded, empty):
    assert periodic.run_digests(periodic.collapse_runs(empty)).count() == 0
    assert same(periodic.run_digests(periodic.collapse_runs(docs)), periodic.run_digests(periodic.collapse_runs(crowded)))
