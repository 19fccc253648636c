import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import near_dup
from tallyforge.llm import words as W
from tests.llm.conftest import same


def shingles(text, k=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=2):
    """component by id, comparing all pairs; rows of one id are one document"""
    known = [(i, shingles(t, k)) for i, t in rows if i is not None]
    top = {i: i for i, _ in known}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, (i, a) in enumerate(known):
        for j, b in known[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: (len(a), find(i)) for i, a in known}


def check(spark, rows, k=2):
    got = near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_ids_with_several_texts(spark):
    """Whichever of an id's texts a link is to, and whichever row comes first."""
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(101)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda t, n: " ".join([*t[:-n], *(f"n{n}{i}" for i in range(n))])
    plain = [" ".join(t) for t in (a, b, c, d)]
    rows = [(5, plain[0]), (5, plain[1]), (9, near(a, 2)), (11, near(b, 3)), (2, near(a, 4)), (20, plain[2]), (20, plain[3]), (7, plain[2]), (8, near(d, 2)), (30, plain[3]), (31, "alone it is"), (31, plain[1]), (6, "")]
    for order in (rows, rows[::-1]):
        got = near_dup.find_groups(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 2).select("doc_id", "component_id").distinct().collect()
        assert dict(map(tuple, got)) == {2: 2, 5: 2, 9: 2, 11: 2, 31: 2, 7: 7, 8: 7, 20: 7, 30: 7, 6: 6}
        assert {i: c for i, (_, c) in brute(rows).items()} == dict(map(tuple, got))


def test_one_with_many_partners(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "VERIFY_BLOCK", 3)
    base = [f"w{i}" for i in range(100)]
    check(spark, [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(40)] + [(90, " ".join(base[:60]))])


def test_fixture(spark, rows):
    for k in (2, 5):
        check(spark, [(r[0], r[1]) for r in rows], k)


def test_chains_stars_and_thresholds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(160):
        edited = list(base)
        for k in rng.sample(range(150), 5 + i % 9):
            edited[k] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + (i * 37) % 160, " ".join(edited)))
    step = list(base)
    for i in range(40):
        step[(i * 3) % 150] = f"y{i}"
        rows.append((i, " ".join(step)))
    rows += [(500, "a b c d e f g h i j k"), (501, "a b c d e f g h i j"), (502, "A  B\nc d e f g h i j K"), (503, "solo"), (504, "SOLO"), (505, ""), (506, None), (507, " "), (None, "a b c d e f g h i j k")]
    check(spark, rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    test_chains_stars_and_thresholds(spark)


def chain_rows(n=45):
    """Each text differs from the one before by a few words, so that the ends are far apart, in one family of buckets."""
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(400)}" for _ in range(120)], []
    for i in range(n):
        base[(i * 7) % 120] = f"z{i}"
        rows.append((n - i, " ".join(base)))
    return rows


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Blocks of 4: trees, roots and doubtful trees; every pair that the estimate passes is reached."""
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 4)
    check(spark, chain_rows())
    heads = near_dup.sketch_documents(spark.createDataFrame(chain_rows(), "doc_id long, text string"), 2).drop("set_key").cache()
    held = {r.doc_id: r for r in heads.collect()}
    top = {i: i for i in held}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in near_dup.candidate_pairs(heads).collect():
        assert r.a < r.b
        x, y = sorted((find(r.a), find(r.b)))
        top[y] = x
    meeting = 0
    for i in held:
        for j in held:
            if i < j and set(held[i].bands) & set(held[j].bands):
                agree = np.mean(np.frombuffer(held[i].signature, np.uint8) == np.frombuffer(held[j].signature, np.uint8))
                if agree >= near_dup.ESTIMATE and 100 * min(held[i].n_shingles, held[j].n_shingles) >= 80 * max(held[i].n_shingles, held[j].n_shingles):
                    meeting += 1
                    assert find(i) == find(j)
    assert meeting > 20


def test_without_the_estimate(spark, monkeypatch):
    rows = chain_rows(24)
    got = near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, estimate=0.0).collect()
    want = brute(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *want[i]) for i in want}


def test_hubs_change_nothing(spark, monkeypatch):
    rows = [(g, a, b) for g in (0, 1) for a, b in [(1, i) for i in range(2, 40)] + [(50, 51), (51, 52), (39, 60)]]
    edges = spark.createDataFrame(rows, "graph int, a long, b long")
    want = sorted(near_dup.components(edges).collect())
    assert {r.component for r in want} == {1, 50}
    monkeypatch.setattr(near_dup, "HUB", 3)
    assert sorted(near_dup.components(edges).collect()) == want


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 exactly (or just above, for sizes that have none) share a band and pass the estimate."""
    rng = np.random.default_rng(12)
    for union in (5, 10, 50, 1000):
        common, n, sets, bounds = -(-4 * union // 5), 2000, [], [0]
        for _ in range(n):
            values = rng.integers(0, 1 << 63, union).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, union).astype(np.uint64)
            for own in (values[: common + (union - common) // 2], np.concatenate((values[:common], values[common + (union - common) // 2 :]))):
                sets.append(own)
                bounds.append(bounds[-1] + len(own))
        signs = near_dup.signatures(np.concatenate(sets), np.array(bounds))
        one, two = signs[::2], signs[1::2]
        banded = (one.reshape(n, near_dup.BANDS, near_dup.ROWS) == two.reshape(n, near_dup.BANDS, near_dup.ROWS)).all(axis=2).any(axis=1)
        passing = (one.astype(np.uint8) == two.astype(np.uint8)).mean(axis=1) >= near_dup.ESTIMATE
        print("recall", union, banded.mean(), passing.mean(), (banded & passing).mean())
        assert banded.mean() > 0.999 and (banded & passing).mean() > 0.99


def test_equal_old_hashes_are_told_apart(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    check(spark, [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)])


def test_keep_first_drops_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 9, "k")] * 3 + [(2, text, 9, "k"), (3, "other words here", 1, "x"), (3, "another text", 1, "y"), (None, text, 1, "n"), (None, text, 1, "n"), (4, None, 1, "z"), (4, None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, `a.b` string")
    got = near_dup.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [rows[0], rows[5], rows[6], rows[6], rows[8]]))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 500, 500))
    one, two = (np.unique(np.concatenate((common, x))) for x in (a, b))
    signs = near_dup.signatures(np.concatenate((one, two)), np.array([0, len(one), len(one) + len(two)]))
    assert abs((signs[0] == signs[1]).mean() - 0.75) < 0.15
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(near_dup._permute(x.copy()))) == len(x)


def test_sets_are_the_shingles():
    texts = ["a b a b a", "One", "", None, "x y", "ünï ünÏ ünï"]
    column = pa.array(texts)
    data, offsets = W.text_bytes(column)
    for k in (1, 2, 3, 5, 9):
        values, bounds = near_dup.shingle_sets(data, offsets, k)
        assert list(np.diff(bounds)) == [len(shingles(t, k)) for t in texts]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            assert (np.diff(values[i:j].astype(object)) > 0).all()


def test_tables(spark, docs, crowded, empty):
    assert near_dup.find_groups(empty).count() == 0
    assert same(near_dup.find_groups(docs), near_dup.find_groups(crowded))
    kept = near_dup.find_groups(docs).where("kept").select("doc_id").distinct()
    assert same(kept, near_dup.keep_first(docs).select("doc_id"))
    assert near_dup.keep_first(crowded).columns == crowded.columns


def test_without_broadcast(docs, monkeypatch):
    want = near_dup.find_groups(docs).collect()
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    assert sorted(map(str, near_dup.find_groups(docs).collect())) == sorted(map(str, want))
