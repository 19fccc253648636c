import math
import uuid
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tallyforge.llm import language_model as lm


def test_counts_and_base_score(docs, rows):
    counts, ends = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update((r[1] or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    texts = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = texts[r.doc_id]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert held


def test_blocks_change_nothing(docs, monkeypatch):
    want = {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_WORDS", 500)
    assert {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs).collect()} == want


def random_weights(seed=3):
    rng = np.random.default_rng(seed)
    w = lm.start_weights(rng.integers(1, 50, lm.SLOTS))
    w["v"] = rng.normal(0, 0.5, w["v"].shape).astype(np.float32)
    return w


def test_probabilities_sum_to_one():
    w = random_weights()
    prefix = np.array([3, 40, 7, 700], np.int64)
    every = [np.concatenate((prefix, [c])) for c in range(lm.SLOTS)]
    scores = lm.score_rows(w, every)
    assert abs((10 ** (scores - lm.score_rows(w, [prefix])[0])).sum() - 1) < 1e-3


def plain_scores(w, rows):
    """One token at a time, with the gates written out."""
    n, out = lm.HIDDEN, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    for row in rows:
        h, before, total = np.zeros(n), lm.SLOTS, 0.0
        for slot in row:
            x, inner = w["e"][before] @ w["x"] + w["b"], h @ w["u"]
            z, r = sigmoid(x[:n] + inner[:n]), sigmoid(x[n : 2 * n] + inner[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * inner[2 * n :])
            logits = h @ w["o"] + w["k"]
            kind = slot if slot <= lm.SINGLES else 1 + lm.SINGLES + (slot - 1 - lm.SINGLES) // lm.MEMBERS
            total += logits[kind] - np.log(np.exp(logits).sum())
            if slot > lm.SINGLES:
                g, place = divmod(slot - 1 - lm.SINGLES, lm.MEMBERS)
                inner = h @ w["v"][g] + w["m"][g]
                total += inner[place] - np.log(np.exp(inner).sum())
            before = slot
        out.append(total / math.log(10))
    return out


def test_scores_are_those_of_a_plain_network(monkeypatch):
    """States run across windows, and begin anew with each document, however they are laid out."""
    w = random_weights()
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, lm.SLOTS, n) for n in (1, 5, 31, 32, 33, 200, 64, 1, 2, 90)]
    want = plain_scores(w, rows)
    for lanes in (1, 3, 256):
        monkeypatch.setattr(lm, "LANES", lanes)
        assert np.allclose(lm.score_rows(w, rows), want, rtol=1e-4, atol=1e-3)


def test_every_token_is_laid_out_once():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, lm.SLOTS, n) for n in rng.integers(1, 120, 50)]
    seen = {d: [] for d in range(50)}
    for before, target, going, mask, document in lm.streams(rows, 7):
        for lane in range(target.shape[1]):
            for t in range(lm.STEPS):
                if mask[t, lane]:
                    held = seen[document[t, lane]]
                    assert before[t, lane] == (held[-1] if held else lm.SLOTS) and going[t, lane] == bool(held)
                    held.append(target[t, lane])
    assert all(np.array_equal(seen[d], rows[d]) for d in seen)


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in random_weights().items()}
    before, target = rng.integers(0, 100, (6, 3)), rng.integers(0, 100, (6, 3))
    target[0, 0] = 40
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    going = np.ones((6, 3))
    going[2, 1] = 0
    h = rng.normal(0, 0.5, (lm.HIDDEN, 3))
    _, g, _ = lm.train_step(w, before, target, going, mask, h)
    group, place = divmod(40 - 1 - lm.SINGLES, lm.MEMBERS)
    for k, at in (("e", (int(before[0, 0]), 5)), ("e", (int(before[3, 1]), 9)), ("x", (4, 60)), ("x", (7, 3)), ("b", (30,)), ("u", (2, 40)), ("u", (3, 70)), ("o", (3, 4)), ("k", (1 + lm.SINGLES,)), ("v", (group, 2, place)), ("m", (group, place))):
        keep, e = w[k][at], 1e-4
        w[k][at] = keep + e
        up = lm.train_step(w, before, target, going, mask, h)[0]
        w[k][at] = keep - e
        down = lm.train_step(w, before, target, going, mask, h)[0]
        w[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5


def test_score_beats_the_base_on_held_out_rows(spark, tmp_path):
    """Words follow each other in a fixed order, which counts can't tell; whole corpus of 1,500 texts."""
    rng = np.random.default_rng(6)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(i, " ".join(names[(s + k) % 200] for k in range(60))) for i, s in enumerate(rng.integers(0, 200, 1500).tolist())]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").collect()
    assert len(got) > 150
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_scores_do_not_depend_on_the_order_of_rows(docs):
    one = sorted((r.doc_id, r.score) for r in lm.score_documents(docs.coalesce(1)).collect())
    two = sorted((r.doc_id, r.score) for r in lm.score_documents(docs.orderBy(F.rand(3)).repartition(7, F.rand(4))).collect())
    assert one == two


def test_words_of_equal_old_hashes_are_told_apart(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [(i, one) for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:3] + [(100, other)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[100].base_score < got[texts[0][0]].base_score


def test_training_learns_a_sequence():
    rng = np.random.default_rng(1)
    rows = [np.arange(s, s + 60) % 20 for s in rng.integers(0, 20, 6000)]
    w = lm.start_weights(np.ones(lm.SLOTS))
    before = lm.score_rows(w, rows[:10]).sum()
    assert lm.score_rows(lm.train_on(w, rows), rows[:10]).sum() > 0.6 * before


def test_every_training_document_is_trained_on_once(spark, tmp_path, monkeypatch):
    """More tokens than any task needs, in few and in many tasks: each document in one round, the same one in both."""
    rows = [(i if i else None, i % 7 == 2, 100, bytes([i >> 6, 0, i & 63, 0]) + bytes(196)) for i in range(4000)]

    def rounds(parts):
        folder = tmp_path / str(parts)
        folder.mkdir()

        def keep(w, rows, rate=lm.RATE):
            with open(folder / uuid.uuid4().hex, "w") as out:
                out.writelines(f"{rate} {int(r[0]) << 6 | int(r[1])}\n" for r in rows)
            return w

        monkeypatch.setattr(lm, "train_on", keep)
        sequences = spark.createDataFrame(rows, "doc_id long, held_out boolean, n_tokens long, slots binary").repartition(parts)
        lm.train(sequences, lm.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int64), 1, 1, 1, np.ones(lm.SLOTS), np.ones(lm.GROUPS)))
        return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())

    few, many = rounds(1), rounds(7)
    assert few == many
    assert sorted(int(line.split()[1]) for line in few) == [i for i in range(4000) if i % 7 != 2]
    assert len({line.split()[0] for line in few}) == lm.ROUNDS


def test_tables(crowded, docs, empty):
    assert lm.score_documents(empty).count() == 0
    names = ["doc_id", "n_tokens", "n_known", "base_score"]
    assert {tuple(r) for r in lm.score_documents(crowded).select(names).collect()} == {tuple(r) for r in lm.score_documents(docs).select(names).collect()}
    out = lm.score_documents(docs.where("doc_id in (1)").limit(1)).collect()
    assert len(out) == 1
