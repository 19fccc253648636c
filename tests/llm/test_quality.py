import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import quality
from tests.llm.conftest import same

WS = " \t\n\v\f\r"


def plain(text):
    raw = (text or "").encode()
    words = [w.decode() for w in raw.split()]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 20 or 100 * r > 30 * n


def test_base_statistics(docs, labels, rows):
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows)
    want = {r[0]: plain(r[1]) for r in rows}
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want[g.doc_id]
        assert not (g.base_failed and g.kept)


def test_special_texts(spark):
    eight = "a b c d e f g h"
    texts = [f"{eight} {eight}", f"{eight}\n{eight}\nx", "# * $ | < >", "ünï cödé   x", "a\n\na\n \na", eight * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in quality.rule_statistics(d, ["doc_id"]).collect():
        want = plain(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want[:5]


def test_junk_is_isolated():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, 5))
    bad = rng.normal(0, 1, (200, 5)) + np.array([0, 9, 0, 9, 0])
    forest = quality.calibrate(quality.grow_forest(good[:1000]), np.concatenate((good[:1000], bad[:100])), np.arange(1100) < 1000)
    assert forest.rejects(bad[100:]).mean() > 0.95
    assert forest.rejects(good[1000:]).mean() < 0.03


def plain_length(forest, t, row):
    """Splits from the root to the leaf of one row, and what the leaf's other rows would add."""
    node, splits = 0, 0
    while forest.feature[t][node] >= 0:
        node = forest.child[t][node] + (row[forest.feature[t][node]] >= forest.cut[t][node])
        splits += 1
    return splits, forest.cut[t][node]


def test_path_lengths_and_verdicts_equal_a_plain_forest(spark, docs, labels, rows):
    """Each row walks each tree by itself; lengths, scores and kept are those of the report."""
    forest = quality.fit_forest(docs, labels)
    stats = quality.rule_statistics(docs, ["doc_id"]).toArrow().to_pylist()
    norm = 2 * (np.log(quality.SAMPLE - 1) + np.euler_gamma) - 2 * (quality.SAMPLE - 1) / quality.SAMPLE
    want = {}
    for s in stats:
        n = max(s["n_words"], 1)
        row = [s["word_chars"] / n, s["n_symbols"] / n, s["n_marks"] / n, s["n_repeat_words"] / n, s["n_dup_lines"] / n, s["n_upper"] / max(s["n_letters"], 1), s["n_adjacent"] / n, s["n_distinct"] / n**0.8]
        lengths = []
        for t in range(quality.TREES):
            splits, length = plain_length(forest, t, row)
            assert splits <= length <= splits + norm
            lengths.append(length)
        score = 2 ** (-np.mean(lengths) / norm)
        failed = s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]
        want[s["doc_id"]] = (score, not failed and not score > forest.threshold)
    for g in quality.quality_report(docs, labels).collect():
        assert abs(g.anomaly - want[g.doc_id][0]) < 1e-9 and g.kept == want[g.doc_id][1]


def test_leaves_count_the_rows_they_would_split():
    """In a tree of few rows every leaf's length is its depth, and that of an unsuccessful search among the rows left at the last level."""
    x = np.random.default_rng(2).normal(0, 1, (300, 3))
    forest = quality.grow_forest(x, trees=5, sample=64)
    for t in range(5):
        held = {}
        for row in x:
            splits, length = plain_length(forest, t, row)
            held.setdefault((splits, length), 0)
        for splits, length in held:
            rest = length - splits
            assert rest == 0 or splits == forest.depth and any(abs(rest - float(quality._expected(np.array(k)))) < 1e-9 for k in range(2, 65))


def test_tables(spark, docs, crowded, empty, labels):
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality.quality_report(docs, labels.select("doc_id", F.lit(None).cast("int").alias("quality"))).count() == docs.count()
    assert same(quality.quality_report(docs, labels), quality.quality_report(crowded, labels))
    report = quality.quality_report(docs, labels).where("kept").select("doc_id")
    assert same(report, quality.keep_good(docs, labels).select("doc_id"))
    assert quality.keep_good(crowded, labels).columns == crowded.columns


def test_all_labelled_rows_fit_the_forest(spark):
    """Spread, samples and threshold are those of 7,000 labelled rows, as one plain fit over all of them has."""
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "x"), F.lit(60)).cast("string"), F.when(F.pmod(F.xxhash64("x", "id"), 9 + F.col("id") % 40) == 0, "#").otherwise(""))
    docs = spark.range(7000).select("id", F.explode(F.sequence(F.lit(1), (30 + F.col("id") % 31).cast("int"))).alias("x")).groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.collect_list(word), " ").alias("text"))
    docs = docs.localCheckpoint()
    labels = docs.select("doc_id", F.when(F.length(F.regexp_replace("text", "[^#]", "")) > 3, 0).otherwise(1).alias("quality"))
    forest = quality.fit_forest(docs, labels)
    rows = quality.rule_statistics(docs, ["doc_id"]).join(labels, "doc_id").toArrow()
    stats = {n: rows.column(n).to_numpy() for n in (*quality.BASE, *quality.MORE)}
    good, passed = rows.column("quality").to_numpy() == 1, ~quality.base_failed(stats["n_words"], stats["n_repeat_words"])
    x = quality.features(stats)[passed]
    assert np.allclose(forest.scale, np.maximum(x[good[passed]].std(axis=0), 1e-9), rtol=1e-7)
    found = forest.threshold
    assert found == quality.calibrate(forest, x, good[passed]).threshold < 1


class Given:
    """A forest whose scores are given."""

    def score(self, x):
        return x[:, 0]


def test_threshold_over_a_table_is_that_of_all_rows(spark):
    rng = np.random.default_rng(5)
    for n, digits, share in ((1, 2, 1), (40, 1, 0.5), (3000, 3, 0.8), (3000, 9, 0.99), (5000, 2, 0.4), (30, 2, 0), (2000, 4, 0.9)):
        good = rng.random(n) < share
        score = np.round(rng.beta(8, np.where(good, 9, 6)), digits)
        rows = spark.createDataFrame(list(zip(score.tolist(), good.tolist(), strict=True)), "score double, good boolean")
        assert quality.threshold(rows) == quality.calibrate(Given(), score[:, None], good).threshold
