import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import alignment
from tallyforge.llm import words as W
from tests.llm.conftest import same


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers(alignment.BYTE_LEVEL, alignment.PIECES)


def plain_groups(both, text):
    """Groups of the whole text encoded at once, cut at the common ends; None where some side does not spell it."""
    one, first, two, second = both
    if not text:
        return None
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    if b"".join(first[k] for k in a) != (" " + text).encode() or b"".join(second[k] for k in b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(first[k]) for k in a]), np.cumsum([len(second[k]) for k in b])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for k, end in zip(ids, ends, strict=True):
            groups[np.searchsorted(cuts, end)][side].append(k)
    return groups


def plain_report(both, rows):
    found = [plain_groups(both, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in found]
    counts = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), g, x in zip(rows, found, links, strict=True):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        best = sum(n for p, n in x.items() if counts[p] == top[p[0]])
        out.append((doc, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(x.values()), best, sum(n * counts[p] for p, n in x.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(map(str, out))


SAMPLES = ["plain words here", " led by a space", "two  spaces   three", "tab\tand\nlines\r\n \n x", "trailing  ", "one more ", "a b ", " ", "  ", "it's we'll", "café naïve über", "中文 文字 　 x", "a  b   c  d ’ e", "▁ low line", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41>", "\U0001f600 \U0001f468‍\U0001f469 x", "a" * 3000 + " " + "1234567890" * 30, "\x00 \x01 \x1c \x7f y", "don’t stop", "ﬁ ́ x", None, ""]


def test_segments_spell_the_text():
    data, offsets = W.text_bytes(pa.array(SAMPLES))
    starts = alignment.segment_starts(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts[:3], starts[1:4], strict=True)] == [b"plain", b" words", b" here"]
    assert set(offsets[:-1][np.diff(offsets) > 0]) <= set(starts)


def test_boundaries_are_verified():
    alignment.verify_boundaries([b" a", b"  ", b"\n\n", b"b\n"])
    with pytest.raises(ValueError, match="crosses"):
        alignment.verify_boundaries([b" a", b"of the"])


def test_report(spark, both, rows):
    rng = random.Random(6)
    data = list(enumerate(SAMPLES)) + [(100 + i, " ".join(rng.choice(SAMPLES[:4]) for _ in range(rng.randrange(5)))) for i in range(40)]
    data += [(r[0], r[1]) for r in rows if len(r[1] or "") < 10**5] + [(None, "plain words here"), (3, "plain words here"), (3, "plain words here")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = plain_report(both, data)
    for size, shared in ((alignment.BLOCK_BYTES, alignment.BROADCAST_PAIRS), (200, 0)):
        got = alignment.align_documents(frame, block_bytes=size, broadcast_pairs=shared).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_large_groups_and_long_texts(spark, both, monkeypatch):
    """Groups counted by their distinct ids, segments encoded in small lots, texts hashed in steps."""
    monkeypatch.setattr(alignment, "FEW", 0)
    monkeypatch.setattr(alignment, "STEP", 3)
    monkeypatch.setattr(alignment, "ENCODED_BYTES", 20)
    monkeypatch.setattr(alignment, "SHORT", 2)
    for text in [*SAMPLES, "naïve 中文 cafés and 1234567 x" * 20]:
        for k, data in enumerate([text, f"{text} and {text}"] if text else [text]):
            coded = alignment.code_documents(spark.createDataFrame([(k, data)], "doc_id long, text string")).toArrow() if text in SAMPLES[:3] else None
            segments = [] if not data else _bodies(data)
            tokens = pa.array(alignment.encode_segments(segments, both) if segments else [], pa.binary())
            known, groups = alignment.Alignments(tokens), plain_groups(both, data)
            assert coded is None or coded.num_rows == 1
            assert (groups is not None) == (bool(segments) and bool(known.good.all()))
            if groups:
                got = b";".join(known.text[i:j].tobytes() for i, j in zip(known.start, known.end, strict=True)).decode()
                assert got == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
                links = Counter((x, y) for a, b in groups for x in a for y in b)
                made = Counter()
                for p, n in zip(known.pairs[known.local].tolist(), known.times.tolist(), strict=True):
                    made[p >> alignment.LOW_BITS, p & (1 << alignment.LOW_BITS) - 1] += n
                assert made == links and known.n_links.sum() == sum(links.values())


def _bodies(text):
    data, offsets = W.text_bytes(pa.array([text]))
    starts = [*alignment.segment_starts(data, offsets).tolist(), len(data)]
    parts = [data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return [parts[0], *(p[1:] for p in parts[1:])]


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("ab \t\n 　 é中'.1<\x1f\u0085"), min_size=1, max_size=40))
def test_segments_are_tokenised_as_in_the_whole(both, text):
    """Segments one by one give the tokens of the whole text, for both tokenizers. (A text with U+2581 is never spelt by B.)"""
    one, _, two, _ = both
    data, offsets = W.text_bytes(pa.array([text]))
    starts = [*alignment.segment_starts(data, offsets).tolist(), len(data)]
    parts = [data[a:b].tobytes().decode() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    bodies = [parts[0], *(p[1:] for p in parts[1:])]
    assert [k for p in bodies for k in one.encode(" " + p, add_special_tokens=False).ids] == one.encode(" " + text, add_special_tokens=False).ids
    assert [k for p in bodies for k in two.encode(p) or [two.piece_to_id("▁")]] == two.encode(text)


def test_invalid_bytes(spark):
    frame = spark.sql("select 1L doc_id, cast(x'61ff2062' as string) text union all select 2L, 'a b'")
    got = {r.doc_id: r for r in alignment.align_documents(frame).collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == "" and got[2].n_a == 2


def test_tables(docs, crowded, empty):
    assert alignment.align_documents(empty).count() == 0
    assert same(alignment.align_documents(docs), alignment.align_documents(crowded))
