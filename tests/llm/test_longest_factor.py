import random
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm.longest_factor import Grams, factors, remove_repeats, segments, truncated_ranks


def plain(rows, length, keep_first=False):
    """Per row (bytes, removed, spans, kept), by counting every window."""
    texts = [(t or "").encode() for _, t in rows]
    places = {}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    for n in order:
        for p in range(len(texts[n]) - length + 1):
            places.setdefault(texts[n][p:p + length], []).append((n, p))
    out = []
    for n, data in enumerate(texts):
        gone = np.zeros(len(data) + 1, dtype=np.int64)
        for p in range(len(data) - length + 1):
            found = places[data[p:p + length]]
            if len(found) > 1 and not (keep_first and found[0] == (n, p)):
                gone[p] += 1
                gone[p + length] -= 1
        covered = np.cumsum(gone)[:len(data)] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        spans = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        out.append((rows[n][0], len(data), int(covered.sum()), spans, kept))
    return Counter(out)


def got(df, **options):
    return Counter(
        (r["doc_id"], *r["repeats"][:3], bytes(r["repeats"][3])) for r in remove_repeats(df, **options).collect()
    )


def corpus(rng, n):
    letters = "abcdé "
    shared = ["".join(rng.choices(letters, k=rng.randint(15, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(1, 60)))
            if rng.random() < 0.2:
                at = rng.randrange(len(part))
                part = part[:at] + "Z" + part[at + 1:]
            parts.append(part)
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 2}, {"keep_first": True}, {"keep_first": True, "crowd": 1}])
def test_equals_counting_every_window(documents, options):
    rows = corpus(random.Random(11), 90)
    rows += [(500, "xy" * 200), (501, "y" * 300), (502, rows[3][1] + "y" * 50)]
    assert got(documents(rows), length=20, gram=6, **options) == plain(rows, 20, options.get("keep_first", False))


def test_production_lengths(documents, odd_rows):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=70))
    rows = list(odd_rows) + [
        (50 + i, " ".join(rng.choices(words, k=40)) + passage + " ".join(rng.choices(words, k=30))) for i in range(20)
    ]
    assert got(documents(rows)) == plain(rows, 200)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(13)
    raw = bytes(rng.choices(b"abc", k=4000))
    data = np.frombuffer(raw + raw[1000:1500] + raw, dtype=np.uint8)
    first, last, anchor, h = segments(data, np.array([len(data)]), Grams(8, len(data)), 30)
    assert first[0] == 0 and last[-1] == len(data) - 30 and (first[1:] == last[:-1] + 1).all()
    owner = np.repeat(h, last - first + 1)
    by_window = {}
    for p in range(len(data) - 29):
        assert by_window.setdefault(data[p:p + 30].tobytes(), owner[p]) == owner[p]


def test_ranks_and_factors():
    rng = random.Random(14)
    raw = np.array(rng.choices(b"ab", k=400), dtype=np.uint8)
    for length in (5, 8, 13, 40):
        text = raw.tobytes() + bytes(length)
        cut = [text[i:i + length] for i in range(len(raw))]
        rank = truncated_ranks(raw, length)
        assert all((rank[i] < rank[j]) == (cut[i] < cut[j]) for i in range(0, 400, 7) for j in range(0, 400, 3)
                   if i + length <= 400 and j + length <= 400)
        windows = np.arange(len(raw) - length + 1)
        earlier, later = factors(raw, windows, length)
        for p in windows:
            assert earlier[p] == (cut[p] in cut[:p]) and later[p] == (cut[p] in cut[p + 1:len(windows)])


def test_empty_and_clashing_columns(documents):
    assert remove_repeats(documents([])).count() == 0
    df = documents([(1, "a" * 250), (2, "b" * 10)]).selectExpr("*", "1 AS h", "2 AS start", "3 AS text_key", "4 AS starts")
    assert {(r["doc_id"], r["repeats"]["n_removed"]) for r in remove_repeats(df).collect()} == {(1, 250), (2, 0)}
