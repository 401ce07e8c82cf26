import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm.slack_packing import fullest, minimum_bin_slack, pack_documents, placements
from plantpulse.llm.tokens import WordIds, word_bpe_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


TEXTS = [
    "", " ", "Plain words, and it's don't we'll 3.14 x2!", "É ÜBER naïve éclair Å ﬁ İstanbul ΟΔΟΣ",
    "tab\tand\x1cseparator\x85next line space", "<|endoftext|> a<|startoftext|>b <| odd", "日本語 テキスト 12３ ①½",
    "emoji 👩‍👩‍👧 é́", "a\n\nb \x00 \x07c", "x" * 500, "'s 'S 'll''", "²³ª º ǆ ǅ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(tokenizer, text):
    encoder = WordIds(word_bpe_path())
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert encoder.encode(text) == want
    assert encoder.encode(text) == want


def test_cache_is_bounded(tokenizer):
    encoder = WordIds(word_bpe_path(), cache_words=20)
    for n in range(200):
        text = f"word{n} and {'ab' * (n % 7)}{n}"
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encoder.words) <= 20


def test_caches_are_bounded_in_bytes(tokenizer):
    rng = random.Random(7)
    encoder = WordIds(word_bpe_path())
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in range(300):
        short = ["".join(rng.choices(letters, k=9)) for _ in range(2000)]
        text = " ".join([*short, "".join(rng.choices(letters, k=20_000)), f"{n}-" * 500])
        ids = encoder.encode(text)
        if n % 100 == 0:
            assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    held = [d for name, d in vars(encoder).items() if isinstance(d, dict) and name != "letters"]
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in held)
    assert size < 110 << 20 and max(len(k) for d in held for k in d) <= 32


def test_fullest_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = dict(Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 8))))
        room = rng.randint(0, 60)
        chosen = fullest(sorted(counts, reverse=True), counts, room)
        assert all(n <= counts[length] for length, n in Counter(chosen).items())
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        assert sum(chosen) == max(sums)


def test_patterns_use_every_length_once():
    rng = random.Random(4)
    histogram = Counter(min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(3000))
    patterns = minimum_bin_slack(dict(histogram), 100)
    used = Counter()
    for chosen, times in patterns:
        assert sum(chosen) <= 100 and times > 0
        for length in chosen:
            used[length] += times
    assert used == histogram
    total = sum(length * n for length, n in histogram.items())
    assert sum(times for _, times in patterns) <= -(-total // 100) + 1
    table = placements(patterns)
    assert set(table) == set(histogram)


def check(df, rows, tokenizer, capacity):
    got = pack_documents(df, capacity=capacity, keep_ids=True).collect()
    want = Counter()
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], dtype="<u4").tobytes()
            want[i, piece, at, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    total = sum(r.length for r in got)
    assert len(ends) <= -(-total // capacity) + 2


def test_documents_are_packed_whole(documents, tokenizer, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(100 + i, " ".join(["word"] * rng.randint(0, 90))) for i in range(150)]
    check(documents(rows).repartition(5), rows, tokenizer, 64)


def test_empty_and_clashing_columns(documents):
    assert pack_documents(documents([])).count() == 0
    df = documents([(1, "a b"), (2, None)]).selectExpr("*", "1 AS task", "2 AS length", "3 AS rank")
    assert {(r.doc_id, r.length) for r in pack_documents(df).collect()} == {(1, 3), (2, 1)}


def test_a_tokenizer_of_other_rules_is_asked_for_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    from plantpulse.llm.tokens import WordIds, word_bpe_path

    own = WordIds(word_bpe_path())
    assert own.by_word
    rules = json.loads(own.tokenizer.to_str())
    rules["normalizer"]["normalizers"].pop()  # no lower-casing any more
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    text = "Some TEXT, it's 42 Ünïcode\nlines  and <|endoftext|> marks"
    cased = WordIds(str(path))
    assert not cased.by_word and cased.encode(text) != own.encode(text)
    for path, ids in ((word_bpe_path(), own), (str(path), cased)):
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert ids.encode(text) == ids._bytes(want)
