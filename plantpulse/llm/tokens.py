"""Token ids of texts, word by word with a bounded cache.

A tokenizer with the rules below drops white space and never joins across it, so the ids of
a text are the ids of its space- and newline-separated pieces in order.  Words repeat, and
looking one up costs a fraction of tokenizing it again.  A file with other rules is asked for
every text as a whole.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

# Words, and parts of words, kept per Python worker in each of two generations: about 140 MB
# when all are full.  A part serves its word in capitals and with marks, so parts are more.
CACHE_WORDS, CACHE_PARTS = 100_000, 200_000
# Characters of what is kept at most: a number of entries alone would not bound their bytes.
LONGEST = 32


# The rules for which texts are cut into words here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}


def cuts_words(rules: dict) -> bool:
    """Whether a tokenizer file has the rules for which a text's ids are those of its words."""
    marks = rules["added_tokens"]
    plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in marks)
    model = rules["model"]
    return plain and model["type"] == "BPE" and not model["dropout"] and all(
        rules[name] == rule for name, rule in RULES.items()
    )


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Printable stand-in of each byte in a byte-level vocabulary: visible Latin-1 characters
    stand for themselves, the other bytes for the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """``encode(text)``: ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_parts: int = CACHE_PARTS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = cuts_words(json.loads(self.tokenizer.to_str()))
        self.limit, self.part_limit = cache_words, cache_parts
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.split = regex.compile(SPLIT).findall

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.replace("\n", " ").split(" ")
        known = self.words
        missing, passing = set(words).difference(known), []
        if missing:
            if len(known) + len(missing) > self.limit:
                # The full generation answers until the next one is full as well.
                self.older, known = known, {}
                self.words, missing = known, set(words)
            older = self.older
            for word in missing:
                ids = older.get(word)
                known[word] = self._word(word) if ids is None else ids
            passing = [word for word in missing if len(word) > LONGEST]
        ids = b"".join(map(known.__getitem__, words))
        for word in passing:
            del known[word]
        if len(known) > self.limit:
            # One text alone overflows the cache: it leaves nothing there.
            self.words, self.older = {}, {}
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        # Below U+0300 every character is its own composed form and lower-cases alone, and
        # "<|" starts the only strings that are ids of their own.
        if word and not ((word.isascii() or max(word) < "\u0300") and "<|" not in word and word.isprintable()):
            return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return self._part(low)
        if low[-1:] in (".", ",") and low[:-1].isalpha():
            return self._part(low[:-1]) + self._part(low[-1])
        return b"".join(map(self._part, self.split(low)))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.older_parts.get(part)
            if ids is None:
                spelt = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                packed = self.packed
                ids = b"".join([packed[t.id] for t in self.model.tokenize(spelt)])
            if len(part) <= LONGEST:
                if len(self.parts) >= self.part_limit:
                    self.older_parts, self.parts = self.parts, {}
                self.parts[part] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The encoder of this Python worker: its cache serves all tasks the worker runs.

    ``word_ids.cache_clear()`` gives its memory back.
    """
    return WordIds(path)
