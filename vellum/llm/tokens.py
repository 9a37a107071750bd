"""Word-level caching around a tokenizer of the tokenizers library.

encode_bytes() returns exactly the ids of Tokenizer.encode(text, add_special_tokens=False) as little-endian unsigned
32-bit integers.  Texts of Latin-1 characters are split with the tokenizer's own pre-token pattern and each distinct
pre-token meets the BPE model once per worker; every other text, and each text that holds an added token, goes through
the library's whole pipeline.
"""

from __future__ import annotations

import re

import numpy as np

CACHE_ENTRIES = 500_000
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\t-\\r {_L}{_N}]+")
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])


class _Memo(dict):
    """Computes what it lacks. When full it becomes the older of two generations, from which words in use return; so its size is bounded."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    _open: dict[str, "Encoder"] = {}

    @classmethod
    def get(cls, path: str) -> "Encoder":
        """One encoder for each file and Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        pre = spec["pre_tokenizer"]["pretokenizers"] if spec.get("pre_tokenizer") and "pretokenizers" in spec["pre_tokenizer"] else []
        split = pre[0].get("pattern", {}).get("Regex") if len(pre) == 2 else None
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: The fast way stands for exactly this pipeline; any other tokenizer takes the library's whole one.
        self.fast = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and norm == ["NFC", "Replace", "Lowercase"] and pre[1]["type"] == "ByteLevel"
        self.model = self.full.model
        self.letters = _byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.full.get_vocab_size() + 1)]
        self.words = _Memo(self._word)

    def _word(self, word: str) -> bytes:
        pieces = _PIECES.findall(word)
        if pieces and pieces[0] != word:
            return b"".join([self.words[p] for p in pieces])
        if not word.isascii() or not word.isalpha():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(word)])

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            plain = self.fast and not text.encode("latin-1").translate(None, _PLAIN) and not any(a in text for a in self.added)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))
