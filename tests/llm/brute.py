"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re


def word_set(text: str, words: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split("[ \t-\r]+", low) if x]
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
