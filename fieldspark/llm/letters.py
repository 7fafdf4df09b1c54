"""Texts as arrays of letters, for models over characters and words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of non-letters is one space, and one stands at each end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, np.uint32(SPACE))[keep]
