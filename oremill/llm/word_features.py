"""Hashed features of words that the text classifiers share."""

from __future__ import annotations

import numpy as np

from .batches import BYTE, MULT, Words, spread


#: N-grams whose bytes are gathered at once.
PIECE = 1 << 18


def gathered(w: Words, which: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` bytes of the words ``which``, from byte ``offset`` of each."""
    at = w.start[which] + offset
    h = np.zeros(len(which), np.uint64)
    for i in range(length):
        h += BYTE[w.data[at + i]] * MULT[100 + i]
    return spread(h + MULT[200 + length])


def affixes_and_ngrams(w: Words, which: np.ndarray, grams: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(word of ``which``, hash) of the words' prefixes and suffixes of 2 to 4 bytes, all byte n-grams and whole forms."""
    n = w.length[which]
    word, out = [np.arange(len(which))], [spread(w.hash[which] + MULT[301])]
    for size in (2, 3, 4):
        k = np.flatnonzero(n >= size)
        word += [k, k]
        out += [gathered(w, which[k], np.zeros(len(k), np.int64), size) + MULT[310], gathered(w, which[k], n[k] - size, size) + MULT[311]]
    k = np.flatnonzero(n >= grams)
    per = n[k] - grams + 1
    end = np.cumsum(per)
    for lo in range(0, int(per.sum()), PIECE):
        i = np.arange(lo, min(lo + PIECE, int(end[-1])))
        of = np.searchsorted(end, i, side="right")
        word.append(k[of])
        out.append(gathered(w, which[k[of]], i - (end - per)[of], grams) + MULT[312])
    return np.concatenate(word), np.concatenate(out)


#: Classes of bytes for a word's shape; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 1, 2, 3, 4


def shapes(w: Words) -> np.ndarray:
    """Hash of each word's classes of bytes, runs of one class taken as one."""
    if not len(w):
        return np.zeros(0, np.uint64)
    _, which, of = np.unique(w.hash, return_index=True, return_inverse=True)
    length = w.length[which]
    word = np.repeat(np.arange(len(which)), length)
    at = np.repeat(w.start[which] - np.cumsum(length) + length, length) + np.arange(len(word))
    c = SHAPE[w.data[at]]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (word[1:] != word[:-1])
    c, word = c[new], word[new]
    begin = np.searchsorted(word, np.arange(len(which)))
    k = np.arange(len(c)) - begin[word]
    return spread(np.add.reduceat(BYTE[c] * MULT[400 + (k & 1023)], begin))[of]
