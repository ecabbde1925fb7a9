"""Words of texts, for the classifiers: each different word of a chunk is worked on once.

A classifier's word is a run of letters, digits and bytes above ASCII; the texts are expected in lower case. ``in_words``
tells letters and digits of all scripts from other characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from .bpe import distinct_slices

_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(letters and digits, combining marks) among all code points, as Python's Unicode tables have them."""
    kinds = np.frombuffer("".join([unicodedata.category(chr(c))[0] for c in range(0x110000)]).encode(), np.uint8)
    return (kinds == ord("L")) | (kinds == ord("N")), kinds == ord("M")


def in_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters and digits of any script, or to marks that follow one in the same text."""
    inside = _WORD[data]
    at = np.flatnonzero(data >= 0x80)
    if not len(at):
        return inside
    inside[at] = False
    at = at[data[at] >= 0xC0]
    lead = data[at].astype(np.uint32)
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = lead & (0x7F >> size).astype(np.uint32)
    padded = np.append(data, np.zeros(3, np.uint8))
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << np.uint32(6) | padded[at[more] + k] & np.uint8(0x3F)
    code = np.minimum(code, 0x10FFFF)
    letter, mark = _letters()

    def places(chosen: np.ndarray) -> np.ndarray:
        found = np.repeat(at[chosen], size[chosen])
        found += np.arange(len(found)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
        return found[found < len(data)]

    inside[places(letter[code])] = True
    marks = places(mark[code])
    if len(marks):
        last = np.arange(len(data))
        last[marks] = -1
        last = np.maximum.accumulate(last)[marks]  # the byte before a run of marks
        first = offsets[np.searchsorted(offsets, marks, "right") - 1]
        inside[marks] = (last >= first) & inside[last]
    return inside


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, number of the word at each place, places before each text)."""
    if not len(data):
        return [], np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    change = np.ones(len(data), bool)
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    first, kind = distinct_slices(data, starts)
    is_word = inside[starts]
    wanted = is_word[first]
    number = np.cumsum(wanted) - 1
    raw, stops = data.tobytes(), np.append(starts[1:], len(data))
    words = [raw[a:b] for a, b in zip(starts[first[wanted]].tolist(), stops[first[wanted]].tolist())]
    places = np.concatenate([[0], np.cumsum(is_word)])
    return words, number[kind[is_word]], places[np.searchsorted(starts, offsets)]


def code_points(words: list[bytes]) -> np.ndarray:
    """Code points of the words with a line feed before, between and after them; broken UTF-8 becomes U+FFFD."""
    text = b"\n" + b"\n".join(words) + b"\n"
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def sum_by(values: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between neighbouring ``splits``; empty stretches give 0."""
    total = np.zeros((len(splits) - 1, *values.shape[1:]), values.dtype)
    full = splits[1:] > splits[:-1]
    if full.any():
        total[full] = np.add.reduceat(values, splits[:-1][full], axis=0)
    return total
