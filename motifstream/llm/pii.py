"""Personal data: fixed patterns for four kinds, and bootstrapped contextual extraction of what they miss.

Base spans come from fixed patterns. Besides them, tokens with the shape of a key (``KEY``: long, letters and digits mixed)
are seeds of a fifth kind, ``secret``; such a token alone is no span, unless it has the form of a known issuer.

The words around a seed are its lexical patterns: L (two words before), P (one word before), R (two words after). A
pattern's anchor is its word next to the seed and must hold a letter. The bootstrap goes in readings of all texts:

1. Patterns around at least ``MIN_SUPPORT`` different known entities of one kind, and not too many of others, are
   candidates. All their places in the corpus are counted, whatever stands there. A pattern of which fewer than ``MIN_CONFIDENCE`` of the places hold
   anything but a plain word can never be trusted, and is left out.
2. What stands in the places of the others, plain words apart, makes a graph of patterns and entities that Spark scores
   in ``ROUNDS`` rounds. A mention speaks for a pattern and a kind by its weight: 1 for a seed of the kind, the
   entity's chance for others. Plain words, seeds of other kinds and what does not fit the kind (a 16-digit number
   that fails Luhn is no card) speak against it; the rest is open. Confidence is the share of the weight among what
   speaks for and against; the weight must be ``MIN_SHARE`` of all places too. An entity's chance is that of at least
   one anchor being right; towards a pattern it is counted without that pattern's own anchor, so no pattern supports itself.
3. Entities of sufficient chance are known from then on, and the next reading starts from their patterns too. There are
   ``READINGS`` at most, fewer if nothing new is found.

A span is added where something stands in a trusted pattern's place or a known entity stands anywhere, outside base spans,
with the kind of the most confident pattern.

Words are what white space, "=" and a colon inside a token part, without punctuation at their ends, in lower case (ASCII), all
digits alike; words of punctuation alone are passed over. A mention is a word, or the digit groups that belong together.

Texts stay where they are. What moves is counts of candidate patterns, and mentions in possible places. Frequent patterns
and entities are aggregated before they are shuffled; joins are such that adaptive execution splits hot keys.

Results for odd input: a null text is an empty text without spans; positions count code points; repeated rows get equal
spans; overlapping kinds are all reported; an empty table gives an empty table; columns of the input with the names of
result columns are replaced. Time is linear in a text's length, and its words are found in stretches of ``SEGMENT`` bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import give_back, map_chunks, saved, small_batches, text_chunks
from .bpe import range_keys

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only context (or a known issuer's form) finds.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
# The base patterns. Possessive repeats match the same spans in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Stands in every match of the above; begins with a fixed character, which is looked for faster.
_IP_REST = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGES = "\"'`()[]{}<>,;:.!?#$%&*|="
# Forms of keys that name their issuer.
_ISSUED = re.compile(rb"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}")
#: Shape of a seed of kind secret: so many letters and digits without anything between them, of each so many at least.
KEY_LENGTH, KEY_EACH = 16, 4
_KEY = re.compile(rb"[0-9A-Za-z]+")

READINGS = 2
ROUNDS = 2
MIN_SUPPORT = 4
MIN_CONFIDENCE = 0.8
#: Of a trusted pattern's places, known entities hold so many at least.
MIN_SHARE = 0.25
#: Bytes of text whose words are found at once.
SEGMENT = 1 << 20
#: Bits of the sieves that tell the readings what to look for: 16 for each key, 2**27 (16 MiB) at most. What shares a
#: bit is sorted out by exact joins.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

#: Digit groups joined by single spaces, brackets, dots and dashes; an IBAN's groups. Linear as above.
_GROUP = r"[+(\[]{0,3}[0-9][0-9()\[\].-]*+(?![^\s\"'>},;:=|!?])"
_RUN = re.compile(rf"(?<![^\s\"'<{{,;:=|])(?:[A-Z]{{2}}[0-9]{{2}}(?:[  ][0-9A-Z]{{4}}){{2,7}}(?:[  ][0-9A-Z]{{1,4}})?(?![0-9A-Za-z])|{_GROUP}(?:[  ]{_GROUP})++)")


def _table(chosen) -> np.ndarray:
    return np.array([bool(chosen(chr(b)) if b < 128 else chosen(None)) for b in range(256)])


_WHITE = _table(lambda c: c is not None and c in " \t\n\v\f\r=")
_INNER = _table(lambda c: c is None or c not in _EDGES)
_ASCII_LETTER = _table(lambda c: c is not None and c.isalpha())
_LETTER = _table(lambda c: c is None or c.isalpha())
_DIGIT = _table(lambda c: c is not None and c.isdigit())
#: What a plain word cannot hold.
_ODD = _table(lambda c: c is not None and not c.isalpha() and c not in "-'")
#: Bits of a byte's class, and the classes of all bytes.
WHITE, INNER, ODD, LETTER, DIGIT, ASCII_LETTER = (np.uint8(1 << n) for n in range(6))
_CLASS = sum(np.where(t, b, np.uint8(0)) for t, b in ((_WHITE, WHITE), (_INNER, INNER), (_ODD, ODD), (_LETTER, LETTER), (_DIGIT, DIGIT), (_ASCII_LETTER, ASCII_LETTER))).tobytes()
_LOWER = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256))
_ALIKE = bytes(ord("0") if _DIGIT[b] else _LOWER[b] for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words up to so many bytes are hashed eight bytes at a time, all at once.
LONG = 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, looked for from each @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, end := domain.end()))
            at = text.find("@", end)
        else:
            end = max(end, at)  # what stands before this @ cannot belong to a later one
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _IP_REST.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for a, b in [m.span() for m in _CARD.finditer(text)]:
        if b - a >= 16:
            number = text[a:b].replace(" ", "").replace("-", "")
            if 16 <= len(number) <= 19 and luhn(number):
                out.append(("card", a, b))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Words:
    """Words of the texts of a chunk, in order; a text's words are ``splits[d]`` to ``splits[d + 1]``."""

    start: np.ndarray  # byte in the chunk
    stop: np.ndarray
    word: np.ndarray  # hash of the word, digits alike
    exact: np.ndarray  # hash with its digits
    odd: np.ndarray  # not a plain word
    letter: np.ndarray
    digit: np.ndarray
    splits: np.ndarray


def _separators(part: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = (classes & WHITE) != 0
    colon = np.flatnonzero(part == ord(":"))
    colon = colon[(colon > 0) & (colon < len(part) - 1)]
    out[colon[((classes[colon - 1] & ASCII_LETTER) != 0) & (part[colon + 1] != ord("/"))]] = True
    return out


def word_keys(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever it stands; words are in order and don't overlap."""
    size = stop - start
    eights = np.frombuffer(raw + bytes(16 - len(raw) % 8), "<u8")
    key = size.astype(np.uint64)

    def mix(key: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The key with the next eight bytes, of which ``left`` belong to the word."""
        eight, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        key = key ^ ((eights[eight] >> shift | eights[eight + 1] << (np.uint64(63) - shift) << np.uint64(1)) & _MASKS[np.minimum(left, 8)])
        key *= _MIX
        key ^= key >> np.uint64(32)
        key *= _MIX
        key ^= key >> np.uint64(29)
        return key

    key = mix(key, start, size)
    more = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(more):
        key[more] = mix(key[more], start[more] + done, size[more] - done)
        done += 8
        more = more[size[more] > done]
    long = np.flatnonzero(size > LONG)
    if len(long):
        key[long] = range_keys(np.frombuffer(raw, np.uint8), start[long], stop[long])
    return key


def _stretches(data: np.ndarray, offsets: np.ndarray, size: int):
    """Cuts of the chunk into stretches of about ``size`` bytes that no word crosses."""
    start, n = 0, len(data)
    while start < n:
        stop = min(n, start + size)
        while stop < n:
            ahead = np.flatnonzero(_WHITE[data[stop : stop + size]])
            end = offsets[np.searchsorted(offsets, stop)]  # the end of this text is a cut too
            found = stop + int(ahead[0]) if len(ahead) else min(n, stop + size)
            stop = min(found, int(end))
            if len(ahead) or stop == end:
                break
        yield start, stop
        start = stop


def words_of(data: np.ndarray, offsets: np.ndarray, size: int | None = None) -> Words:
    parts = []
    for low, high in _stretches(data, offsets, size or SEGMENT):
        part = data[low:high]
        raw = part.tobytes()
        classes = np.frombuffer(raw.translate(_CLASS) + b"\0", np.uint8)
        inside = ~_separators(part, classes[:-1])
        edge = np.zeros(len(part) + 1, bool)  # where a text starts
        edge[(offsets[(offsets >= low) & (offsets <= high)] - low)] = True
        edge[0] = edge[-1] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Without punctuation at the ends: few words have any.
        inner = (classes & INNER) != 0
        inner[-1] = True  # where a search ends that finds none
        place = np.flatnonzero(inner)
        bare = np.flatnonzero(~inner[start])
        start[bare] = place[np.searchsorted(place, start[bare])]
        bare = np.flatnonzero(~inner[stop - 1])
        before = np.searchsorted(place, stop[bare])
        stop[bare] = np.where(before > 0, place[before - 1] + 1, 0)
        some = start < stop
        start, stop = start[some], stop[some]
        met = np.bitwise_or.reduceat(classes, np.stack([start, stop], 1).ravel())[::2] if len(start) else classes[:0]
        odd, letter, digit = ((met & c) != 0 for c in (ODD, LETTER, DIGIT))
        # Without digits a word is the same word exactly.
        word = word_keys(raw.translate(_ALIKE), start, stop)
        exact, number = word.copy(), np.flatnonzero(digit)
        if len(number):
            exact[number] = word_keys(raw.translate(_LOWER), start[number], stop[number])
        parts.append((start + low, stop + low, word, exact, odd, letter, digit))
    if not parts:
        none, no = np.empty(0, np.int64), np.empty(0, bool)
        return Words(none, none, none.astype(np.uint64), none.astype(np.uint64), no, no, no, np.zeros(len(offsets), np.int64))
    columns = [np.concatenate(x) for x in zip(*parts)]
    return Words(*columns, np.searchsorted(columns[0], offsets))


@dataclass
class Places:
    """Patterns of every word as a place, 0 where there is none, and the anchors they belong to."""

    left2: np.ndarray
    left1: np.ndarray
    right2: np.ndarray
    anchor_left: np.ndarray
    anchor_right: np.ndarray

    def of(self, i: int, j: int) -> list[tuple[int, int]]:
        """(pattern, anchor) of a mention of the words i to j, as signed numbers."""
        found = [(self.left2[i], self.anchor_left[i]), (self.left1[i], self.anchor_left[i]), (self.right2[j], self.anchor_right[j])]
        return [(int(p.view(np.int64)), int(a.view(np.int64))) for p, a in found if p]


def places_of(words: Words) -> Places:
    n = len(words.word)

    def neighbour(values: np.ndarray, by: int, missing) -> np.ndarray:
        """The value ``by`` words on, in the same text."""
        out = np.full(n, missing, values.dtype)
        if n > abs(by):
            here, there = (slice(0, n - by), slice(by, n)) if by > 0 else (slice(-by, n), slice(0, n + by))
            out[here] = values[there]
            for k in range(abs(by)):  # the last words of each text, or the first ones
                ends = words.splits[1:] - 1 - k if by > 0 else words.splits[:-1] + k
                out[ends[(ends >= 0) & (ends < n)]] = missing
        return out

    def mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
        key = np.full(n, kind, np.uint64)
        for part in parts:
            key = (key ^ part) * _MIX
            key ^= key >> np.uint64(29)
        return key

    end = np.uint64(1)  # stands for a text's end
    b1, b2, a1, a2 = (neighbour(words.word, by, end) for by in (-1, -2, 1, 2))
    left, right = neighbour(words.letter, -1, False), neighbour(words.letter, 1, False)
    some = lambda valid, key: np.where(valid, np.maximum(key, np.uint64(1)), np.uint64(0))
    return Places(some(left, mixed(2, b2, b1)), some(left, mixed(3, b1)), some(right, mixed(4, a1, a2)), mixed(5, b1), mixed(6, a1))


def entity(words: Words, i: int, j: int) -> int:
    """A number for the words i to j as they stand, in lower case."""
    key = 7
    for k in range(i, j + 1):
        key = ((key ^ int(words.exact[k])) * int(_MIX)) & (2**64 - 1)
        key ^= key >> 31
    return key - 2**64 if key >= 2**63 else key


def is_key(core: bytes) -> bool:
    """Whether a word has the shape of a seed of kind secret."""
    if len(core) < KEY_LENGTH or not _KEY.fullmatch(core):
        return False
    digits = sum(48 <= c <= 57 for c in core)
    return digits >= KEY_EACH and len(core) - digits >= KEY_EACH


def fits(kind: str, surface: str) -> bool:
    """Whether something other than a plain word can be of a kind."""
    if kind in ("email", SECRET):
        return True
    if not any("0" <= c <= "9" for c in surface):
        return False
    if kind == "ip" and (m := _IP.fullmatch(surface)):
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
    if kind == "card":  # shorter ones and other separators than the base pattern has, but no number that fails Luhn
        number = "".join(c for c in surface if "0" <= c <= "9")
        return 12 <= len(number) <= 19 and luhn(number)
    return True


def runs(text: str) -> list[tuple[int, int]]:
    """Digit groups that belong together, with a bracket around the first ones."""
    out = []
    for m in _RUN.finditer(text):
        one = m.group().rstrip(".-([")
        one = one if "(" in one else one.rstrip(")")
        start = m.start()
        while one[:1] in ("(", "[") and ")]"["([".index(one[0])] not in one:
            one, start = one[1:], start + 1
        out.append((start, start + len(one)))
    return out


class _Text:
    """One text of a chunk: code points against bytes and words."""

    def __init__(self, data: np.ndarray, low: int, high: int, words: Words, first: int, last: int):
        raw = data[low:high]
        self.text = raw.tobytes().decode("utf-8", "replace")
        self.lead = np.flatnonzero((raw & 0xC0) != 0x80) if len(self.text) != len(raw) else None
        self.low, self.size = low, len(raw)
        self.starts, self.stops, self.first = words.start[first:last], words.stop[first:last], first

    def point(self, byte: int) -> int:
        return byte - self.low if self.lead is None else int(np.searchsorted(self.lead, byte - self.low))

    def byte(self, point: int) -> int:
        return self.low + (point if self.lead is None else int(self.lead[point]) if point < len(self.lead) else self.size)

    def words(self, start: int, stop: int) -> tuple[int, int]:
        """The first and last word that a span of code points touches; the last is smaller if there is none."""
        i = int(np.searchsorted(self.stops, self.byte(start), "right"))
        j = int(np.searchsorted(self.starts, self.byte(stop), "left")) - 1
        return self.first + i, self.first + j


_LINKS = pa.list_(pa.struct([("pattern", pa.int64()), ("anchor", pa.int64())]))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_SEED = pa.struct([*_SPAN, ("sure", pa.bool_()), ("entity", pa.int64()), ("links", _LINKS)])
_MENTION = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("entity", pa.int64()), ("head", pa.int64()), ("key", pa.bool_()), ("fits", pa.int32()), ("links", _LINKS)])
LINKS = "array<struct<pattern:bigint,anchor:bigint>>"
SCHEMA = f"base array<struct<kind:string,start:int,stop:int>>, seeds array<struct<kind:string,start:int,stop:int,sure:boolean,entity:bigint,links:{LINKS}>>"
MENTIONS = f"mentions array<struct<start:int,stop:int,entity:bigint,head:bigint,key:boolean,fits:int,links:{LINKS}>>"


def _links(found: list[tuple[int, int]]) -> list[dict]:
    return [{"pattern": p, "anchor": a} for p, a in found]


def extract(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, base (spans of the fixed patterns) and seeds (base spans and keys, with their entities and patterns)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "base", "seeds")]

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        words = words_of(data, offsets)
        places, raw, cuts, splits = places_of(words), data.tobytes(), offsets.tolist(), words.splits.tolist()
        long = np.flatnonzero((words.stop - words.start >= KEY_LENGTH) & words.digit)
        keys: dict[int, list[tuple[int, bool]]] = {}
        for i in long.tolist():
            core = raw[words.start[i] : words.stop[i]]
            sure = _ISSUED.fullmatch(core) is not None
            if sure or is_key(core):
                keys.setdefault(int(np.searchsorted(offsets, words.start[i], "right")) - 1, []).append((i, sure))
        base, seeds = [], []
        for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
            spans = base_spans(raw[a:b].decode("utf-8", "replace"))
            base.append([dict(zip(("kind", "start", "stop"), s)) for s in spans])
            found = []
            if spans or d in keys:
                one = _Text(data, a, b, words, splits[d], splits[d + 1])
                for kind, start, stop in spans:
                    i, j = one.words(start, stop)
                    if j >= i:
                        found.append((kind, start, stop, True, entity(words, i, j), _links(places.of(i, j))))
                for i, sure in keys.get(d, ()):
                    start, stop = one.point(words.start[i]), one.point(words.stop[i])
                    if not any(s < stop and start < e for _, s, e in spans):
                        found.append((SECRET, start, stop, sure, entity(words, i, i), _links(places.of(i, i))))
            seeds.append([dict(zip(("kind", "start", "stop", "sure", "entity", "links"), x)) for x in found])
        return [pa.array(base, pa.list_(_SPAN)), pa.array(seeds, pa.list_(_SEED))]

    return map_chunks(docs, text, kernel, SCHEMA, keep)


class Sieve:
    """Which 64-bit keys may be in a set: one bit for each of its keys, in an array of bounded size."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
        position = keys.select((F.col(column).bitwiseAND(F.lit(self.bits - 1)) + 1).alias("p"))
        maps = position.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        self.packed = np.zeros(max(self.bits // 8, 4096), np.uint8)
        for r in maps.collect() if n else ():  # bits / 8 bytes in all
            at = (r["b"] - 1) * 4096  # bucket 1 holds the numbers 1 to 32768
            self.packed[at : at + 4096] |= np.frombuffer(r["m"], np.uint8)
        self.empty = n == 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(keys), bool)
        at = (keys & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def count_places(docs: DataFrame, text: str, candidates: Sieve) -> DataFrame:
    """(pattern, places, odd) of the patterns that the sieve lets through: their places in all texts, and how many of
    these hold anything but a plain word. Counted in each task, in bounded memory, before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        held: dict[int, list[int]] = {}

        def out():
            rows = [(k, n, m) for k, (n, m) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["pattern", "places", "odd"])

        sieve = shared.value
        try:
            for batch in batches:
                for _, _, data, offsets in text_chunks(batch.column(0)):
                    words = words_of(data, offsets)
                    places = places_of(words)
                    for keys in (places.left2, places.left1, places.right2):
                        hit = np.flatnonzero((keys != 0) & sieve(keys))
                        found, at = np.unique(keys[hit], return_inverse=True)
                        many, odd = np.bincount(at, minlength=len(found)), np.bincount(at, words.odd[hit], len(found))
                        for k, n, m in zip(found.view(np.int64).tolist(), many.tolist(), odd.tolist()):
                            both = held.setdefault(k, [0, 0])
                            both[0] += n
                            both[1] += int(m)
                    if len(held) > 200_000:
                        yield out()
            yield out()
        finally:
            give_back()

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "pattern bigint, places bigint, odd bigint")
    return counted.groupBy("pattern").agg(F.sum("places").alias("places"), F.sum("odd").alias("odd"))


def mentions(docs: DataFrame, text: str, key: str, patterns: Sieve, heads: Sieve) -> DataFrame:
    """``key`` and (start, stop, entity, head, key, fits, links), a row for each mention: what stands outside base
    spans in the place of a pattern, or begins with a head, that the sieves let through; plain words apart.

    head: the first word as it stands; key: it is a seed of kind secret; fits: a bit for each of ALL_KINDS.
    """
    shared = docs.sparkSession.sparkContext.broadcast((patterns, heads))

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        sieve, first_words = shared.value
        words = words_of(data, offsets)
        places, raw, cuts, splits = places_of(words), data.tobytes(), offsets.tolist(), words.splits.tolist()
        hit = first_words(words.exact)
        for keys in (places.left2, places.left1, places.right2):
            hit |= (keys != 0) & sieve(keys)
        hits = np.flatnonzero(hit & words.odd)
        bounds = np.searchsorted(hits, words.splits).tolist()
        out = []
        for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
            found: dict[tuple[int, int], dict] = {}
            if bounds[d + 1] > bounds[d]:
                one = _Text(data, a, b, words, splits[d], splits[d + 1])
                busy = base_spans(one.text)
                groups = runs(one.text)
                group_starts = [g[0] for g in groups]
                taken = sorted((s, e) for _, s, e in busy)
                reach, longest = [], 0  # the furthest end among the base spans up to each
                for s, e in taken:
                    longest = max(longest, e)
                    reach.append(longest)
                taken_starts = [s for s, _ in taken]
                for i in hits[bounds[d] : bounds[d + 1]].tolist():
                    start, stop = one.point(words.start[i]), one.point(words.stop[i])
                    g = bisect_right(group_starts, start) - 1
                    if g >= 0 and groups[g][1] >= stop:
                        start, stop = groups[g]
                    elif g + 1 < len(groups) and groups[g + 1][0] < stop:  # a bracket or plus before the group
                        start, stop = groups[g + 1][0], max(groups[g + 1][1], stop)
                    if (start, stop) in found:
                        continue
                    k = bisect_right(taken_starts, stop - 1) - 1
                    if k >= 0 and reach[k] > start:
                        continue
                    i, j = one.words(start, stop)
                    surface = one.text[start:stop]
                    core = raw[words.start[i] : words.stop[j]]
                    found[start, stop] = {
                        "start": start, "stop": stop, "entity": entity(words, i, j), "head": int(words.exact[i].view(np.int64)), "key": i == j and (is_key(core) or _ISSUED.fullmatch(core) is not None),
                        "fits": sum(1 << n for n, kind in enumerate(ALL_KINDS) if fits(kind, surface)), "links": _links(places.of(i, j)),
                    }
            out.append(list(found.values()))
        return [pa.array(out, pa.list_(_MENTION))]

    return map_chunks(docs, text, kernel, MENTIONS, [key]).select(key, F.explode("mentions").alias("m")).select(key, "m.*")


def _kind_bit(kind) -> F.Column:
    bits = F.create_map(*[x for n, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(1 << n))])
    return F.element_at(bits, kind)


def score_graph(edges: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((pattern, anchor, kind, confidence) of trusted patterns, (entity, kind, chance) of sufficient chance).

    edges: (pattern, anchor, entity, kind, fits, n), one row for each pattern and entity: n mentions; kind is null where
    the entity is no seed. places: (pattern, places).
    """
    seeds = edges.where("kind IS NOT NULL").select("pattern", "anchor", "entity", "kind", "n", F.lit(1.0).alias("w"))
    rest = edges.where("kind IS NULL OR kind = 'secret'").select("pattern", "anchor", "entity", "fits", "n", F.col("kind").isNotNull().alias("seed"))
    places = places.select(F.col("pattern").alias("__of"), "places")
    # Of each pattern, the mentions that are no seeds and fit each kind.
    bits = {k: 1 << n for n, k in enumerate(ALL_KINDS)}
    open_of = edges.where("kind IS NULL").groupBy("pattern").agg(*[F.sum(F.when(F.col("fits").bitwiseAND(F.lit(b)) != 0, F.col("n")).otherwise(0)).alias(f"open_{k}") for k, b in bits.items()])
    places = saved(places.join(open_of.withColumnRenamed("pattern", "__o"), F.col("__of") == F.col("__o"), "left").drop("__o"))
    open_mentions = F.coalesce(*[F.when(F.col("kind") == k, F.coalesce(f"open_{k}", F.lit(0))) for k in ALL_KINDS])
    scored = seeds.withColumn("known", F.lit(True))
    for turn in range(rounds):
        weight = F.col("w") * F.col("n")
        tally = scored.groupBy("pattern", "anchor", "kind").agg(F.sum(weight).alias("hits"), F.sum(F.when(F.col("known"), 0.0).otherwise(weight)).alias("closed"), F.count(F.when(F.col("w") >= MIN_CONFIDENCE, True)).alias("support"))
        trusted = tally.where(F.col("support") >= MIN_SUPPORT).join(places, F.col("pattern") == F.col("__of")).where(F.col("hits") >= MIN_SHARE * F.col("places"))
        decided = F.greatest(F.col("places") - (open_mentions - F.col("closed")), F.col("hits"))
        trusted = trusted.withColumn("confidence", F.col("hits") / decided).where(F.col("confidence") >= MIN_CONFIDENCE)
        trusted = saved(trusted.select("pattern", "anchor", "kind", "confidence"))
        known = trusted.select(F.col("pattern").alias("__p"), F.col("kind").alias("as"), "confidence")
        met = rest.join(known, rest["pattern"] == known["__p"]).where(F.col("fits").bitwiseAND(_kind_bit(F.col("as"))) != 0)
        # Patterns of one anchor say the same thing: the best of them counts.
        by_anchor = met.groupBy("entity", "as", "anchor").agg(F.log(F.greatest(1 - F.max("confidence"), F.lit(1e-6))).alias("doubt"))
        total = by_anchor.groupBy("entity", "as").agg(F.sum("doubt").alias("doubt"))
        if turn == rounds - 1:
            chance = total.select("entity", F.col("as").alias("kind"), (1 - F.exp("doubt")).alias("chance")).where(F.col("chance") >= MIN_CONFIDENCE)
            return trusted, saved(chance)
        by_anchor = by_anchor.select(F.col("entity").alias("__e"), F.col("as").alias("__as"), F.col("anchor").alias("__a"), F.col("doubt").alias("own"))
        total = saved(total.select(F.col("entity").alias("__t"), "as", "doubt"))
        # Towards a pattern, without what its own anchor says.
        toward = rest.where("NOT seed").join(total, rest["entity"] == total["__t"]).where(F.col("fits").bitwiseAND(_kind_bit(F.col("as"))) != 0)
        toward = toward.join(by_anchor, (F.col("entity") == F.col("__e")) & (F.col("as") == F.col("__as")) & (F.col("anchor") == F.col("__a")), "left")
        others = toward.select("pattern", "anchor", "entity", F.col("as").alias("kind"), "n", (1 - F.exp(F.col("doubt") - F.coalesce("own", F.lit(0.0)))).alias("w"))
        scored = seeds.withColumn("known", F.lit(True)).unionByName(others.where("w > 0").withColumn("known", F.lit(False)))
    raise ValueError("rounds must be positive")


def _edges(rows: DataFrame, kind, fit) -> DataFrame:
    each = rows.withColumn("l", F.explode("links"))
    return each.groupBy(F.col("l.pattern").alias("pattern"), F.col("l.anchor").alias("anchor"), "entity").agg(F.max(kind).alias("kind"), F.max(fit).alias("fits"), F.count("*").alias("n"))


def candidate_patterns(learnt: DataFrame) -> DataFrame:
    """(__c) of the patterns that may come to be trusted, going by known entities alone.

    learnt: (pattern, kind, n, seed), one row for each known entity. Of some kind a pattern needs enough entities; and since
    seeds of other kinds always speak against it, their mentions bound its confidence.
    """
    of = {k: F.col("kind") == k for k in ALL_KINDS}
    tally = learnt.groupBy("pattern").agg(
        *[F.count(F.when(x, True)).alias(f"support_{k}") for k, x in of.items()],
        *[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(f"hits_{k}") for k, x in of.items()],
        *[F.sum(F.when(~x & F.col("seed"), F.col("n")).otherwise(0)).alias(f"against_{k}") for k, x in of.items()],
    )
    enough = F.lit(False)
    for k in ALL_KINDS:
        enough = enough | ((F.col(f"support_{k}") >= MIN_SUPPORT) & (F.col(f"hits_{k}") >= MIN_CONFIDENCE * (F.col(f"hits_{k}") + F.col(f"against_{k}"))))
    return tally.where(enough).select(F.col("pattern").alias("__c"))


def bootstrap(rows: DataFrame, docs: DataFrame, text: str, key: str, readings: int = READINGS) -> DataFrame:
    """(key, start, stop, kind) of what the contexts of the seeds in ``rows`` show in the texts of ``docs``; saved.

    rows: ``key`` (a hash of the text) and seeds of every document. docs: ``key`` and ``text``.
    """
    spark = docs.sparkSession
    seeds = rows.select(F.explode("seeds").alias("s")).select("s.*")
    known = saved(_edges(seeds, F.col("kind"), F.lit((1 << len(ALL_KINDS)) - 1)))
    # Equal texts are read as mentions once, but their places are counted in all of them.
    copies = rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1").select(F.col(key).alias("__text"), "copies")
    learnt = known.select("pattern", "kind", "n", F.lit(True).alias("seed"))
    found = accepted = trusted = asked = possible = None
    seen = 0
    for turn in range(readings):
        candidates = candidate_patterns(learnt)
        # Places of a pattern are counted once.
        fresh = saved(candidates if asked is None else candidates.join(asked, F.col("__c") == F.col("__asked"), "left_anti"))
        sieve = Sieve(fresh, "__c")
        if not sieve.empty or possible is None:
            counted = count_places(docs, text, sieve).where(F.col("odd") >= MIN_CONFIDENCE * F.col("places"))
            counted = counted.join(fresh, F.col("pattern") == F.col("__c"), "left_semi").select("pattern", "places")
            possible = saved(counted if possible is None else counted.unionByName(possible))
            asked = fresh.select(F.col("__c").alias("__asked")) if asked is None else asked.unionByName(fresh.select(F.col("__c").alias("__asked")))
        heads = spark.createDataFrame([], "head bigint") if accepted is None else accepted.select("head").distinct()
        read = saved(mentions(docs, text, key, Sieve(possible, "pattern"), Sieve(heads, "head")).distinct())
        n = read.count()
        if n == seen:  # nothing that was not there before
            break
        found, seen = read, n
        many = found.where("NOT key").join(copies, F.col(key) == F.col("__text"), "left").select("entity", "fits", F.coalesce("copies", F.lit(1)).alias("copies"), F.explode("links").alias("l"))
        new = many.groupBy(F.col("l.pattern").alias("pattern"), F.col("l.anchor").alias("anchor"), "entity").agg(F.lit(None).cast("string").alias("kind"), F.max("fits").alias("fits"), F.sum("copies").alias("n"))
        edges = saved(known.unionByName(new).groupBy("pattern", "anchor", "entity").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits"), F.sum("n").alias("n")))
        trusted, chances = score_graph(edges, possible)
        if turn == readings - 1:
            accepted = chances
            break
        named = found.select("entity", "head").distinct().select(F.col("entity").alias("__found"), "head")
        accepted = saved(chances.join(named, F.col("entity") == F.col("__found")).select("entity", "kind", "chance", "head"))
        more = edges.where("kind IS NULL").join(accepted.select(F.col("entity").alias("__known"), F.col("kind").alias("as")).distinct(), F.col("entity") == F.col("__known"))
        learnt = known.select("pattern", "kind", "n", F.lit(True).alias("seed")).unionByName(more.select("pattern", F.col("as").alias("kind"), "n", F.lit(False).alias("seed")))
    if found is None:
        return rows.select(key, F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(SECRET).alias("kind")).where("false")
    place = found.select(key, "start", "stop", "fits", F.explode("links.pattern").alias("pattern"))
    by_place = place.join(trusted.select(F.col("pattern").alias("__p"), "kind", "confidence"), F.col("pattern") == F.col("__p")).select(key, "start", "stop", "fits", "kind", "confidence")
    by_entity = found.join(accepted.select(F.col("entity").alias("__known"), "kind", F.col("chance").alias("confidence")).distinct(), F.col("entity") == F.col("__known")).select(key, "start", "stop", "fits", "kind", "confidence")
    every = by_place.unionByName(by_entity).where(F.col("fits").bitwiseAND(_kind_bit(F.col("kind"))) != 0)
    return saved(every.groupBy(key, "start", "stop").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, base and spans: array<struct<kind, start, stop>> by kind as listed, then start."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "base", "seeds", "spans")]
    hashed = docs.withColumn("__hash", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    rows = saved(extract(hashed, text, [*keep, "__hash"]))
    added = bootstrap(rows, hashed.select("__hash", F.col(f"`{text}`").alias("__text")), "__text", "__hash")
    # The spans of one text: as many as it has room for.
    added = added.groupBy("__hash").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("__added")).select(F.concat("__hash", F.lit("")).alias("__of"), "__added")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    own = F.transform(F.filter("seeds", lambda s: s["sure"] & (s["kind"] == SECRET)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    rank = F.map_from_arrays(F.array(*map(F.lit, ALL_KINDS)), F.array(*map(F.lit, range(len(ALL_KINDS)))))
    every = F.concat("base", F.filter(F.array_union(own, F.coalesce("__added", none)), lambda s: s["stop"] > s["start"]))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.join(added, F.col("__hash") == F.col("__of"), "left").select(*[F.col(f"`{c}`") for c in keep], "base", plain.alias("spans"))


def joined(spans: str):
    """Column: kind:start:stop of each span, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by [KIND]; of spans that overlap one mark stays, over all of them."""
    out, end = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by a mark; null texts stay null.

    Trusted patterns come from all rows. Rows with spans that only the bootstrap found are few; they alone are shuffled
    with their text. Which rows they are is told by a bitmap of bounded size.
    """
    from .exact_dedup import bits_for, bits_of, only_repeated

    columns = docs.columns
    key = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    found = find(docs.select(key.alias("__key"), F.col(f"`{text}`").alias("__text")), "__text", ["__key"])
    extra = found.where(F.size("spans") > F.size("base")).groupBy("__key").agg(F.first("spans").alias("__spans"))
    extra = saved(extra.withColumnRenamed("__key", "__same"))
    bits = bits_for(extra.count())
    rows = only_repeated(docs.withColumn("__key", key), F.struct(F.col("__key")), bits_of(extra, F.struct(F.col("__same")), bits), bits, "__more")

    def marked(rows: DataFrame) -> DataFrame:
        at, names = columns.index(text), [*columns]

        def run(batches):
            for batch in batches:
                old, extra_spans = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
                new = []
                for one, more in zip(old, extra_spans):
                    if one is None:
                        new.append(None)
                        continue
                    spans = base_spans(one) if more is None else [(s["kind"], s["start"], s["stop"]) for s in more]
                    new.append(blank(one, spans) if spans else one)
                arrays = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        small_batches(docs.sparkSession)
        return rows.mapInArrow(run, docs.schema)

    chosen = [F.col(f"`{c}`") for c in columns]
    plain = rows.where("NOT __more").select(*chosen, F.lit(None).cast("array<struct<kind:string,start:int,stop:int>>").alias("__spans"))
    more = rows.where("__more").join(extra, F.col("__key") == F.col("__same"), "left").select(*chosen, "__spans")
    return marked(plain.unionByName(more))
