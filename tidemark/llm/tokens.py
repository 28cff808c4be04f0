"""Token ids of texts, computed once for each distinct piece of text."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, partial
from unicodedata import normalize

import numpy as np
import tokenizers

from tidemark.llm.rolling import MIX, POWERS

REMEMBERED = 4_000_000  # code points, or ids, of the pieces that a worker remembers
PLACES_BITS = 19  # of the table of these pieces
JOINED = 256  # pieces that the tokenizer gets as one text
GROUP = 1_200_000  # code points of the texts that are looked up together
BLANK, SIGN, LETTER = 1, 2, 4
NORMAL = (str.lower, str.casefold, *(partial(normalize, form) for form in ("NFC", "NFD", "NFKC", "NFKD")))

# Spark runs a task for each core; threads of the tokenizer's own would only wait for one another.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point, and a random number for it."""
    signs = np.arange(0x110000, dtype=np.uint32).view("<U1")
    kind = BLANK * np.char.isspace(signs).astype(np.uint8) + LETTER * np.char.isalnum(signs).astype(np.uint8)
    # Letters that a tokenizer's normal form or lower case may end with a mark would take a sign along.
    letters = np.flatnonzero(kind & LETTER)
    marked = [i for i in letters[letters > 127].tolist() if not all(f(chr(i))[-1].isalnum() for f in NORMAL)]
    kind[marked] -= LETTER
    kind[[ord("."), ord(",")]] += SIGN
    value = (np.arange(len(signs), dtype=np.uint64) + np.uint64(1)) * MIX
    value ^= value >> np.uint64(29)
    return kind, value * np.uint64(0x94D049BB133111EB)


def differing(points: np.ndarray, starts: np.ndarray, stops: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Numbers of the pieces whose text is not that of their model; the pieces cover ``points`` without gaps."""
    sizes = stops - starts
    shift = starts[model] - starts
    longer = sizes[model] != sizes
    shift[longer] = 0
    equal = points[np.arange(len(points)) + np.repeat(shift, sizes)] == points
    if equal.all() and not longer.any():
        return np.zeros(0, np.int64)
    return np.flatnonzero(longer | ~np.logical_and.reduceat(equal, starts))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each begin on, as many as its size, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Encoder:
    """Encodes texts with a tokenizer file; ids come as little-endian unsigned 32-bit integers.

    A blank or line feed between two other characters always starts a new piece of a byte-level or
    word tokenizer, and no piece goes over it. The same holds for a dot or comma after a letter or
    digit. So texts are cut before each of these, and every distinct piece is encoded by the tokenizer
    once, as long as it is remembered. A 64-bit hash finds equal pieces, in a group of texts and among
    those remembered, and their texts are then compared, so the hash decides nothing. Strings of special
    tokens are ordinary text.

    Pieces are remembered in a table with one place for each leading part of the hash; ``text`` and ``ids``
    hold their code points and ids one after the other. Once these are full, all is forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        """Give the memory of all pieces back."""
        self.key = None

    def _start(self) -> None:
        self.key = np.zeros(1 << PLACES_BITS, np.uint64)
        self.size, self.count = (np.zeros(1 << PLACES_BITS, np.int32) for _ in range(2))
        self.text_at, self.ids_at = (np.zeros(1 << PLACES_BITS, np.int32) for _ in range(2))
        self.text, self.ids = np.zeros(GROUP, np.uint32), np.zeros(GROUP, np.uint32)
        self.text_end = self.ids_end = 0

    def _append(self, name: str, values: np.ndarray) -> int:
        """Put values behind the others, in a larger array if need be; where they start."""
        kept, begin = getattr(self, name), getattr(self, f"{name}_end")
        if begin + len(values) > len(kept):
            kept = np.r_[kept, np.zeros(max(len(kept), len(values)), np.uint32)]
            setattr(self, name, kept)
        kept[begin : begin + len(values)] = values
        setattr(self, f"{name}_end", begin + len(values))
        return begin

    def _encode(self, values: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, in the order of numbers that comes first, and how many each has.

        ``whole`` pieces begin with a blank before another character and end with another character. One after the other
        they are a text that is cut right there, so many are encoded at once, and their ids told apart by the places of
        the tokens: much cheaper than a call for each.
        """
        joined, alone = np.flatnonzero(whole), np.flatnonzero(~whole)
        parts = [joined[at : at + JOINED].tolist() for at in range(0, len(joined), JOINED)]
        found, counts = [], []
        texts = ["".join([values[i] for i in part]) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            found.append(np.array(e.ids, np.uint32))
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(found[-1]))
            ends = np.cumsum(np.fromiter((len(values[i]) for i in part), np.int64, len(part)))
            counts.append(np.diff(np.searchsorted(begins, ends), prepend=0))
        for e in self.tokenizer.encode_batch_fast([values[i] for i in alone.tolist()], add_special_tokens=False):
            found.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(found[-1])], np.int64))
        return np.r_[joined, alone], np.concatenate(found), np.concatenate(counts)

    def _ids(
        self, keys: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray, text: str, whole: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each piece start, and how many they are."""
        if self.key is None or max(self.text_end, self.ids_end) > REMEMBERED:
            self._start()
        slot = (keys >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
        hit = np.flatnonzero((self.key[slot] == keys) & (self.size[slot] == size))
        if len(hit):
            equal = points[ranges(begin[hit], size[hit])] == self.text[ranges(self.text_at[slot[hit]].astype(np.int64), size[hit])]
            hit = hit[np.logical_and.reduceat(equal, np.cumsum(size[hit]) - size[hit])]
        at, count = self.ids_at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.ones(len(keys), bool)
        new[hit] = False
        new = np.flatnonzero(new)
        if len(new):
            ends = (begin[new] + size[new]).tolist()
            order, ids, counts = self._encode([text[a:b] for a, b in zip(begin[new].tolist(), ends, strict=True)], whole[new])
            new = new[order]
            at[new] = self._append("ids", ids) + np.cumsum(counts) - counts
            count[new] = counts
            text_at = self._append("text", points[ranges(begin[new], size[new])]) + np.cumsum(size[new]) - size[new]
            place, one = np.unique(slot[new], return_index=True)  # of pieces for one place the first stays
            new = new[one]
            self.key[place], self.size[place], self.count[place] = keys[new], size[new], count[new]
            self.ids_at[place], self.text_at[place] = at[new], text_at[one]
        return at, count

    def many(self, values: list[str | None], together: int = GROUP) -> Iterator[bytes]:
        """Ids of each text, in order; texts are looked up in groups of so many code points."""
        group: list[str] = []
        size = 0
        for value in values:
            group.append(value or "")
            size += len(group[-1])
            if size > together:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[str]) -> Iterator[bytes]:
        text = "".join(group)
        if not text:
            yield from (b"" for _ in group)
            return
        kind_of, value_of = _points()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kind_of[points]
        blank, letter = (kind & BLANK) > 0, (kind & LETTER) > 0
        cut = np.zeros(len(points), bool)
        cut[1:] = ((kind[1:] & SIGN) > 0) & letter[:-1]
        plain = (points == 32) | (points == 10)
        cut[1:-1] |= plain[1:-1] & ~blank[:-2] & ~blank[2:]
        ends = np.cumsum([len(t) for t in group])
        begins = np.r_[0, ends[:-1]]
        cut[begins[begins < len(points)]] = True
        # A blank at the start of a text has no character before it; one at its end is no cut.
        last = ends[ends > begins] - 1
        cut[last[plain[last]]] = np.isin(last[plain[last]], begins)
        starts = np.flatnonzero(cut)
        stops = np.r_[starts[1:], len(points)]
        up, down = POWERS.get(len(points) + 1)
        running = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value_of[points] * up[: len(points)], out=running[1:])
        keys = (running[stops] - running[starts]) * down[starts] + (stops - starts).astype(np.uint64)
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        # Pieces that differ from the one with their hash are pieces of their own.
        unlike = differing(points, starts, stops, first[place])
        if len(unlike):
            keys = np.r_[keys, keys[place[unlike]] ^ MIX]
            place[unlike] = len(first) + np.arange(len(unlike))
            first = np.r_[first, unlike]
        begin, end = starts[first], stops[first]
        whole = plain[begin] & (end - begin > 1) & ~blank[np.minimum(begin + 1, len(points) - 1)] & ~blank[end - 1]
        at, count = self._ids(keys, points, begin, end - begin, text, whole)
        counts = count[place]
        upto = np.cumsum(counts)
        ids = self.ids[ranges(at[place], counts)]
        bounds = np.r_[0, upto][np.searchsorted(starts, np.r_[begins, len(points)])]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b].tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, one for each worker process."""
    return Encoder(path)
