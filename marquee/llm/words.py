"""Fast exact encoding by the parts of a text that a tokenizer treats separately.

A space followed by a non-space always begins a new pre-token of the tokenizers
used here, whatever stands before it, and so does a single line end between two non-spaces and
punctuation after a letter, so a text is the sequence of its parts between such places and its ids are
the ids of the parts in that order. Places are found on the bytes of a slice of texts at once, and where
a neighbour is in doubt (a byte that may belong to a Unicode space) there is none: a longer part is as exact.
Parts repeat, so a slice's distinct parts are looked up in what the worker knows, what it misses goes to the library, and
the ids of all texts are gathered from there. The store is bounded by bytes and
emptied when it is full, which costs time, not results; parts of over ``LONGEST``
characters (text without spaces) are kept for their slice only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from marquee.llm.hashing import text_slices
from marquee.llm.workers import store

LONGEST = 64
_SPACE, _LINE, _NEXT, _BEFORE, _LETTER, _CLOSING = 1, 2, 4, 8, 16, 32


def _byte_classes() -> np.ndarray:
    """What a byte may be: ``_NEXT`` surely begins a non-space, ``_BEFORE`` surely ends one."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[0x20], kind[0x0A] = _SPACE, _LINE
    kind[0x21:0x7F] |= _NEXT | _BEFORE
    kind[0xC3:0xE1] |= _NEXT  # U+00C0 to U+0FFF
    kind[0xE4:0xF5] |= _NEXT  # from U+4000 on
    kind[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] |= _LETTER
    kind[np.frombuffer(b".,;:!?", np.uint8)] |= _CLOSING
    return kind


_KIND = _byte_classes()


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes) begin."""
    kind = _KIND[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    follows = np.zeros(len(kind), dtype=bool)  # a non-space of the same text stands behind
    follows[:-1] = kind[1:] & _NEXT
    follows[ends - 1] = False
    line = (kind & _LINE).astype(bool) & follows
    line[1:] &= (kind[:-1] & _BEFORE).astype(bool)
    line[begins] = False
    cut = (kind & _SPACE).astype(bool) & follows
    cut |= line
    cut[1:] |= line[:-1]
    cut[1:] |= (kind[1:] & _CLOSING).astype(bool) & (kind[:-1] & _LETTER).astype(bool)
    cut[begins] = True
    return np.flatnonzero(cut)


def _without_spaces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the space that a part of more than a space begins with."""
    long = np.diff(np.append(starts, len(data))) > 1
    gone = (data[starts] == 0x20) & long
    kept = np.ones(len(data), dtype=bool)
    kept[starts[gone]] = False
    return data[kept], starts - (np.cumsum(gone) - gone)


class _Ids:
    """Lists of ids by number, one behind the other."""

    def __init__(self):
        self.n, self.ids, self.starts = 0, np.zeros(1024, dtype="<u4"), np.zeros(1024, dtype=np.int64)

    def add(self, lists: list) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        at, n = int(self.starts[self.n]), len(lists)
        end = at + int(lengths.sum())
        if self.n + n >= len(self.starts):
            self.starts = np.concatenate([self.starts[:self.n + 1], np.zeros(self.n + 2 * n, dtype=np.int64)])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(2 * end - at, dtype="<u4")])
        self.ids[at:end] = np.fromiter(chain.from_iterable(lists), "<u4", end - at)
        self.starts[self.n + 1:self.n + n + 1] = at + np.cumsum(lengths)
        self.n += n

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered lists in that order, and where each ends up (one more than lists)."""
        start = self.starts[numbers]
        length = self.starts[numbers + 1] - start
        place = np.zeros(len(numbers) + 1, dtype=np.int64)
        np.cumsum(length, out=place[1:])
        at = np.repeat(start - place[:-1], length)
        at += np.arange(len(at))
        return self.ids[at], place


class PartEncoder:
    """``encode_many(list of strings) -> list of id lists``, remembered by part.

    ``prefix``: what a part keeps of the space before it (nothing where the tokenizer drops white space).
    ``folds``: the tokenizer lower-cases, so ASCII parts are encoded in lower case, unless that
    would make one of its ``special`` strings. ``first`` numbers what was encoded, ``later`` the
    parts that came down to that in lower case.
    """

    def __init__(self, encode_many, prefix: str, max_bytes: int = 256 << 20, folds: bool = False, special: tuple = ()):
        self.encode_many, self.prefix, self.max_bytes, self.folds, self.special = encode_many, prefix, max_bytes, folds, special
        self.whole = any(re.search(r"[\s.,;:!?]", s) for s in special)  # no place is safe
        self._empty()

    def _empty(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, str] = {}
        self.known, self.used = _Ids(), 0

    def _plain(self, part: str) -> str:
        if self.folds and part.isascii():
            low = part.lower()
            if not any(t in low for t in self.special):
                return low
        return part

    def _learn(self, missed: list[str]) -> list[int]:
        """Numbers of parts that ``first`` has not; those of long ones hold for their slice."""
        plain = [self.later.get(p) or self._plain(p) for p in missed]
        new = [p for p in dict.fromkeys(plain) if p not in self.first]
        new.sort(key=lambda p: len(p) > LONGEST)  # long ones last
        made, start = self.encode_many(new) if new else [], self.known.n
        number = dict(zip(new, range(start, start + len(new))))
        self.known.add(made)
        kept = [p for p in new if len(p) <= LONGEST]
        self.lasting = start + len(kept)
        self.first.update(zip(kept, range(start, self.lasting)))
        folded = [(p, low) for p, low in zip(missed, plain) if p != low and p not in self.later and len(p) <= LONGEST]
        self.later.update(folded)
        self.used += (200 * (len(kept) + len(folded)) + sum(map(len, kept)) + 4 * int(self.known.starts[self.lasting] - self.known.starts[start])
                      + sum(len(p) for p, _ in folded))
        return [number[p] if p in number else self.first[p] for p in plain]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, offsets)`` for slices of a string column: ``ids[offsets[i]:offsets[i + 1]]``
        (little-endian unsigned 32-bit) are those of the i-th text. Nulls are empty."""
        for row, data, offsets in text_slices(texts):
            if self.used > self.max_bytes:
                self._empty()
            starts = part_starts(data, offsets) if not self.whole else offsets[:-1][np.diff(offsets) > 0]
            first_part = np.searchsorted(starts, offsets)
            if not self.prefix:
                data, starts = _without_spaces(data, starts)
            parts = pa.LargeStringArray.from_buffers(
                len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
            distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            number = np.fromiter(map(self.first.get, distinct, repeat(-1)), np.int64, len(distinct))
            missed = np.flatnonzero(number < 0)
            self.lasting = self.known.n
            if len(missed):
                number[missed] = self._learn([distinct[i] for i in missed.tolist()])
            ids, place = self.known.joined(number[parts.indices.to_numpy()])
            self.known.n = self.lasting
            yield row, ids, place[first_part]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out = []
        for _, ids, offsets in self.encode(pa.array(texts, pa.large_string())):
            out += [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return out


def tokenizers_encoder(path: str, prefix: str) -> PartEncoder:
    """Of a ``tokenizers`` JSON file, kept while the worker encodes; special tokens
    in a text are what the file says, as in a plain call of the library."""
    known = store("words")
    if path not in known:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        normal = tokenizer.normalizer.normalize_str("AZ") if tokenizer.normalizer else "AZ"
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        known[path] = PartEncoder(_encode_many(tokenizer, special), prefix, folds=normal == "az", special=special)
    return known[path]


#: A word that the tokenizers used here neither cut nor normalise but for its case.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _encode_many(tokenizer, special: tuple):
    """Ids of many strings. A word of Latin letters is one pre-token, so it goes to the library's model at once, in the
    letters of its pre-tokenizer, if a probe of all these letters finds that so; anything else takes the whole way."""
    def pieces(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    letters = [c for c in map(chr, range(256)) if _WORD.fullmatch(c)]
    spelled = str.maketrans({c: "".join(pieces(c)) for c in letters} | {" ": "".join(pieces(" a"))[:-1]})
    probe = " " + "".join(letters)
    one = pieces(probe) == [probe.translate(spelled)] and not any(_WORD.fullmatch(s) for s in special)
    model = tokenizer.model

    def encode_many(strings: list[str]) -> list[list[int]]:
        out = [[t.id for t in model.tokenize(s.translate(spelled))] if one and _WORD.fullmatch(s) else None for s in strings]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = e.ids
        return out

    return encode_many
