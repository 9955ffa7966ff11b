"""Byte-level BPE ids through the tokenizers library, each segment encoded once.

The pre-tokenizer of a byte-level vocabulary always has a boundary before a
space that is followed by a visible character, so the ids of a text are the
ids of the segments between such spaces, one after the other.  Segments repeat
far more often than texts do; a bounded per-worker memo keeps their ids as
packed little-endian 16-bit units.  A segment of letters, digits and marks on
which all versions of Unicode agree is cut into pre-tokens here, and these go
straight to the library's model; all others go through the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

if sys.byteorder != "little" or array("H").itemsize != 2:
    raise ImportError("packed ids are little-endian 16-bit units")

#: Ids must fit 16 bits for the packed form.
MAX_ID = 0xFFFF
#: Segments in each of the two generations of a worker's memo; the older goes when the younger is full.
MEMO_SEGMENTS = 800_000
#: Longer segments are encoded anew each time, so that the memo's bytes are bounded.
MEMO_CHARS = 48
#: A space at the end, or before something that some library may take for white space.
_IRREGULAR = re.compile("[ ](?=[\\s\u180e\u200b-\u200f\ufeff]|$)")
#: Letters by any version of Unicode: with the space before them they are one pre-token.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_LETTERS = re.compile(f"[{_L}]+")
#: Letters, line ends, and the printable characters of ASCII but for the space.
_PLAIN = re.compile(f"[{_L}\n!-~]+")
# The pre-token pattern of byte-level vocabularies, for these characters.
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^ \n0-9{_L}]+|[ \n]+(?![^ \n])|[ \n]+")


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_CHARACTERS = _byte_characters()


class Memo(dict):
    """Packed ids by segment (without its leading space), filled on demand."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, segment: str) -> bytes:
        got = self.older.get(segment)
        if got is None:
            got = self.compute(segment)
        if len(segment) <= MEMO_CHARS:
            self[segment] = got
        return got

    def tidy(self) -> None:
        if len(self) > MEMO_SEGMENTS:
            self.older = dict(self)
            self.clear()


class SegmentEncoder:
    """``encode(texts)`` gives the packed ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > MAX_ID + 1:
            raise ValueError("the packed form holds ids below 65,536")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo, self.bare = Memo(self._spaced), Memo(self._pretoken)
        self.model, self.space = self.tokenizer.model, _CHARACTERS[32]
        self.stops = {x: self._pretoken(x) for x in ".,"}

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _written(self, written: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _pretoken(self, text: str) -> bytes:
        """The ids of a pre-token as it stands."""
        return self._written(text.encode().decode("latin-1").translate(_CHARACTERS))

    def _spaced(self, segment: str) -> bytes:
        """The ids of a segment with a space before it."""
        if _LETTERS.fullmatch(segment):
            return self._written(self.space + segment) if segment.isascii() else self._pretoken(" " + segment)
        if segment[-1:] in ".," and _LETTERS.fullmatch(segment, 0, len(segment) - 1):
            return self.memo[segment[:-1]] + self.stops[segment[-1]]
        if _PLAIN.fullmatch(segment):
            first, *rest = _PRETOKEN.findall(" " + segment)
            head = self.memo[first[1:]] if first != " " + segment else self._pretoken(first)
            return head + b"".join(map(self.bare.__getitem__, rest))
        return self._whole(" " + segment)

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.specials) or _IRREGULAR.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        ids = b"".join(map(self.memo.__getitem__, rest))
        if not _PLAIN.fullmatch(first):
            return self._whole(first) + ids if first else ids
        return b"".join(map(self.bare.__getitem__, _PRETOKEN.findall(first))) + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        got = []
        for i, t in enumerate(texts):
            got.append(self._text(t))
            if i % 64 == 0:
                self.memo.tidy()
                self.bare.tidy()
        return got


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def in_groups(texts, most_chars: int = 4_000_000):
    """Slices of a sequence of texts, each of a bounded number of characters or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
