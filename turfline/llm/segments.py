"""Texts as segments that tokenize independently, each distinct one once.

In byte-level BPE no match of the splitting pattern goes from a non-space into a space, so a text may be cut before
every space that follows a non-space. Most segments are a space and a word; they come again and again, so a worker
keeps their ids in a table and joins the bytes of its entries for each text. The table has two generations: when the
younger one holds KEPT segments it becomes the older one, whose entries come back when they are met again, so a worker's
memory is bounded and the common segments stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

_WIDE = re.compile(r"\s ")  # a space that doesn't follow a non-space
_CUT = regex.compile(r"(?V1)(?<=[^\s\x1c-\x1f])(?= )")
_HEAD = "\ud800"  # marks a segment without the leading space; no valid text holds it
KEPT, LONGEST, SLICE = 300_000, 48, 1 << 21


def slices(text: str) -> Iterator[str]:
    """Parts of a long text, cut where segments are cut anyway."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _keys(text: str) -> list[str]:
    if _WIDE.search(text):
        first, *rest = _CUT.split(text)
        return [_HEAD + first, *(x[1:] for x in rest)]
    keys = text.split(" ")
    keys[0] = _HEAD + keys[0]
    return keys


class SegmentTable:
    """encode: from a list of segments to their ids as bytes; called once for each segment that isn't in the table."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.ids, self.older = encode, {}, {}

    def _fill(self, keys: set[str]) -> list[str]:
        if len(self.ids) > KEPT:
            self.ids, self.older = {}, self.ids
        new = keys.difference(self.ids)
        if self.older:
            known = new.intersection(self.older)
            self.ids.update((k, self.older[k]) for k in known)
            new -= known
        missing = list(new)
        self.ids.update(zip(missing, self.encode([k[1:] if k[:1] == _HEAD else " " + k for k in missing]), strict=True))
        return [k for k in missing if len(k) > LONGEST]

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Holds the segments of one slice, or of a group of short texts, at a time."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._flush(group)
                group, size = [], 0
                yield b"".join(x for part in slices(text) for x in self._flush([_keys(part)]))
                continue
            group.append(_keys(text))
            size += len(text)
            if size > SLICE:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> list[bytes]:
        if not group:
            return []
        once = self._fill(set().union(*group))
        out = [b"".join(map(self.ids.__getitem__, keys)) for keys in group]
        for k in once:  # long segments seldom come again
            del self.ids[k]
        return out
