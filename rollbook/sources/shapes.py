"""What a page says, told by its shape: pages with the same tags differ in their texts alone.

A reader of elements (``elements.elements_of``) never looks into a text; it
tells which texts belong to what. So it is run once for each shape, on a page
whose texts are marks, and its answer is kept as the places of the texts to
take. Pages that are not plain, and those of more than ``LONG`` tags, are read
one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from html import unescape
from operator import itemgetter

KEPT, LONG = 16384, 1500  # shapes that a worker remembers, and the tags of the longest of them
MARK = 0x10000  # marks are letters from here on


def marks(n: int) -> tuple[str, ...]:
    return tuple(chr(MARK + i) for i in range(n))


def picked(places: Sequence[int]) -> Callable[[Sequence], Iterable]:
    """The values at some places, in order."""
    if len(places) > 1:
        return itemgetter(*places)
    return itemgetter(slice(places[0], places[0] + 1 or None)) if places else lambda _: ()


class Places:
    """Places of the values of a page, given as texts made of marks: behind its texts stand those put together of several, and None at the end."""

    def __init__(self, size: int) -> None:
        self.size, self.joined = size, {}

    def of(self, text: str | None) -> int:
        if text is None:
            return -1
        if len(text) == 1 and ord(text) >= MARK:
            return ord(text) - MARK
        return self.joined.setdefault(text, self.size + len(self.joined))

    def joins(self) -> list[Callable]:
        """How to get the parts of each text put together from the values; a letter that is no mark stands for itself."""
        out = []
        for text in self.joined:
            at = [ord(c) - MARK for c in text]
            if all(i >= 0 for i in at):
                run = at and at == [*range(at[0], at[0] + len(at))]
                out.append(itemgetter(slice(at[0], at[-1] + 1)) if run else picked(at))
            else:
                out.append(lambda values, text=text: [c if ord(c) < MARK else values[ord(c) - MARK] for c in text])
        return out


def values_of(texts: Iterable[str], escaped: bool) -> list:
    return [unescape(t) if "&" in t else t for t in texts] if escaped else [*texts]
