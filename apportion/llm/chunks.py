"""Cuts texts at spaces so that each part can be encoded on its own, and keeps results.

Under the pre-tokenising pattern a match may begin with one space and holds none
elsewhere, unless it is a run of white space. So where every part between two spaces
holds more than white space, the text may be cut before each space, and the
parts' matches are the text's. Other texts are encoded as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

KEPT_PARTS = 300_000  # in each of two generations
LONGEST_KEPT = 64
CHARS_AT_ONCE = 1 << 19


class PartEncoder:
    """Encodes texts part by part and remembers a bounded number of short parts.

    ``whole`` maps texts to the bytes of their ids; ``run`` does so for parts that
    begin with a space and hold more than white space.
    """

    def __init__(
        self,
        whole: Callable[[list[str]], list[bytes]],
        run: Callable[[list[str]], list[bytes]],
        kept: int = KEPT_PARTS,
    ):
        self._whole, self._run, self._room = whole, run, kept
        # By what follows the space, in two generations: the older one is dropped when the newer is full, and
        # what is used again moves to the newer, so that frequent parts always stay.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; what is not remembered is encoded for all of them at once."""
        known = self._known
        split = [x.split(" ") for x in texts]
        rest = [x[1:] for x in split]
        missing = set().union(*rest).difference(known)
        blank = {p for p in missing if not p.strip()}
        if blank:
            odd = [not blank.isdisjoint(x[1:]) for x in split]
            found = iter(self._whole([x for x, o in zip(texts, odd, strict=True) if o]))
            plain = iter(self.ids_of([x for x, o in zip(texts, odd, strict=True) if not o]))
            return [next(found) if o else next(plain) for o in odd]
        again = {p: i for p in missing if (i := self._older.get(p)) is not None}
        missing.difference_update(again)
        if len(known) + len(again) + len(missing) > self._room and known:
            known.update(again)
            again = {p: known[p] for p in set().union(*rest) - missing}
            self._older, self._known = known, {}
            known = self._known
        known.update(again)
        known.update(zip(missing, self._run([" " + p for p in missing]), strict=True))
        heads = self._whole([x[0] for x in split])
        out = [head + b"".join(map(known.__getitem__, x)) for head, x in zip(heads, rest, strict=True)]
        for part in [p for p in missing if len(p) > LONGEST_KEPT]:
            del known[part]
        return out

    def encoded(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (key, text) as (key, ids), several texts at once."""
        keys, texts, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                yield from zip(keys, self.ids_of(texts), strict=True)
                keys, texts, size = [], [], 0
        yield from zip(keys, self.ids_of(texts), strict=True)
