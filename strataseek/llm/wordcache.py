"""A bounded memo for values computed per word."""

from __future__ import annotations


#: Longer words are held for their round only.
LONG = 64


class WordCache(dict):
    """Holds at most about 2 x ``limit`` words: when full, the words not used lately go.

    A round: ``trim``, ``missing``, add what is missing, look up with ``[]``.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.long = limit, {}, []

    def trim(self) -> None:
        """Call before a round, never within one."""
        for w in self.long:
            self.pop(w, None)
        self.long = []
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, words: set) -> list:
        """The words that are in neither half; those in the older half move up."""
        absent = []
        for w in words.difference(self):
            value = self.old.get(w)
            if value is None:
                absent.append(w)
                if len(w) > LONG:
                    self.long.append(w)
            else:
                self[w] = value
        return absent
