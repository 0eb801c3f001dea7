"""Aho-Corasick over words: a text becomes a sequence of word numbers, so a phrase of n words costs n nodes."""

from __future__ import annotations

import ahocorasick

#: Lower-cases A-Z; all other ASCII but digits and letters becomes a space, bytes from 0x80 on belong to words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Phrases:
    """Finds phrases, given as {words: value}, at every place where they stand. Only the phrases travel to the tasks;
    each task builds the automaton once."""

    def __init__(self, phrases: dict[tuple[bytes, ...], object]):
        self.phrases = list(phrases.items())
        self.numbers: dict[bytes, int] = {}
        self.machine = None

    def __getstate__(self) -> list:
        return self.phrases

    def __setstate__(self, phrases: list) -> None:
        self.__init__(dict(phrases))

    def _built(self):
        if self.machine is None:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for phrase, value in self.phrases:
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase)
                self.machine.add_word(key, (len(key), value))
            if self.phrases:
                self.machine.make_automaton()
        return self.machine

    def places(self, words: list[bytes]) -> list[tuple[int, int, object]]:
        """(first word, words, value) of every place, by end."""
        machine = self._built()
        if not self.phrases or not words:
            return []
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        if not any(ids):
            return []
        return [(end - n + 1, n, value) for end, (n, value) in machine.iter(tuple(ids))]
