"""Minimal acyclic transducers: sorted words to their ordinals, as arrays.

Built from sorted words in one go (Daciuk et al., 2000): the states of the last word's path stay open, and those that the
next word doesn't share are merged with an equal state or numbered.  A transition's output is how many words of its state
come before it, so the outputs along a word's path add up to the word's place in the order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np


class Builder:
    def __init__(self):
        self.last, self.words = b"", 0
        self.path: list[list] = [[0, [], []]]  # open states: final, labels, targets
        self.known: dict[tuple, int] = {}
        self.sizes, self.finals = [], bytearray()  # by state: words from here on, whether one ends here
        self.keys, self.targets, self.outputs = [], [], []

    def add(self, word: bytes) -> None:
        """``word`` comes after all words before it."""
        shared = 0
        for a, b in zip(word, self.last):
            if a != b:
                break
            shared += 1
        self._close(shared)
        self.path += [[0, [], []] for _ in range(len(word) - shared)]
        self.path[-1][0] = 1
        self.last = word
        self.words += 1

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            state = self._number(self.path.pop())
            self.path[-1][1].append(self.last[len(self.path) - 1])
            self.path[-1][2].append(state)

    def _number(self, open_state: list) -> int:
        final, labels, targets = open_state
        key = (final, bytes(labels), *targets)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.sizes)
            before = final  # a word that ends here comes before those that go on
            for label, target in zip(labels, targets):
                self.keys.append(state << 8 | label)
                self.targets.append(target)
                self.outputs.append(before)
                before += self.sizes[target]
            self.sizes.append(before)
            self.finals.append(final)
        return state

    def done(self) -> bytes:
        """The transducer as bytes, for ``Transducer``."""
        self._close(0)
        root = self._number(self.path[0])
        head = np.array([len(self.keys), len(self.sizes), root], np.int64)
        return head.tobytes() + np.array(self.keys, np.int64).tobytes() + np.array([self.targets, self.outputs], np.int32).tobytes() + bytes(self.finals)


class Transducer:
    def __init__(self, data: bytes):
        moves, states, self.root = np.frombuffer(data, np.int64, 3).tolist()
        self.keys = np.frombuffer(data, np.int64, moves, 24)  # state and label, ascending
        self.targets, self.outputs = np.frombuffer(data, np.int32, 2 * moves, 24 + 8 * moves).reshape(2, moves)
        self.finals = np.frombuffer(data, np.uint8, states, 24 + 16 * moves)

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 where it isn't one of the transducer's; all words move one byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        found, state, live, step = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64), np.arange(len(words)), 0
        ended = np.zeros(len(words), bool)
        while len(live):
            over = sizes[live] == step
            ended[live[over]] = self.finals[state[live[over]]] == 1
            live = live[~over]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[at] == key
            live, at = live[goes], at[goes]
            state[live] = self.targets[at]
            found[live] += self.outputs[at]
            step += 1
        return np.where(ended, found, -1)

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal."""
        state, out = self.root, bytearray()
        while ordinal or not self.finals[state]:
            low, high = np.searchsorted(self.keys, [state << 8, (state + 1) << 8]).tolist()
            at = low + bisect_right(self.outputs[low:high].tolist(), ordinal) - 1
            ordinal -= int(self.outputs[at])
            out.append(int(self.keys[at]) & 255)
            state = int(self.targets[at])
        return bytes(out)
