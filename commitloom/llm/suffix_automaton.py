"""A generalised suffix automaton of word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[bytes, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)
    #: whole sequences that end wherever this state's longest passage ends
    whole: set[int] = field(default_factory=set)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; state 0 is the root."""

    def __init__(self, sequences: list[list[bytes]], places: bool = True):
        self.states = [State()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                if places:
                    self.states[last].ends.add((number, place))
        if places:
            self._spread(sequences)

    def _spread(self, sequences: list[list[bytes]]) -> None:
        """Every state learns the places of its passages, and the sequences that end with them."""
        for state in sorted(self.states[1:], key=lambda s: -s.length):
            self.states[state.link].ends |= state.ends
        for number, words in enumerate(sequences):
            for last, _ in self.run(words):
                pass
            if words:
                self.states[last].whole.add(number)
        for state in sorted(self.states[1:], key=lambda s: s.length):
            state.whole |= self.states[state.link].whole

    def _extend(self, last: int, word: bytes) -> int:
        states = self.states
        known = states[last].next.get(word)
        if known is not None:
            fits = states[known].length == states[last].length + 1
            return known if fits else self._split(last, word, known)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            target = states[at].next[word]
            fits = states[target].length == states[at].length + 1
            states[new].link = target if fits else self._split(at, word, target)
        return new

    def _split(self, at: int, word: bytes, target: int) -> int:
        states = self.states
        copy = len(states)
        old = states[target]
        states.append(State(states[at].length + 1, old.link, dict(old.next), set(old.ends)))
        old.link = copy
        while at >= 0 and states[at].next.get(word) == target:
            states[at].next[word] = copy
            at = states[at].link
        return copy

    def run(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """After every word: the state, and the length of the longest match ending there."""
        state = length = 0
        states = self.states
        for word in words:
            while state and word not in states[state].next:
                state = states[state].link
                length = states[state].length
            to = states[state].next.get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield state, length
