"""Suffix automaton over words: every substring of a short reference, built in linear time."""

from __future__ import annotations


class SuffixAutomaton:
    """Automaton of one word sequence.

    A state stands for the substrings that end at the same places; ``length`` is
    the longest of them, ``link`` the state of the longest suffix that ends at
    more places.
    """

    __slots__ = ("step", "length", "link")

    def __init__(self, words: list):
        self.step: list[dict] = [{}]
        self.length: list[int] = [0]
        self.link: list[int] = [-1]
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, step: dict, length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, word) -> int:
        step, length, link = self.step, self.length, self.link
        new = self._state({}, length[last] + 1, 0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            target = step[at][word]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = self._state(dict(step[target]), length[at] + 1, link[target])
                while at >= 0 and step[at].get(word) == target:
                    step[at][word] = copy
                    at = link[at]
                link[target] = link[new] = copy
        return new

    def matches(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [start, stop) of ``words`` covered by matches of ``least`` or more words.

        The matching statistic at a word is the length of the longest suffix that
        ends there and occurs in the reference; it is kept up while streaming.
        """
        step, length, link = self.step, self.length, self.link
        found: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            target = step[state].get(word)
            if target is None:
                while state >= 0 and word not in step[state]:
                    state = link[state]
                if state < 0:
                    state = matched = 0
                    continue
                matched = length[state]
                target = step[state][word]
            state = target
            matched += 1
            if matched >= least:
                start = i + 1 - matched
                if found and start <= found[-1][1]:
                    found[-1][1] = i + 1
                    # A longer match may begin before the span that it joins.
                    found[-1][0] = min(found[-1][0], start)
                else:
                    found.append([start, i + 1])
        return [(a, b) for a, b in found]
