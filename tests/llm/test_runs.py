"""Runs of lines by a walk from each line, and on a text that is blank but for one line."""

import random
import time

from barloom.llm.lines import runs


def walked(words, usable, least):
    out = set()
    for step in (1, -1):
        for k in range(len(words)):
            end, total = k, 0
            while 0 <= end < len(words) and usable[end]:
                total += words[end]
                if total >= least:
                    out.add((min(k, end), max(k, end)))
                    break
                end += step
    return out


def test_runs_are_those_of_a_walk():
    dice = random.Random(1)
    for _ in range(3000):
        n = dice.randint(0, 12)
        words, usable, least = dice.choices([0, 0, 1, 2, 3, 7], k=n), [dice.random() < 0.8 for _ in range(n)], dice.choice([1, 2, 5, 9])
        assert runs(words, usable, least) == walked(words, usable, least)


def test_very_many_blank_lines():
    began = time.time()
    assert len(runs([0] * 100_000 + [5] + [0] * 100_000, [True] * 200_001, 5)) == 200_001
    assert time.time() - began < 10
