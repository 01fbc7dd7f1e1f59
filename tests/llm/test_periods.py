"""Passages whose words repeat with a short period, in which the rolling hash ties."""

import random

import pytest

from heritree.llm import substrings


@pytest.mark.parametrize("period", [1, 2, 3, 4])
@pytest.mark.parametrize("n", [51, 100, 300])
def test_periodic_passages_are_found_wherever_they_stand(period, n):
    r = random.Random(10 * n + period)
    words = lambda k: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 9))) for _ in range(k)]
    found, trials = 0, 100
    for _ in range(trials):
        base = words(period)
        # the run starts with another of its words in the second text, too
        runs = [[base[(k + shift) % period] for k in range(n)] for shift in (0, r.randrange(period))]
        a, b = (substrings.text_chunks(" ".join([*words(r.randrange(60)), *run, *words(r.randrange(60))])) for run in runs)
        held, run, best = {c[2:] for c in a}, 0, 0
        for c in b:
            run = run + c[1] if c[2:] in held else 0
            best = max(best, run)
        found += best >= substrings.MIN_WORDS
    assert found >= 0.99 * trials


def test_cuts_of_a_run_have_more_than_reach_words():
    words = [b"a", b"b"] * 100
    ends = substrings.cuts(words).tolist()
    assert all(y - x > substrings.REACH for x, y in zip(ends[1:-1], ends[2:-1])) and len(ends) > 20
