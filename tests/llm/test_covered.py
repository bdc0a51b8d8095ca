"""The bytes that marked strings cover."""

from __future__ import annotations

import time

import numpy as np

from parlance.llm.suffixes import WIDTH, WINDOW, _covered


def test_covered_bytes_are_those_of_the_marked_strings():
    rng = np.random.default_rng(3)
    for n, marks in ((0, 0), (WIDTH, 1), (84, 0), (84, 2), (400, 3), (5000, 40)):
        at = rng.integers(0, max(n - WIDTH - WINDOW + 2, 1), marks)
        mask = rng.integers(0, 1 << WINDOW, marks) if n >= WIDTH + WINDOW - 1 else np.ones(marks, np.int64)
        wanted = np.zeros(n, bool)
        for place, bits in zip(at.tolist(), mask.tolist()):
            for bit in range(WINDOW):
                if bits >> bit & 1:
                    wanted[place + bit:place + bit + WIDTH] = True
        assert np.array_equal(_covered(n, at, mask), wanted)


def test_a_part_is_not_passed_over_for_every_bit():
    n = 4 << 20
    at, mask = np.arange(0, n - 84, 5000), np.full(len(range(0, n - 84, 5000)), (1 << WINDOW) - 1)

    def best(run):
        spent = []
        for _ in range(5):
            start = time.perf_counter()
            run()
            spent.append(time.perf_counter() - start)
        return min(spent)

    one_pass = best(lambda: np.cumsum(np.zeros(n, bool), dtype=np.int32))
    assert best(lambda: _covered(n, at, mask)) < WINDOW / 2 * one_pass
