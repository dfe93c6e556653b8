"""Suffix deduplication transforms only what may repeat."""

import random

import pytest

from quillspark.llm import suffixes


@pytest.mark.parametrize("first", [False, True])
def test_blocks_hold_only_windows_that_may_repeat(monkeypatch, first):
    rnd, length, groups = random.Random(3), 40, []
    for g in range(60):
        base = bytes(rnd.choice(b"abcdefgh ") for _ in range(90))
        changed = [base[:30] + b"1" + base[31:], base[10:70] + b"2", bytes(rnd.choice(b"xyz") for _ in range(80))]
        groups.append([((g, k), c, 1 + (g % 7 == k), (g, k, 0, 5 * k)) for k, c in enumerate([base, *changed])])
    sizes, transform = [], suffixes.repeated
    monkeypatch.setattr(suffixes, "repeated", lambda data, *more: sizes.append(len(data)) or transform(data, *more))
    blocks = suffixes.Blocks(length, first)
    for group in groups:
        blocks.add(group)
    blocks.close()
    wanted = {}
    for group in groups:
        seen = {}
        for name, c, weight, lead in group:
            for at in range(len(c) - length + 1):
                seen.setdefault(c[at : at + length], []).append((lead[:3], lead[3] + at, name, at, weight))
        for places in seen.values():
            if sum(p[4] for p in places) > 1:
                for p in places:
                    wanted.setdefault(p[2], ([], []))[0].append(p[3])
                    if p[:2] != min(places)[:2]:
                        wanted[p[2]][1].append(p[3])
    flat = lambda runs: sorted(x for a, b in zip(runs[::2], runs[1::2], strict=True) for x in range(a, b + 1))
    found = {name: (flat(runs), flat(later)) for name, runs, later in blocks.found}
    assert found == {n: (sorted(a), sorted(b if first else a)) for n, (a, b) in wanted.items()}
    assert sum(sizes) < sum(len(c[1]) for group in groups for c in group) * 0.8  # before, all of it was transformed
