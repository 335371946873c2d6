"""How much two texts share, as twice the letters of their common blocks over all their letters.

The longest block that both have is taken first, the earliest in the first text and then in the second; what lies before it and after it
is compared in the same way. A letter that makes up more than a hundredth of a second text of 200 letters or more begins no block.
The longest block of two ranges is found by a suffix automaton of the second, in time of their lengths.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters from which on the second text has popular letters, and texts are no longer short.
POPULAR_FROM = 200


def longest_block(first: str, second: str, barred: frozenset[str] = frozenset()) -> tuple[int, int, int]:
    """(place in first, place in second, length) of their longest common block without ``barred`` letters; the earliest of equals."""
    # A state's links by letter, the state of its longest proper suffix, its length, and where it first ends.
    step: list[dict] = [{}]
    suffix, length, ends = [-1], [0], [-1]
    last = 0
    for at, letter in enumerate(second):
        key = -at - 1 if letter in barred else letter  # a barred letter is like no other
        new = len(step)
        step.append({})
        suffix.append(0)
        length.append(at + 1)
        ends.append(at)
        p = last
        while p >= 0 and key not in step[p]:
            step[p][key] = new
            p = suffix[p]
        if p >= 0:
            q = step[p][key]
            if length[q] != length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                suffix.append(suffix[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and step[p].get(key) == q:
                    step[p][key] = copy
                    p = suffix[p]
                suffix[q] = q = copy
            suffix[new] = q
        last = new
    best = (0, 0, 0)
    state = size = 0
    for at, letter in enumerate(first):
        while state and letter not in step[state]:
            state = suffix[state]
            size = length[state]
        if letter in step[state]:
            state, size = step[state][letter], size + 1
        else:
            state = size = 0
        if size > best[2]:
            best = (at - size + 1, ends[state] - size + 1, size)
    return best


def short_block(first: str, second: str) -> tuple[int, int, int]:
    """``longest_block`` of short texts without barred letters: blocks that begin at each letter are sought while they are longer than the best."""
    best = (0, 0, 0)
    for at in range(len(first)):
        size = best[2]
        while at + size < len(first) and (place := second.find(first[at : at + size + 1])) >= 0:
            size += 1
            best = (at, place, size)
    return best


def common_letters(first: str, second: str) -> int:
    """Letters in the common blocks of two texts."""
    if first == second and len(second) < POPULAR_FROM:
        return len(first)
    barred = frozenset()
    if len(second) >= POPULAR_FROM:
        counts = Counter(second)
        barred = frozenset(c for c, n in counts.items() if n > len(second) // 100 + 1)
    total, ranges = 0, [(0, len(first), 0, len(second))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        short = not barred and b1 - b0 < POPULAR_FROM and a1 - a0 < POPULAR_FROM
        i, j, size = short_block(first[a0:a1], second[b0:b1]) if short else longest_block(first[a0:a1], second[b0:b1], barred)
        i, j = i + a0, j + b0
        # A block goes on over letters that cannot begin one.
        while i > a0 and j > b0 and first[i - 1] == second[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and first[i + size] == second[j + size]:
            size += 1
        if size:
            total += size
            if a0 < i and b0 < j:
                ranges.append((a0, i, b0, j))
            if i + size < a1 and j + size < b1:
                ranges.append((i + size, a1, j + size, b1))
    return total


def ratio(first: str | None, second: str | None) -> float:
    """0 to 1, 1 for two empty texts; not symmetric. None is empty."""
    a, b = first or "", second or ""
    return 2.0 * common_letters(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(first: Column, second: Column) -> Column:
    """``ratio`` of two columns."""
    import pandas as pd

    return F.pandas_udf(lambda a, b: pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")(first, second)
