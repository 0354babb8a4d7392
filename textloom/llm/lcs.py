"""Longest common subsequences of long sequences, by bit vectors."""

from __future__ import annotations

#: Bits of the table that is kept for tracing back; larger problems are halved first.
TABLE = 1 << 28


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """The bit vector after each element of a (or the last only): bit j is 0 where b[j] lengthens the subsequence."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(a: list, b: list) -> list[int]:
    """The length of the longest common subsequence of a and each beginning of b."""
    v, out = _rows(a, b, False)[0], [0]
    for bit in reversed(f"{v:0{len(b)}b}") if b else ():
        out.append(out[-1] + (bit == "0"))
    return out


def shared(a: list, b: list) -> set[int]:
    """Indices of a's elements on a longest common subsequence with b.

    Equal beginnings and ends are matched first. The work grows with len(a) * len(b) / 64 machine words, whatever
    repeats; memory is bounded by TABLE bits, beyond which a is halved where the lengths of both sides add up best.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(low), *range(len(a) - end, len(a))}
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return found
    if len(a) * len(b) > TABLE and len(a) > 1:
        mid = len(a) // 2
        left, right = _lengths(a[:mid], b), _lengths(a[mid:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return found | {low + i for i in shared(a[:mid], b[:cut])} | {low + mid + i for i in shared(a[mid:], b[cut:])}
    rows = _rows(a, b, True)
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:  # b[j] doesn't lengthen it
            j -= 1
        elif i and not rows[i - 1] >> j & 1:  # nor does a[i]
            i -= 1
        else:
            found.add(low + i)
            i, j = i - 1, j - 1
    return found
