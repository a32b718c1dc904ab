"""Match Rating comparison of codes."""

from __future__ import annotations

# Least rating by the codes' total length; beyond the last, 1.
_LEAST = ((4, 5), (7, 4), (11, 3), (12, 2))


def least_rating(total: int) -> int:
    return next((rating for most, rating in _LEAST if total <= most), 1)


def rating(a: str, b: str) -> int:
    """Six less what is left of the longer code when equal characters cancel from the left and from the right."""
    x, y = list(a), list(b)
    for at in range(min(len(x), len(y))):
        for k in (at, -1 - at):
            if x[k] == y[k]:
                x[k] = y[k] = " "
    return abs(6 - max(len("".join(z).replace(" ", "").encode()) for z in (x, y)))


def codes_match(a: str, b: str) -> bool:
    """Whether two Match Rating codes are similar enough; not if either is empty."""
    if not a or not b:
        return False
    n, m = len(a.encode()), len(b.encode())
    return abs(n - m) < 3 and rating(a, b) >= least_rating(n + m)
