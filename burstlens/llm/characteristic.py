"""Eigenvalues and eigenvectors of an integer matrix from its exact characteristic polynomial.

The matrix is symmetric and has no negative eigenvalue (a scatter matrix). Its polynomial is
found modulo many primes, each by reduction to Hessenberg form, and put together by the Chinese
remainder theorem. As all roots are real, the sign changes of the polynomial shifted by ``c``
are exactly the roots above ``c`` (Descartes), which isolates roots by bisection; Newton steps
in exact arithmetic refine them. Inverse iteration in decimals then gives the null space of the
matrix less each root. Every matrix here is as large as a vector is long, whatever the table.
"""

from __future__ import annotations

import decimal
import math
from decimal import Decimal

import numpy as np

PRIME_TOP = 2**31  # products of two residues fit 64 bits
ROOT_BITS = 200  # of each root
CLUSTER_BITS = 100  # roots that agree to so many bits count as one multiple root
DIGITS = 120  # of inverse iteration


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top``, by a sieve over the stretch that holds them."""
    small = np.arange(2, math.isqrt(top) + 1)
    is_prime = np.ones(len(small), bool)
    for p in range(2, math.isqrt(len(small) + 1) + 1):
        if is_prime[p - 2]:
            is_prime[p * p - 2 :: p] = False
    small, found, high = small[is_prime], [], top
    while len(found) < count:
        low = max(2, high - 30 * (count - len(found)) - 1000)
        open_ = np.ones(high - low, bool)
        for p in small.tolist():
            open_[max(p * p, -(-low // p) * p) - low :: p] = False
        found += (np.flatnonzero(open_)[::-1] + low).tolist()
        high = low
    return found[:count]


def primes_needed(matrix: list[list[int]]) -> list[int]:
    """Primes whose product exceeds twice any coefficient.

    Eigenvalues are at least 0 and sum up to the trace, so coefficient k is at most
    ``C(d, k) * (trace / d) ** k`` (Maclaurin's inequality).
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits = 2 + max(
        math.comb(d, k).bit_length() + k * max(0, (-(-trace // d)).bit_length())
        for k in range(d + 1)
    )
    return primes_below(PRIME_TOP, bits // (PRIME_TOP.bit_length() - 2) + 2)


def char_residues(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of ``det(x - matrix)`` modulo ``p``, the constant first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = poly[k - 1, :-1]
        row = (row - int(h[k - 1, k - 1]) * poly[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row = (row - int(h[i - 1, k - 1]) * below % p * poly[i - 1] % p) % p
        poly[k] = row
    return poly[d]


def combine(residues: dict[int, list[int]]) -> list[int]:
    """Coefficients from their residues by prime (Chinese remaindering, least absolute value)."""
    whole = math.prod(residues)
    size = len(next(iter(residues.values())))
    found = [0] * size
    for p, rest in residues.items():
        others = whole // p
        unit = others * pow(others, -1, p)
        found = [a + unit * int(r) for a, r in zip(found, rest, strict=True)]
    return [r - whole if (r := a % whole) > whole // 2 else r for a in found]


def _scaled(poly: list[int], k: int) -> list[int]:
    """The polynomial whose roots are 2**k times those of ``poly``."""
    d = len(poly) - 1
    return [c << (k * (d - i)) for i, c in enumerate(poly)]


def roots_above(poly: list[int], a: int, k: int = 0) -> int:
    """Roots above ``a / 2**k``, each as often as it is one: sign changes of the shifted one."""
    c = _scaled(poly, k)
    d = len(c) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolate(poly: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """Intervals ``(lo, hi] / 2**k`` of the largest roots above 0, falling: (lo, hi, k, roots).

    An interval holds one root, or several that agree to CLUSTER_BITS. Intervals are given
    until they hold ``most`` roots or there are no more.
    """
    top = 1 << max(1, -poly[-2]).bit_length() if len(poly) > 1 else 1
    found: list[tuple[int, int, int, int]] = []
    todo = [(0, top, 0, roots_above(poly, 0), 0)]
    while todo:
        lo, hi, k, above_lo, above_hi = todo.pop()
        inside = above_lo - above_hi
        if not inside or above_hi >= most:
            continue
        if inside == 1 or lo and (hi - lo) << CLUSTER_BITS <= lo:
            found.append((lo, hi, k, inside))
            continue
        if (hi - lo) % 2:
            lo, hi, k = 2 * lo, 2 * hi, k + 1
        mid = (lo + hi) // 2
        above = roots_above(poly, mid, k)
        todo += [(lo, mid, k, above_lo, above), (mid, hi, k, above, above_hi)]
    return found


def refine(poly: list[int], lo: int, hi: int, k: int, roots: int) -> tuple[int, int]:
    """The root in ``(lo, hi] / 2**k`` as ``(a, k)``, right to about ROOT_BITS bits."""
    if roots > 1:
        return lo + hi, k + 1
    more = max(0, ROOT_BITS - hi.bit_length())
    lo, hi, k = lo << more, hi << more, k + more
    exact = _scaled(poly, k)

    def value(x: int) -> tuple[int, int]:
        v = slope = 0
        for c in reversed(exact):
            slope = slope * x + v
            v = v * x + c
        return v, slope

    at_hi = value(hi)[0]
    if not at_hi:
        return hi, k
    x = (lo + hi) // 2
    while hi - lo > 1:
        v, slope = value(x)
        if not v:
            return x, k
        if (v > 0) == (at_hi > 0):
            hi = x
        else:
            lo = x
        step = x - v // slope if slope else lo
        if abs(step - x) <= 1:  # Newton has arrived: close the interval from the other side
            step = x - 2 if hi == x else x + 2
        x = step if lo < step < hi else (lo + hi) // 2
    return hi, k


def null_vectors(matrix: list[list[int]], a: int, k: int, count: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors that ``matrix`` takes nearly to ``a / 2**k`` times
    themselves, by inverse iteration from fixed starts; their largest entry is positive."""
    d = len(matrix)
    with decimal.localcontext(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        root = Decimal(a) / (Decimal(2) ** k)
        m = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        m[np.arange(d), np.arange(d)] -= root
        tiny = max(abs(root), Decimal(1)).scaleb(-DIGITS)
        order = np.arange(d)
        for i in range(d):
            j = i + max(range(d - i), key=lambda r: abs(m[i + r, i]))
            if i != j:
                m[[i, j]], order[[i, j]] = m[[j, i]], order[[j, i]]
            if not m[i, i]:
                m[i, i] = tiny
            m[i + 1 :, i] /= m[i, i]
            m[i + 1 :, i + 1 :] -= np.outer(m[i + 1 :, i], m[i, i + 1 :])

        def solve(v: np.ndarray) -> np.ndarray:
            v = v[order]
            for i in range(d):
                v[i + 1 :] = v[i + 1 :] - m[i + 1 :, i] * v[i]
            for i in range(d - 1, -1, -1):
                v[i] = v[i] / m[i, i]
                v[:i] = v[:i] - m[:i, i] * v[i]
            return v

        vectors = [
            np.array([Decimal(1 + (i + 1) * (s + 3) * 7919 % 1009) for i in range(d)], object)
            for s in range(count)
        ]
        for _ in range(3):
            for s in range(count):
                v = solve(vectors[s])
                for _ in range(2):
                    for w in vectors[:s]:
                        v = v - w * (v * w).sum()
                vectors[s] = v / (v * v).sum().sqrt()
        out = []
        for v in vectors:
            big = max(range(d), key=lambda i: abs(v[i]))
            out.append([float(x) if v[big] > 0 else -float(x) for x in v])
    return out
