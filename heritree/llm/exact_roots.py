"""Exact characteristic polynomials of integer matrices, their real roots, and null-space vectors, in high precision.

The polynomial is computed modulo primes, each by reduction to Hessenberg form, and put together by Chinese remaindering.
A symmetric matrix has real roots only, so the number of roots above a point is the number of sign changes of the
polynomial shifted there (Descartes' rule is exact then, with multiplicities): bisection by that count isolates roots.
All of this is on one d x d matrix; nothing here grows with rows.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from decimal import Decimal, localcontext
from math import comb

import numpy as np

TOP, DIGITS = 1 << 31, 150  # primes lie below TOP, so that products fit in a long; digits of the null-space vectors
_APART = 100  # bits, relative: roots closer than that count as one of higher multiplicity
_FINE = 220  # bits, relative, to which a root is refined


def _is_prime(n: int) -> bool:
    """By Miller and Rabin with bases that are known to suffice below 3.4e14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds twice the bound, and one more that the result is held against."""
    out, product, p = [], 1, TOP
    while product <= 2 * bound + 1 or len(out) < 2:
        p -= 1
        if _is_prime(p):
            out.append(p)
            product *= p
    while not _is_prime(p := p - 1):
        pass
    return [*out, p]


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient of a positive semidefinite matrix's polynomial is larger: symmetric means fall (Maclaurin)."""
    return max((comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)), default=1)


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(x - matrix) modulo p. matrix: longs in 0..p-1."""
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        nonzero = np.flatnonzero(h[k:, k - 1])
        if not len(nonzero):
            continue
        if i := int(nonzero[0]):
            h[[k, k + i]] = h[[k + i, k]]
            h[:, [k, k + i]] = h[:, [k + i, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading blocks
    known[0, 0] = 1
    for k in range(d):
        weights, below = np.zeros(k + 1, np.int64), 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            weights[i] = int(h[i, k]) * below % p
        known[k + 1, 1:] = known[k, :-1]
        known[k + 1] = (known[k + 1] - (weights[:, None] * known[: k + 1] % p).sum(axis=0)) % p
    return known[d].tolist()


def remaindered(residues: Sequence[Sequence[int]], primes: Sequence[int]) -> list[int]:
    """The integers (of either sign) with these residues; the last prime only checks them."""
    out, product = list(residues[0]), primes[0]
    for r, p in zip(residues[1:-1], primes[1:-1]):
        inverse = pow(product, -1, p)
        out = [x + product * ((y - x) * inverse % p) for x, y in zip(out, r)]
        product *= p
    out = [x - product if 2 * x > product else x for x in out]
    if [x % primes[-1] for x in out] != list(residues[-1]):
        raise ArithmeticError("the polynomial's coefficients exceed their bound")
    return out


def roots_above(poly: Sequence[int], m: int, s: int) -> int:
    """Number of roots greater than m / 2**s, with multiplicities; all roots must be real."""
    d = len(poly) - 1
    c = [a << s * (d - i) for i, a in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += m * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: Sequence[int], m: int, s: int) -> int:
    out, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        out = out * m + (poly[i] << s * (d - i))
    return (out > 0) - (out < 0)


def largest_roots(poly: Sequence[int], k: int, top: int) -> list[tuple[int, int, int]]:
    """The k largest positive roots, falling, as (m, s, multiplicity): m / 2**s is the root to 220 bits, or to 100 a root of that multiplicity.

    A multiple root is listed once. top: an integer that no root exceeds.
    """
    out, seen = [], 0
    positive = roots_above(poly, 0, 0)
    while seen < min(k, positive):
        low, high, s = 0, top + 1, 0  # the root lies above low and not above high
        above_low, above_high = positive, 0
        single = False
        while True:
            if (above_low - seen == 1) and above_high == seen:
                single = True
                break
            if low and (high - low) << _APART < low:
                break
            if high - low < 2:
                low, high, s = 2 * low, 2 * high, s + 1
            middle = (low + high) // 2
            n = roots_above(poly, middle, s)
            if n > seen:
                low, above_low = middle, n
            else:
                high, above_high = middle, n
        if single:
            right = _sign(poly, high, s) or (1 if seen % 2 == 0 else -1)  # the sign above the root; zero if high is the root
            while not low or (high - low) << _FINE > low:
                if high - low < 2:
                    low, high, s = 2 * low, 2 * high, s + 1
                middle = (low + high) // 2
                sign = _sign(poly, middle, s)
                if not sign:
                    low = high = middle
                    break
                low, high = (low, middle) if sign == right else (middle, high)
        n = above_low - seen
        out.append(((low + high) // 2, s, n))
        seen += n
    return out


def null_vectors(matrix: Sequence[Sequence[int]], root: tuple[int, int, int]) -> list[list[Decimal]]:
    """Orthonormal vectors of the root's eigenspace, by inverse iteration in high precision; the largest entry of each is positive."""
    m, s, n = root
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(m) / (Decimal(2) ** s)
        a = [[Decimal(int(x)) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        order, least = list(range(d)), max(abs(x) for row in a for x in row) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            if abs(a[k][k]) < least:  # the root to the last digit
                a[k][k] = least
            for i in range(k + 1, d):
                if a[i][k]:
                    f = a[i][k] = a[i][k] / a[k][k]
                    row, pivot = a[i], a[k]
                    for j in range(k + 1, d):
                        row[j] -= f * pivot[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum((a[i][j] * y[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return y

        draw = random.Random(d)
        basis = [[Decimal(draw.randint(1, 10**6)) for _ in range(d)] for _ in range(n)]
        for _ in range(3):
            done: list[list[Decimal]] = []
            for v in map(solved, basis):
                for _ in range(2):
                    for u in done:
                        dot = sum((x * y for x, y in zip(u, v)), Decimal(0))
                        v = [x - dot * y for x, y in zip(v, u)]
                    norm = sum((x * x for x in v), Decimal(0)).sqrt()
                    v = [x / norm for x in v]
                done.append(v)
            basis = done
        return [[-x for x in v] if max(v, key=abs) < 0 else v for v in basis]
