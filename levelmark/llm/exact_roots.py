"""Whole-number linear algebra of a symmetric matrix: its characteristic
polynomial modulo primes, the polynomial's real roots, vectors of a root.

Everything is exact or carries a stated number of bits; sizes depend on the
matrix, never on the rows it was made from.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import comb, gcd, isqrt

import numpy as np

#: Bits by which a root is known beyond its distance from the next one, and of its own size.
ROOT_BITS = 72
#: Rounds of inverse iteration; each gains ROOT_BITS bits.
ROUNDS = 3


def primes(above: int) -> list[int]:
    """Primes below 2^31, from the largest down, until their product is over `above`."""

    def is_prime(n: int) -> bool:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for base in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(base, d, n)
            if x in (1, n - 1):
                continue
            if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return True

    out, product, n = [], 1, 2**31 - 1
    while product <= above:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial of a positive semidefinite
    matrix is larger: elementary symmetric sums are largest where all roots are equal."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return max(-(-comb(d, k) * trace**k // d**k) for k in range(d + 1))


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, highest first, of det(xI - matrix) modulo p (below 2^31),
    by similar transformation to Hessenberg form. `matrix` holds residues."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        r = k + 1 + int(nonzero[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :, k:] = (h[k + 2 :, k:] - factors[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    # known[k]: polynomial of the leading k x k block, lowest coefficient first
    known = np.zeros((d + 1, d + 1), np.int64)
    known[0, 0] = 1
    for k in range(d):
        step = np.zeros(d + 1, np.int64)
        step[1:] = known[k, :-1]
        below, weights = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
            if not below:
                break
        known[k + 1] = (step - (weights[:, None] * known[: k + 1] % p).sum(axis=0)) % p
    return known[d, ::-1]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers of least size with the given residues modulo the primes."""
    values, product = [0] * len(residues[0][1]), 1
    for p, found in residues:
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


# Polynomials: whole coefficients, highest first


def _primitive(f: list[int]) -> list[int]:
    while f and f[0] == 0:
        f = f[1:]
    g = reduce(gcd, f, 0) or 1
    g = -g if f and f[0] < 0 else g
    return [c // g for c in f]


def _remainder(f: list[int], g: list[int]) -> list[int]:
    f = f[:]
    while len(f) >= len(g):
        lead = f[0]
        f = [c * g[0] - lead * (g[i] if i < len(g) else 0) for i, c in enumerate(f)][1:]
    return _primitive(f)


def _quotient(f: list[int], g: list[int]) -> list[int]:
    """f / g where that leaves no remainder."""
    rest, out = [Fraction(c) for c in f], []
    for i in range(len(f) - len(g) + 1):
        out.append(rest[i] / g[0])
        for j, c in enumerate(g):
            rest[i + j] -= out[-1] * c
    scale = reduce(lambda a, b: a * b // gcd(a, b), (c.denominator for c in out), 1)
    return _primitive([int(c * scale) for c in out])


def _derivative(f: list[int]) -> list[int]:
    n = len(f) - 1
    return [c * (n - i) for i, c in enumerate(f[:-1])]


def _common(f: list[int], g: list[int]) -> list[int]:
    while g:
        f, g = g, _remainder(f, g)
    return _primitive(f)


def _surely_simple(f: list[int], p: int = 2**31 - 1) -> bool:
    """Whether f has no repeated root modulo p, and so none at all."""
    a, b = [c % p for c in f], [c % p for c in _derivative(f)]
    if not a[0]:
        return False
    while True:
        while b and not b[0]:
            b = b[1:]
        if not b:
            return len(a) == 1
        inverse = pow(b[0], -1, p)
        while len(a) >= len(b):
            q = a[0] * inverse % p
            a = [(c - q * (b[i] if i < len(b) else 0)) % p for i, c in enumerate(a)][1:]
        a, b = b, a


def square_free(f: list[int]) -> list[tuple[list[int], int]]:
    """Factors without repeated roots, each with how often its roots occur in f."""
    f = _primitive(f)
    if len(f) == 1:
        return []
    if _surely_simple(f):
        return [(f, 1)]
    out, times = [], 1
    common = _common(f, _derivative(f))
    once = _quotient(f, common)
    while len(once) > 1:
        shared = _common(once, common)
        own = _quotient(once, shared)
        if len(own) > 1:
            out.append((own, times))
        once, common, times = shared, _quotient(common, shared), times + 1
    return out


def _at(f: list[int], a: int, s: int) -> int:
    """Sign of f(a / 2^s)."""
    value = 0
    for i, c in enumerate(f):
        value = value * a + (c << (s * i))
    return (value > 0) - (value < 0)


def _above(f: list[int], a: int, s: int) -> int:
    """How many roots are over a / 2^s: as all roots are real, the changes of sign
    in the coefficients of f(x + a / 2^s)."""
    g = [c << (s * i) for i, c in enumerate(f)]
    for end in range(len(g), 1, -1):
        for i in range(1, end):
            g[i] += g[i - 1] * a
    signs = [c > 0 for c in g if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


@dataclass
class Root:
    """A root in (low, low + 1] / 2^shift of `factor`, occurring `times` times."""

    factor: list[int]
    times: int
    low: int
    shift: int

    def finer(self, bits: int) -> None:
        """Halves the interval `bits` times; the root is simple in its factor."""
        at_low = _at(self.factor, self.low, self.shift)
        if not at_low:  # low itself is outside, so the sign just above it counts
            at_low = _at(self.factor, 4 * self.low + 1, self.shift + 2)
        for _ in range(bits):
            self.low, self.shift = 2 * self.low, self.shift + 1
            middle = _at(self.factor, self.low + 1, self.shift)
            if middle == at_low:
                self.low += 1

    def bounds(self) -> tuple[Fraction, Fraction]:
        return Fraction(self.low, 1 << self.shift), Fraction(self.low + 1, 1 << self.shift)


def _isolated(f: list[int], times: int, wanted: int) -> Iterator[Root]:
    """The `wanted` largest positive roots of f, largest first, in intervals of their own."""
    top = (-(f[1] // f[0])).bit_length() + 1  # no root is larger than the sum of all
    # (low, high] / 2^shift of width 2^width
    todo = [(0, top, 0, _above(f, 0, 0), 0)]
    while todo and wanted:
        low, width, shift, over_low, over_high = todo.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if inside == 1:
            root = Root(f, times, low, shift)
            # narrows (low, low + 2^width] to a unit interval
            at_low = _at(f, low, shift) or _at(f, 4 * low + 1, shift + 2)
            for w in range(width - 1, -1, -1):
                if _at(f, root.low + (1 << w), shift) == at_low:
                    root.low += 1 << w
            wanted -= 1
            yield root
            continue
        if not width:
            low, width, shift = 2 * low, 1, shift + 1
        middle = low + (1 << (width - 1))
        over = _above(f, middle, shift)
        todo.append((low, width - 1, shift, over_low, over))
        todo.append((middle, width - 1, shift, over, over_high))


def largest_roots(f: list[int], wanted: int) -> list[Root]:
    """The largest positive roots of f, all of whose roots are real and none
    negative, until `wanted` are counted with repeats; each known to ROOT_BITS bits
    beyond its distance from the others and beyond its own size."""
    roots = [r for factor, times in square_free(f) for r in _isolated(factor, times, wanted + 1)]
    while True:
        roots.sort(key=lambda r: r.bounds(), reverse=True)
        close = {id(x) for a, b in zip(roots, roots[1:], strict=False) if b.bounds()[1] > a.bounds()[0] for x in (a, b)}
        if not close and all(r.low > 0 for r in roots):
            break
        for r in roots:
            if id(r) in close or r.low == 0:
                r.finer(1)
    for i, root in enumerate(roots):
        low, high = root.bounds()
        gaps = [roots[i - 1].bounds()[0] - high] if i else []
        gaps += [low - roots[i + 1].bounds()[1]] if i + 1 < len(roots) else []
        least = min([*gaps, low])
        # a gap may still be nothing but the width of an interval
        while least <= 0 or high - low > least / 2**ROOT_BITS:
            root.finer(8)
            low, high = root.bounds()
            gaps = [roots[i - 1].bounds()[0] - high] if i else []
            gaps += [low - roots[i + 1].bounds()[1]] if i + 1 < len(roots) else []
            if min([*gaps, low]) <= 0:
                for other in roots:
                    other.finer(8)
                low, high = root.bounds()
            least = min([*gaps, low])
    kept, count = [], 0
    for root in roots:
        if count >= wanted:
            break
        kept.append(root)
        count += root.times
    return kept


# Vectors


def null_space(matrix: list[list[int]], low: int, shift: int, times: int, seed: int = 0) -> np.ndarray:
    """Orthonormal vectors (rows, double) of the root in (low, low + 1] / 2^shift,
    which occurs `times` times, by inverse iteration in fixed point."""
    d = len(matrix)
    bits = 2 * (shift + ROOT_BITS) + max(1, max(abs(c) for row in matrix for c in row)).bit_length()
    shifted = np.array([[c << bits for c in row] for row in matrix], object)
    place = (2 * low + 1) << (bits - shift - 1)
    shifted[np.arange(d), np.arange(d)] -= place
    rows, order = shifted, np.arange(d)
    for k in range(d):
        r = k + int(np.argmax([abs(x) for x in rows[k:, k]]))
        if r != k:
            rows[[k, r]] = rows[[r, k]]
            order[[k, r]] = order[[r, k]]
        if rows[k, k] == 0:
            rows[k, k] = 1
        if k + 1 < d:
            factors = np.array([(x << bits) // rows[k, k] for x in rows[k + 1 :, k]], object)
            rows[k + 1 :, k + 1 :] -= (factors[:, None] * rows[k, k + 1 :]) >> bits
            rows[k + 1 :, k] = factors  # the lower factor takes the place of the zeros
    draw = np.random.default_rng(seed)
    vectors = [np.array([int(x) << bits for x in draw.integers(1, 1 << 20, d)], object) for _ in range(times)]
    for _ in range(ROUNDS):
        vectors = _orthonormal([_solved(rows, v[order], bits) for v in vectors], bits)
    return np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in vectors])


def _solved(rows: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    d, x = len(rows), right.copy()
    for k in range(d):
        x[k + 1 :] -= (rows[k + 1 :, k] * x[k]) >> bits
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] << bits) // rows[k, k]
        x[:k] -= (rows[:k, k] * x[k]) >> bits
    return x


def _orthonormal(vectors: list[np.ndarray], bits: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        v = (v << bits) // max(1, max(abs(x) for x in v))
        for _ in range(2):
            for u in out:
                v = v - ((u * (int((u * v).sum()) >> bits)) >> bits)
        length = isqrt(int((v * v).sum())) or 1
        out.append((v << bits) // length)
    return out
