"""Checks of closed-form answers, each recomputed from its statement, in a registry that tasks run."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal, getcontext
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS: dict[str, Callable[[], bool]] = {}


def check(name: str):
    """Registers a check under an id; an id may be used once."""

    def register(f: Callable[[], bool]) -> Callable[[], bool]:
        if name in CHECKS:
            raise ValueError(f"a check's id is used twice: {name}")
        CHECKS[name] = f
        return f

    return register


def run(spark: SparkSession, checks: dict[str, Callable[[], bool]] | None = None) -> DataFrame:
    """(id, status, note): pass or fail of each check, run in tasks; a check that raises fails with the error as its note."""
    todo = CHECKS if checks is None else checks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    rows.append((name, "pass" if todo[name]() else "fail", None))
                except Exception as e:  # whatever a check raises is its failure
                    rows.append((name, "fail", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["id", "status", "note"])

    return spark.createDataFrame([(n,) for n in sorted(todo)], "id string").repartition(max(1, min(len(todo), 8))).mapInArrow(work, "id string, status string, note string")


def checked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, id, status, note) of rows that name a check each: as in run(), a task runs each check once; an unknown one fails."""
    todo = dict(CHECKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[str, str | None]] = {}

        def result(one: str | None) -> tuple[str, str | None]:
            if one not in known:
                try:
                    known[one] = ("pass" if todo[one]() else "fail", None)
                except Exception as e:  # whatever a check raises is its failure
                    known[one] = ("fail", f"{type(e).__name__}: {e}")
            return known[one]

        for batch in batches:
            found = [result(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[k] for f in found], pa.string()) for k in range(2)]], [key, "id", "status", "note"])

    given = rows.select(F.col(key), F.col(name).alias("id"))
    return given.mapInArrow(work, f"`{key}` {given.schema[0].dataType.simpleString()}, id string, status string, note string")


def _times(a: list[int], b: list[int]) -> list[int]:
    """Product of polynomials by coefficients, the lowest first."""
    out = [0] * (len(a) + len(b) - 1)
    for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)):
        out[i + j] += x * y
    return out


@check("A-002")
def _sum_of_powers() -> bool:
    """Three numbers of sum 3 with equal sums of cubes and of fourth powers are all 1: x^4 - x^3 - x + 1 is (x - 1)^2 times a form without real roots."""
    same = _times(_times([-1, 1], [-1, 1]), [1, 1, 1]) == [1, -1, 0, -1, 1]
    return same and 1 - 4 < 0 and sum([1] * 3) == 3


@check("A-003")
def _on_the_line() -> bool:
    """x^2 + y^2 + x + y - xy(x + y) + 10/27 = 0 with |xy| <= 25/9 has only (-1/3, -1/3) and (5/3, 5/3)."""
    f = lambda x, y: x * x + y * y + x + y - x * y * (x + y) + Fraction(10, 27)
    # On x = y, times 27: -54 x^3 + 54 x^2 + 54 x + 10. Rational roots have a numerator of 10 and a denominator of 54.
    tried = {Fraction(s * p, q) for p in (1, 2, 5, 10) for q in (1, 2, 3, 6, 9, 18, 27, 54) for s in (1, -1)}
    roots = {x for x in tried if f(x, x) == 0}
    double = _times(_times([1, 3], [1, 3]), [5, -3])  # (3x + 1)^2 (5 - 3x), all roots of the cubic
    whole = [2 * c for c in double] == [10, 54, 54, -54]
    # Off the line: the quadratic in y for a grid of x; a root within the bound must be one of the two points.
    for k in range(-300, 301):
        x = k / 100
        a, b, c = 1 - x, 1 - x * x, x * x + x + 10 / 27
        d = b * b - 4 * a * c
        for y in ([(-b + s * math.sqrt(d)) / (2 * a) for s in (1, -1)] if a and d >= 0 else []):
            if abs(x * y) < 25 / 9 - 1e-9 and max(abs(x + 1 / 3), abs(y + 1 / 3)) > 0.02 and abs(x - y) > 0.02:
                return False
    return whole and roots == {Fraction(-1, 3), Fraction(5, 3)}


@check("A-005")
def _between_arcs() -> bool:
    """The area between arccos and arcsin from 0 to 1/sqrt(2) is 2 - sqrt(2): by its antiderivative and by Simpson's rule."""
    whole = lambda x: x * math.acos(x) - x * math.asin(x) - 2 * math.sqrt(1 - x * x)
    end, n = 1 / math.sqrt(2), 2000
    f = lambda x: math.acos(x) - math.asin(x)
    simpson = sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(end * k / n) for k in range(n + 1)) * end / n / 3
    return abs(whole(end) - whole(0.0) - (2 - math.sqrt(2))) < 1e-12 and abs(simpson - (2 - math.sqrt(2))) < 1e-10


def _sine(x: Decimal) -> Decimal:
    term, total, k = x, x, 1
    while abs(term) > Decimal(10) ** -70:
        term *= -x * x / ((k + 1) * (k + 2))
        total, k = total + term, k + 2
    return total


@lru_cache(maxsize=1)
def _pi() -> Decimal:
    """By Machin's formula, to 70 places."""
    getcontext().prec = 80

    def arctan_of_inverse(n: int) -> Decimal:
        term, total, k = Decimal(1) / n, Decimal(1) / n, 1
        while term > Decimal(10) ** -75:
            term /= n * n
            total, k = total + (term if k % 2 == 0 else -term) / (2 * k + 1), k + 1
        return total

    return 4 * (4 * arctan_of_inverse(5) - arctan_of_inverse(239))


@check("A-012")
def _twenty_degrees() -> bool:
    """sqrt(3) / sin 20° - 1 / cos 20° = 4, to 50 places."""
    getcontext().prec = 80
    d = _pi() / 9
    return abs(Decimal(3).sqrt() / _sine(d) - 1 / _sine(_pi() / 2 - d) - 4) < Decimal(10) ** -50


@check("A-022")
def _nine_tenths() -> bool:
    """On x + y + z = -1, |sum of cubes + 1| <= 9/10 |sum of fifth powers + 1|: equal at -1/3, and nowhere over among 20,000 points."""
    power = lambda p, n: abs(sum(x**n for x in p) + 1)
    third, rng = [Fraction(-1, 3)] * 3, random.Random(7)
    if power(third, 3) / power(third, 5) != Fraction(9, 10):
        return False
    for _ in range(20000):
        reach = 10 ** rng.uniform(-2, 2)
        x, y = (Fraction(round(rng.uniform(-reach, reach) * 10**4), 10**4) for _ in range(2))
        p = (x, y, -1 - x - y)
        if 10 * power(p, 3) > 9 * power(p, 5):
            return False
    return True


@check("A-026")
def _concave_sequences() -> bool:
    """(sum i a_i)^2 >= n (n + 1)^2 / 4 sum a_i^2 for concave increasing sequences: at the cone's rays min(i, k), and at random."""
    ratio = lambda a: Fraction(sum(i * x for i, x in enumerate(a, 1)) ** 2, sum(x * x for x in a))
    bound = lambda n: Fraction(n * (n + 1) ** 2, 4)
    for n in range(2, 41):
        rays = [ratio([min(i, k) for i in range(1, n + 1)]) for k in range(1, n + 1)]
        if rays[0] != bound(n) or min(rays) != bound(n):
            return False
    rng = random.Random(7)
    sequences = (list(itertools.accumulate(sorted((rng.randint(1, 100) for _ in range(rng.randint(2, 10))), reverse=True))) for _ in range(2000))
    return all(ratio(a) >= bound(len(a)) for a in sequences)


@check("A-030")
def _periods() -> bool:
    """cos(nx) sin(2009x / n^2) has the period 3 pi just for n = 1 and 7: by divisors, and by value for n up to 100."""
    divisors = {n for n in range(1, 6028) if 6027 % (n * n) == 0}
    f = lambda n, x: math.cos(n * x) * math.sin(2009 * x / (n * n))
    points = [0.317, 1.234, 2.718, 4.669, 7.389, 11.32]
    return divisors == {n for n in range(1, 101) if all(abs(f(n, x + 3 * math.pi) - f(n, x)) < 1e-8 for x in points)} == {1, 7}


@check("C-005")
def _pointing() -> bool:
    """Five people each point at two others; three point at each other in 5/108 of the 6^5 cases."""
    others = [[frozenset(p) for p in itertools.combinations([q for q in range(5) if q != k], 2)] for k in range(5)]
    triples = [frozenset(t) for t in itertools.combinations(range(5), 3)]
    hits = sum(any(all(t - {k} <= picked[k] for k in t) for t in triples) for picked in itertools.product(*others))
    return Fraction(hits, 6**5) == Fraction(5, 108)


@check("C-010")
def _painted_cubes() -> bool:
    """Ten ways to paint a cube's faces in two colours up to rotation: by fixed points of the 24 rotations, and by orbits."""
    # A rotation permutes the axes with signs; those of determinant 1 move the faces (axis, sign).
    faces = [(a, s) for a in range(3) for s in (1, -1)]
    turns = []
    for axes in itertools.permutations(range(3)):
        parity = sum(axes[i] > axes[j] for i, j in itertools.combinations(range(3), 2)) % 2
        for signs in itertools.product((1, -1), repeat=3):
            if math.prod(signs) == (1, -1)[parity]:
                turns.append([faces.index((axes[a], s * signs[a])) for a, s in faces])
    paints = list(itertools.product((0, 1), repeat=6))
    fixed = sum(all(p[t[k]] == p[k] for k in range(6)) for t in turns for p in paints)
    orbits = {min(tuple(p[k] for k in t) for t in turns) for p in paints}
    return len(turns) == 24 and fixed == 24 * 10 and len(orbits) == 10


@check("C-014")
def _digit_sums() -> bool:
    """53 cards from 100 to 999 are needed for three of one digit sum."""
    sums = Counter(n // 100 + n // 10 % 10 + n % 10 for n in range(100, 1000))
    return sum(min(2, c) for c in sums.values()) + 1 == 53


@check("C-015")
def _jury() -> bool:
    """At most 2^n - n - 1 moves of a card i from place p >= i by i places to the front, for n up to 5."""

    @lru_cache(maxsize=None)
    def longest(order: tuple[int, ...]) -> int:
        moves = [(p, i) for p, i in enumerate(order) if p >= i]
        return max((1 + longest((*(rest := order[:p] + order[p + 1 :])[: p - i], i, *rest[p - i :])) for p, i in moves), default=0)

    return all(max(map(longest, itertools.permutations(range(1, n + 1)))) == 2**n - n - 1 for n in range(2, 6))


@check("C-038")
def _board() -> bool:
    """A board of 2020 ends with 1023: a stable board is one of 2^k - 1, both by the vote from one member up and by that rule."""
    stable = 1
    for n in range(2, 2021):
        stable = n if 2 * (n - stable) > n else stable
    return stable == 1023 == max(2**k - 1 for k in range(1, 12) if 2**k - 1 <= 2020)


@check("G-005")
def _dodecahedron() -> bool:
    """100 inner diagonals of a dodecahedron: pairs of its corners that share no face, from Euler's count of them."""
    faces, sides = 12, 5
    edges = faces * sides // 2
    corners = 2 + edges - faces
    return corners == 20 and math.comb(corners, 2) - edges - faces * (math.comb(sides, 2) - sides) == 100
