"""The k-mer algebra as Column expressions.

A mer is a word of ``k`` digits below ``alpha``, encoded as a base-``alpha`` number whose most significant digit is the
leftmost. Alphabet and length are runtime values, so every expression holds plain literals that the
optimizer folds. Longs are used while alpha**k < 2**63; ``TextKmers`` works on digit strings of any length.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from math import cos, gcd, pi, sin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Coordinates nearer to an axis than this lie on it.
EPSILON = 1e-10


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column, b: int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, F.lit(b).cast("bigint")) if b != 1 else a


def ipow(base: int, exponent: int) -> int:
    return base**exponent


def bits_needed(alpha: int, k: int) -> int:
    """Bits that encode every number up to alpha**k."""
    return (alpha**k).bit_length()


def necklace_count(alpha: int, k: int) -> int:
    """Number of pure cycling registers, which is the size of every minimum decycling set."""
    return sum(alpha ** gcd(i, k) for i in range(1, k + 1)) // k


@dataclass(frozen=True)
class KmerSpace:
    """All words of ``k`` digits below ``alpha``."""

    alpha: int
    k: int

    def __post_init__(self) -> None:
        if self.alpha < 2 or self.k < 1:
            raise ValueError("alpha is at least 2 and k at least 1")
        if self.alpha**self.k >= 2**63:
            raise ValueError("alpha**k does not fit a long; use TextKmers")

    @property
    def size(self) -> int:
        """Number of mers."""
        return self.alpha**self.k

    @property
    def fmoves(self) -> int:
        """Number of (k-1)-mers."""
        return self.alpha ** (self.k - 1)

    def universe(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """Every mer, as column ``mer``."""
        return spark.range(0, self.size, 1, partitions).withColumnRenamed("id", "mer")

    # digits and neighbours -------------------------------------------------------------------

    def left_base(self, m) -> Column:
        return div(col(m), self.fmoves)

    def right_base(self, m) -> Column:
        return col(m) % self.alpha

    def rotate_next(self, m) -> Column:
        """The next word of the register: its first digit moves to the end."""
        return (col(m) % self.fmoves) * self.alpha + div(col(m), self.fmoves)

    def rotate_prev(self, m) -> Column:
        return div(col(m), self.alpha) + (col(m) % self.alpha) * self.fmoves

    def successor(self, m, base) -> Column:
        """Next node of the de Bruijn graph by ``base``; this order of operations cannot overflow."""
        return (col(m) % self.fmoves) * self.alpha + _base(base) % self.alpha

    def predecessor(self, m, base) -> Column:
        return div(col(m), self.alpha) + (_base(base) % self.alpha) * self.fmoves

    def suffix(self, m) -> Column:
        """The F-move of a mer: its last k-1 digits."""
        return col(m) % self.fmoves

    def prefix(self, m) -> Column:
        """The RF-move of a mer: its first k-1 digits."""
        return div(col(m), self.alpha)

    def are_left_companions(self, a, b) -> Column:
        return self.suffix(a) == self.suffix(b)

    def are_right_companions(self, a, b) -> Column:
        return self.prefix(a) == self.prefix(b)

    def left_companion(self, m, base) -> Column:
        return col(m) % self.fmoves + (_base(base) % self.alpha) * self.fmoves

    def right_companion(self, m, base) -> Column:
        return col(m) - col(m) % self.alpha + _base(base) % self.alpha

    def left_companions(self, fm) -> Column:
        """The mers with suffix ``fm``, as an array."""
        return F.array(*[col(fm) + b * self.fmoves for b in range(self.alpha)])

    def right_companions(self, fm) -> Column:
        """The mers with prefix ``fm``, as an array."""
        return F.array(*[col(fm) * self.alpha + b for b in range(self.alpha)])

    def successors(self, m) -> Column:
        return self.right_companions(self.suffix(m))

    def predecessors(self, m) -> Column:
        return self.left_companions(self.prefix(m))

    def homopolymer(self, base) -> Column:
        return (_base(base) * ((self.size - 1) // (self.alpha - 1))).cast("bigint")

    def is_homopolymer(self, m) -> Column:
        return self.rotate_next(m) == col(m)

    def is_homopolymer_fmove(self, fm) -> Column:
        return (col(fm) * self.alpha) % self.fmoves + col(fm) % self.alpha == col(fm)

    def digit(self, m, i: int) -> Column:
        """Digit ``i`` from the left."""
        return div(col(m), self.alpha ** (self.k - 1 - i)) % self.alpha

    def digits(self, m) -> list[Column]:
        return [self.digit(m, i) for i in range(self.k)]

    def subword(self, m, start: int, length: int) -> Column:
        return div(col(m), self.alpha ** (self.k - start - length)) % self.alpha**length

    def weight(self, m) -> Column:
        return reduce(Column.__add__, self.digits(m))

    def rotations(self, m) -> Column:
        """All k rotations, the mer itself first."""
        m, parts = col(m), []
        for i in range(self.k):
            low = self.alpha ** (self.k - i)
            parts.append((m % low) * self.alpha**i + div(m, low) if i else m)
        return F.array(*parts)

    def pcr(self, m) -> Column:
        """The register of a mer, named by its least word."""
        return F.array_min(self.rotations(m))

    # reverse complement ----------------------------------------------------------------------

    def reverse_complement(self, m) -> Column:
        terms = [(F.lit(self.alpha - 1) - self.digit(m, i)) * self.alpha**i for i in range(self.k)]
        return reduce(Column.__add__, terms).cast("bigint")

    def canonical(self, m) -> Column:
        return F.least(col(m), self.reverse_complement(m))

    def successor_rc(self, rc_of_first, base) -> Column:
        """Reverse complement of a successor from that of successor 0: it falls by k-1 places for each base."""
        return col(rc_of_first) - _base(base) * self.fmoves

    # text ------------------------------------------------------------------------------------

    def text(self, m) -> Column:
        """The word as k digits."""
        return F.lpad(F.conv(col(m).cast("string"), 10, self.alpha), self.k, "0")

    def of_text(self, text) -> Column:
        return F.conv(col(text), self.alpha, 10).cast("bigint")

    # pseudo-random order -----------------------------------------------------------------------

    def hashed(self, m, seed: int) -> Column:
        return F.xxhash64(col(m), F.lit(seed))

    def affine_permutation(self, m, factor: int, shift: int) -> Column:
        """A permutation of the space that plain SQL can repeat: (m * factor + shift) mod size."""
        if gcd(factor, self.size) != 1 or self.size * factor >= 2**63:
            raise ValueError("factor has a divisor in common with the size, or is too large")
        return (col(m) * factor + shift) % self.size

    # embedding -------------------------------------------------------------------------------

    def root_of_unity(self, i: int) -> tuple[float, float]:
        angle = 2 * pi * (i % self.k) / self.k
        return tuple(0.0 if abs(x) < EPSILON else x for x in (cos(angle), sin(angle)))  # type: ignore[return-value]

    def embedding(self, m, offset: int = 1) -> tuple[Column, Column]:
        """Real and imaginary part of the digits weighted by roots of unity; rotation turns it clockwise."""
        parts = []
        for axis in (0, 1):
            terms = [self.digit(m, self.k - 1 - i) * F.lit(self.root_of_unity(self.k + offset - 1 - i)[axis]) for i in range(self.k)]
            parts.append(reduce(Column.__add__, terms))
        return parts[0], parts[1]


def _base(b) -> Column:
    return F.lit(b).cast("bigint") if isinstance(b, int) else col(b).cast("bigint")


@dataclass(frozen=True)
class TextKmers:
    """The same algebra on strings over ``alphabet``, for words too long for a long."""

    alphabet: str
    k: int

    @property
    def complement(self) -> str:
        return self.alphabet[::-1]

    def rotate_next(self, s) -> Column:
        return F.concat(F.substring(col(s), 2, self.k), F.substring(col(s), 1, 1))

    def rotate_prev(self, s) -> Column:
        return F.concat(F.substring(col(s), self.k, 1), F.substring(col(s), 1, self.k - 1))

    def successors(self, s) -> Column:
        return F.array(*[F.concat(F.substring(col(s), 2, self.k), F.lit(c)) for c in self.alphabet])

    def predecessors(self, s) -> Column:
        return F.array(*[F.concat(F.lit(c), F.substring(col(s), 1, self.k - 1)) for c in self.alphabet])

    def reverse_complement(self, s) -> Column:
        return F.reverse(F.translate(col(s), self.alphabet, self.complement))

    def canonical(self, s) -> Column:
        """For letters in alphabetical order this is the canonical mer."""
        return F.least(col(s), self.reverse_complement(s))

    def rotations(self, s) -> Column:
        return F.array(*[F.concat(F.substring(col(s), i + 1, self.k), F.substring(col(s), 1, i)) for i in range(self.k)])

    def pcr(self, s) -> Column:
        return F.array_min(self.rotations(s))

    def weight(self, s) -> Column:
        sizes: Iterable[Column] = (F.length(F.regexp_replace(col(s), f"[^{c}]", "")) * i for i, c in enumerate(self.alphabet))
        return reduce(Column.__add__, sizes)


def transposition(text, *pairs: str) -> Column:
    """Letters swapped in pairs, such as ("AT", "CG")."""
    return F.translate(col(text), "".join(p[0] + p[1] for p in pairs), "".join(p[1] + p[0] for p in pairs))


def feistel(x, round_key: int, half: int = 16) -> Column:
    """One Feistel round on the low 2 * half bits."""
    mask = (1 << half) - 1
    left, right = F.shiftright(col(x), half), col(x).bitwiseAND(F.lit(mask))
    mixed = F.xxhash64(right, F.lit(round_key)).bitwiseAND(F.lit(mask))
    return F.shiftleft(right, half).bitwiseOR(left.bitwiseXOR(mixed))


def pseudo_random_permutation(x, seed: int, half: int = 16, rounds: int = 4) -> Column:
    """A Luby-Rackoff permutation of the numbers of 2 * half bits."""
    return reduce(lambda y, r: feistel(y, seed * 16 + r, half), range(rounds), col(x))


def feistel_order(x, seed: int, half: int, rounds: int = 4) -> Column:
    """The permutation of ``arrays.feistel_order`` as a column: a Luby-Rackoff permutation of the numbers of 2 * half bits whose rounds are plain
    arithmetic. An even alphabet's words of length 2 * half / log2(alpha) are permuted among themselves."""
    mask = (1 << half) - 1
    out = col(x)
    for r in range(rounds):
        left, right = F.shiftright(out, half), out.bitwiseAND(F.lit(mask).cast("bigint"))
        mixed = div(right * 40503 + (seed * 9176 + r * 7919), 8).bitwiseAND(F.lit(mask).cast("bigint"))
        out = F.shiftleft(right, half).bitwiseOR(left.bitwiseXOR(mixed))
    return out
