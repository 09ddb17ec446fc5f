"""Counting quotient filters over n-grams of word ids: lossless counters in little more than the bits that tell keys apart.

The n ids of a gram, ``bits`` each, go through an invertible permutation (a Feistel network over the ids), so any gram looks random and comes back exactly.
The first bits of the permuted gram name a shard, the next ones are its quotient in the shard's filter, all others its remainder.
A filter holds its grams in order: a bit set of the quotients that occur, a bit for each gram that ends the run of its quotient, the remainders
in whole bytes, and the counters, a byte each with larger ones in a list of their own. As filters are in order, those of many tasks are merged by
merging, and a quotient's run is found by rank and select.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_ROUNDS = 2


@dataclass(frozen=True)
class Grams:
    """Grams of ``n`` ids below 2 ** ``bits``, permuted and packed in limbs of 64 bits; the first limb has the leading ids."""

    n: int
    bits: int

    @property
    def per_limb(self) -> int:
        return 64 // self.bits

    @property
    def widths(self) -> list[int]:
        """Bits in use of each limb."""
        return [self.bits * len(range(self.n)[i : i + self.per_limb]) for i in range(0, self.n, self.per_limb)]

    def _mixed(self, x: np.ndarray, step: int) -> np.ndarray:
        x = (x + _U(step + 1) * _U(0xD1B54A32D192ED03 & (1 << 58) - 1)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return (x ^ (x >> _U(29))) >> _U(64 - self.bits)

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of the grams whose i-th ids are ``ids[i]``."""
        words = [x.astype(_U) for x in ids]
        for step in range(_ROUNDS * self.n):
            words[step % self.n] = words[step % self.n] ^ self._mixed(words[step % self.n - 1], step)
        limbs = []
        for i in range(0, self.n, self.per_limb):
            limb = words[i]
            for word in words[i + 1 : i + self.per_limb]:
                limb = (limb << _U(self.bits)) | word
            limbs.append(limb)
        return limbs

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        words = []
        for limb, width in zip(limbs, self.widths, strict=True):
            k = width // self.bits
            words += [(limb >> _U(self.bits * (k - 1 - j))) & _U((1 << self.bits) - 1) for j in range(k)]
        for step in reversed(range(_ROUNDS * self.n)):
            words[step % self.n] = words[step % self.n] ^ self._mixed(words[step % self.n - 1], step)
        return words

    def shard(self, limbs: list[np.ndarray], shard_bits: int) -> np.ndarray:
        return (limbs[0] >> _U(self.widths[0] - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(limbs[0]), np.int64)


def collapse(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with summed counts (1 each by default). Parts that are in order already are merged, not sorted anew."""
    if not len(limbs[0]):
        return limbs, np.zeros(0, np.int64)
    if len(limbs) == 1 and counts is None:
        limbs = [np.sort(limbs[0])]
    else:
        order = np.lexsort(limbs[::-1]) if len(limbs) > 1 else np.argsort(limbs[0], kind="stable")
        limbs, counts = [x[order] for x in limbs], None if counts is None else counts[order]
    new = np.ones(len(limbs[0]), bool)
    new[1:] = False
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(new))) if counts is None else np.add.reduceat(counts, first)
    return [x[first] for x in limbs], sums.astype(np.int64)


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little")


class CountingQuotientFilter:
    """A filter of one shard; ``shard_bits`` leading bits are the same in all its keys and aren't stored."""

    def __init__(self, grams: Grams, shard: int, shard_bits: int, q: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counters: np.ndarray, large: np.ndarray):
        self.grams, self.shard, self.shard_bits, self.q = grams, shard, shard_bits, q
        self.occupied, self.run_ends, self.remainders, self.counters, self.large = occupied, run_ends, remainders, counters, large
        self._runs = None

    @property
    def low(self) -> int:
        """Bits of the first limb that are in the remainder."""
        return self.grams.widths[0] - self.shard_bits - self.q

    @classmethod
    def build(cls, grams: Grams, limbs: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> CountingQuotientFilter:
        """From the distinct keys of one shard in order."""
        n, free = len(counts), grams.widths[0] - shard_bits
        # about a quotient a key, and whole bytes of remainder
        q = min(range(free % 8, free + 1, 8), key=lambda x: abs(x - max(n, 1).bit_length()))
        self = cls(grams, int(grams.shard([limbs[0][:1]], shard_bits)[0]) if n else 0, shard_bits, q, None, None, None, None, None)
        quotient = ((limbs[0] >> _U(self.low)) & _U((1 << q) - 1)).astype(np.int64) if self.low < 64 else np.zeros(n, np.int64)
        flags = np.zeros(1 << q, bool)
        flags[quotient] = True
        self.occupied = _bits(flags)
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        self.run_ends = _bits(ends)
        used = [self.low // 8, *[-(-w // 8) for w in grams.widths[1:]]]
        self.remainders = np.concatenate([np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :k] for x, k in zip(limbs, used, strict=True)], axis=1)
        self.counters = np.where(counts > 255, 0, counts).astype(np.uint8)
        self.large = counts[counts > 255].astype(np.int64)
        return self

    def keys(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(limbs, counts) in order."""
        n = len(self.counters)
        ends = np.unpackbits(self.run_ends, count=n, bitorder="little").astype(bool)
        quotient = np.flatnonzero(np.unpackbits(self.occupied, bitorder="little"))[np.cumsum(ends) - ends]
        limbs = self._limbs(self.remainders)
        if self.low < 64:
            limbs[0] |= quotient.astype(_U) << _U(self.low)
            if self.shard_bits:
                limbs[0] |= _U(self.shard) << _U(self.low + self.q)
        counts = self.counters.astype(np.int64)
        counts[counts == 0] = self.large
        return limbs, counts

    def _limbs(self, remainders: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for k in [self.low // 8, *[-(-w // 8) for w in self.grams.widths[1:]]]:
            wide = np.zeros((len(remainders), 8), np.uint8)
            wide[:, :k] = remainders[:, at : at + k]
            out.append(wide.view("<u8").reshape(-1).astype(_U))
            at += k
        return out

    def has(self, limbs: list[np.ndarray]) -> np.ndarray:
        """Whether the filter holds each of these keys of its shard: the run of its quotient is gone through."""
        if self._runs is None:
            ends = np.flatnonzero(np.unpackbits(self.run_ends, count=len(self.counters), bitorder="little")) + 1
            taken = np.unpackbits(self.occupied, bitorder="little").astype(np.int32)
            self._runs = np.append(0, ends).astype(np.int64), np.cumsum(taken) - taken, taken.astype(bool), self._limbs(self.remainders)
        starts, rank, taken, stored = self._runs
        quotient = ((limbs[0] >> _U(self.low)) & _U((1 << self.q) - 1)).astype(np.int64) if self.low < 64 else np.zeros(len(limbs[0]), np.int64)
        rest = [limbs[0] & _U((1 << self.low) - 1), *limbs[1:]]
        out, open_ = np.zeros(len(quotient), bool), np.flatnonzero(taken[quotient])
        at, end = starts[rank[quotient[open_]]], starts[rank[quotient[open_]] + 1]
        while len(open_):
            same = np.ones(len(open_), bool)
            for x, own in zip(rest, stored, strict=True):
                same &= x[open_] == own[at]
            out[open_[same]] = True
            at = at + 1
            left = ~same & (at < end)
            open_, at, end = open_[left], at[left], end[left]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        head = np.array([self.grams.n, self.grams.bits, self.shard, self.shard_bits, self.q, len(self.counters)], np.int64)
        return {"head": head, "occupied": self.occupied, "run_ends": self.run_ends, "remainders": self.remainders, "counters": self.counters, "large": self.large}

    @classmethod
    def of_arrays(cls, get) -> CountingQuotientFilter:
        n, bits, shard, shard_bits, q, _ = get("head").tolist()
        return cls(Grams(n, bits), shard, shard_bits, q, *(get(k) for k in ("occupied", "run_ends", "remainders", "counters", "large")))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.occupied, self.run_ends, self.remainders, self.counters, self.large))

    def dump(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in self.arrays().values())

    @classmethod
    def parse(cls, raw: bytes) -> CountingQuotientFilter:
        n, bits, shard, shard_bits, q, size = np.frombuffer(raw, np.int64, 6).tolist()
        grams, at = Grams(n, bits), 48

        def take(count: int) -> np.ndarray:
            nonlocal at
            at += count
            return np.frombuffer(raw, np.uint8, count, at - count)

        low = grams.widths[0] - shard_bits - q
        width = low // 8 + sum(-(-w // 8) for w in grams.widths[1:])
        occupied, run_ends, remainders, counters = take(-(-(1 << q) // 8)), take(-(-size // 8)), take(size * width).reshape(size, width), take(size)
        return cls(grams, shard, shard_bits, q, occupied, run_ends, remainders, counters, np.frombuffer(take(8 * int((counters == 0).sum())).tobytes(), np.int64))
