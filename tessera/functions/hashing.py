"""Membership structures: fixed-size bloom filters and binary fuse filters."""

from __future__ import annotations

import base64
import binascii
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = (1 << 64) - 1


def bloom_bits(value: str, n_bytes: int, hashes: int) -> list[int]:
    """The bits that a value sets: XXH3-64 of its bytes and 0xFF, under seeds 0.. ."""
    return [xxhash.xxh3_64_intdigest(value.encode() + b"\xff", seed=k) % (n_bytes * 8) for k in range(hashes)]


@lru_cache(maxsize=1 << 16)
def _bloom_mask(value: str, n_bytes: int, hashes: int) -> int:
    """The bits that a value sets, as a number: bit b of a filter is bit b % 8 of its byte b // 8."""
    return sum(1 << b for b in set(bloom_bits(value, n_bytes, hashes)))


def bloom_build(values: list[str], n_bytes: int, hashes: int) -> bytes:
    """A filter that holds the values."""
    out = 0
    for v in values:
        out |= _bloom_mask(v, n_bytes, hashes)
    return out.to_bytes(n_bytes, "little")


def bloom_test(stored: Column, needles: list[str], n_bytes: int, hashes: int) -> Column:
    """Whether the stored filter may hold any needle: byte masks, no UDF."""

    def one(needle: str) -> Column:
        masks: dict[int, int] = {}
        for b in bloom_bits(needle, n_bytes, hashes):
            masks[b // 8] = masks.get(b // 8, 0) | 1 << (b % 8)
        test = F.lit(True)
        for at, mask in sorted(masks.items()):
            byte = F.conv(F.hex(F.substring(stored, at + 1, 1)), 16, 10).cast("int")
            test = test & (byte.bitwiseAND(F.lit(mask)) == mask)
        return test

    out = F.lit(False)
    for n in needles:
        out = out | one(n)
    return out & stored.isNotNull()


def _mix(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _WORD
    return x ^ (x >> 33)


@dataclass(frozen=True)
class Fuse8:
    """A three-wise binary fuse filter with one-byte fingerprints."""

    seed: int
    segment: int
    span: int
    fingerprints: bytes = field(repr=False)

    @staticmethod
    def decode(text: str) -> "Fuse8":
        """From canonical base 64; ValueError unless the header fits the body."""
        try:
            raw = base64.b64decode(text, validate=True)
        except (binascii.Error, ValueError) as e:
            raise ValueError("not base 64") from e
        if base64.b64encode(raw).decode() != text or len(raw) < 20:
            raise ValueError("not canonical base 64, or too short")
        seed, length, mask, n = struct.unpack_from("<QIII", raw)
        body = raw[20:]
        power = length > 0 and length & (length - 1) == 0
        if not (power and length <= 1 << 18 and mask == length - 1 and n > 0 and n % length == 0 and len(body) >= n + 2 * length):
            raise ValueError("the header does not fit the body")
        return Fuse8(seed, length, n, body)

    def encode(self) -> str:
        return base64.b64encode(struct.pack("<QIII", self.seed, self.segment, self.segment - 1, self.span) + self.fingerprints).decode()

    def places(self, value: str) -> tuple[int, int, int, int]:
        """A value's fingerprint and its three places."""
        h = _mix((xxhash.xxh3_64_intdigest(value.encode()) + self.seed) & _WORD)
        first = h * self.span >> 64
        mask = self.segment - 1
        return (h ^ h >> 32) & 0xFF, first, (first + self.segment) ^ (h >> 18 & mask), (first + 2 * self.segment) ^ (h & mask)

    def holds(self, value: str) -> bool:
        f, a, b, c = self.places(value)
        body = self.fingerprints
        return f == body[a] ^ body[b] ^ body[c]

    def holds_all(self, digests: np.ndarray) -> np.ndarray:
        """``holds`` for the XXH3-64 digests of many values at once."""
        with np.errstate(over="ignore"):
            h = digests + np.uint64(self.seed)
            for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ (h >> np.uint64(33))) * np.uint64(k)
            h ^= h >> np.uint64(33)
            # The upper 64 bits of h * span, whose second factor has 32 bits.
            span, half = np.uint64(self.span), np.uint64(32)
            first = ((h >> half) * span + ((h & np.uint64(0xFFFFFFFF)) * span >> half)) >> half
        mask, segment, body = np.uint64(self.segment - 1), np.uint64(self.segment), np.frombuffer(self.fingerprints, np.uint8)
        found = body[first] ^ body[(first + segment) ^ (h >> np.uint64(18) & mask)] ^ body[(first + segment + segment) ^ (h & mask)]
        return found == ((h ^ h >> half) & np.uint64(0xFF)).astype(np.uint8)

    @staticmethod
    def build(values: list[str], tries: int = 100) -> "Fuse8":
        """A filter for distinct values, by peeling; for clients and tests."""
        values = sorted(set(values))
        segment = 1 << max(2, min(18, int(np.log2(max(4, len(values) / 4)))))
        span = max(1, -(-int(1.3 * len(values) + 32) // segment)) * segment
        for seed in range(1, tries):
            empty = Fuse8(seed, segment, span, b"")
            places = {v: empty.places(v) for v in values}
            count, mixed = [0] * (span + 2 * segment), [0] * (span + 2 * segment)
            for i, v in enumerate(values):
                for p in places[v][1:]:
                    count[p] += 1
                    mixed[p] ^= i
            stack, ready = [], [p for p, n in enumerate(count) if n == 1]
            while ready:
                p = ready.pop()
                if count[p] != 1:
                    continue
                i = mixed[p]
                stack.append((i, p))
                for q in places[values[i]][1:]:
                    count[q] -= 1
                    mixed[q] ^= i
                    if count[q] == 1:
                        ready.append(q)
            if len(stack) == len(values):
                body = bytearray(span + 2 * segment)
                for i, p in reversed(stack):
                    f, a, b, c = places[values[i]]
                    body[p] = f ^ body[a] ^ body[b] ^ body[c] ^ body[p]
                return Fuse8(seed, segment, span, bytes(body))
        raise ValueError("no seed fits")


def set_test(text: Column, sets: list[Fuse8]) -> Column:
    """Whether any set may hold the text; looked up once per distinct value of a batch."""

    @F.pandas_udf("boolean")
    def look(s: pd.Series) -> pd.Series:
        values = s.dropna().unique()
        digests = np.fromiter((xxhash.xxh3_64_intdigest(v.encode()) for v in values), np.uint64, len(values))
        held = np.zeros(len(values), bool)
        for f in sets:
            held |= f.holds_all(digests)
        return s.isin(values[held])

    return look(text)


_DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = _DIGITS58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def is_base58(text: str) -> bool:
    return bool(text) and all(c in _DIGITS58 for c in text)


def base58_text(data: Column) -> Column:
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base58(bytes(x)))

    return text(data)
