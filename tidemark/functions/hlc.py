"""Hybrid logical clocks: 48 bits of milliseconds and a 16-bit counter.

Columns hold them as ``struct<wall_ms bigint, counter int>``, which orders as the
clock does for the whole 64-bit range; on the wire they are ``0x`` and hexadecimal
digits.  Events are ordered by (clock, site).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HLC = "struct<wall_ms:bigint,counter:int>"
WALL_LIMIT, COUNTER_LIMIT = 1 << 48, 1 << 16
MAX_DRIFT_MS = 60_000
_HEX = re.compile(r"0x[0-9a-fA-F]{1,16}")


class ClockError(ValueError):
    """A clock out of range, ahead of its bound, or not increasing."""


@dataclass(frozen=True, order=True)
class Hlc:
    wall_ms: int
    counter: int

    def __post_init__(self):
        if not 0 <= self.wall_ms < WALL_LIMIT or not 0 <= self.counter < COUNTER_LIMIT:
            raise ClockError(f"clock out of range: {self.wall_ms}, {self.counter}")

    def packed(self) -> int:
        return self.wall_ms << 16 | self.counter

    def hex(self) -> str:
        return hex(self.packed())

    @classmethod
    def from_packed(cls, packed: int) -> Hlc:
        return cls(packed >> 16, packed & 0xFFFF)

    @classmethod
    def from_hex(cls, text: str) -> Hlc:
        if not is_hex(text):
            raise ClockError(f"no clock: {text!r}")
        return cls.from_packed(int(text, 16))


def is_hex(text: object) -> bool:
    return isinstance(text, str) and _HEX.fullmatch(text) is not None


def monotonic_wall() -> Callable[[], int]:
    """Milliseconds since 1970 that follow the monotonic clock from now on."""
    start, anchor = time.time(), time.monotonic()
    return lambda: int((start + time.monotonic() - anchor) * 1000)


class Clock:
    """A site's clock: ``tick`` for its own events, ``receive`` for those of others."""

    def __init__(self, wall: Callable[[], int] | None = None, last: Hlc | None = None, max_drift_ms: int = MAX_DRIFT_MS):
        self.wall, self.last, self.max_drift_ms = wall or monotonic_wall(), last, max_drift_ms

    def _check(self, wall_ms: int, now: int) -> None:
        if wall_ms > now + self.max_drift_ms:
            raise ClockError(f"clock is {wall_ms - now} ms ahead; {self.max_drift_ms} are allowed")

    @staticmethod
    def _after(wall_ms: int, counter: int) -> Hlc:
        return Hlc(wall_ms, counter) if counter < COUNTER_LIMIT else Hlc(wall_ms + 1, 0)

    def tick(self) -> Hlc:
        now, last = self.wall(), self.last
        if last is None or now > last.wall_ms:
            new = Hlc(now, 0)
        else:
            new = self._after(last.wall_ms, last.counter + 1)
        self._check(new.wall_ms, now)
        self.last = new
        return new

    def receive(self, other: Hlc) -> Hlc:
        now, last = self.wall(), self.last or Hlc(0, 0)
        self._check(other.wall_ms, now)
        top = max(now, last.wall_ms, other.wall_ms)
        counters = [c.counter for c in (last, other) if c.wall_ms == top and (c is other or self.last is not None)]
        new = self._after(top, max(counters) + 1) if counters else Hlc(top, 0)
        self._check(new.wall_ms, now)
        self.last = new
        return new


def check_increasing(clocks: Iterable[Hlc]) -> None:
    before = None
    for c in clocks:
        if before is not None and c <= before:
            raise ClockError(f"clock does not increase: {before} then {c}")
        before = c


class Fence:
    """Refuses clocks that are not above the highest one it has let through."""

    def __init__(self, high: Hlc | None = None):
        self.high = high

    def accept(self, clock: Hlc) -> None:
        if self.high is not None and clock <= self.high:
            raise ClockError(f"{clock} is not above {self.high}")
        self.high = clock


def struct(wall_ms: Column, counter: Column) -> Column:
    return F.struct(wall_ms.cast("bigint").alias("wall_ms"), counter.cast("int").alias("counter"))


def to_hex(c: Column) -> Column:
    """The wire form; exact for the whole unsigned range, since the parts are put
    together as digits."""
    low = F.lower(F.lpad(F.hex(c["counter"].cast("bigint")), 4, "0"))
    both = F.concat(F.lower(F.hex(c["wall_ms"])), low)
    return F.concat(F.lit("0x"), F.coalesce(F.nullif(F.regexp_replace(both, "^0+", ""), F.lit("")), F.lit("0")))


def valid_hex(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[0-9a-fA-F]{1,16}$"), F.lit(False))


def from_hex(c: Column) -> Column:
    digits = F.lpad(F.substring(c, 3, 16), 16, "0")
    part = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10)
    return F.when(valid_hex(c), struct(part(1, 12), part(13, 4)))


def event(c: Column, site: Column) -> Column:
    """What events are ordered by."""
    return F.struct(c["wall_ms"].alias("wall_ms"), c["counter"].alias("counter"), site.alias("site"))


def packed(c: Column) -> Column:
    """One BIGINT that orders as the clock does while wall_ms is below 2**47."""
    return F.shiftleft(c["wall_ms"], 16) + c["counter"].cast("bigint")


def within_drift(c: Column, now_ms: int, max_drift_ms: int = MAX_DRIFT_MS) -> Column:
    return c["wall_ms"] <= F.lit(now_ms + max_drift_ms)
