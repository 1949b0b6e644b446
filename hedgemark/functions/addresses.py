"""Column expressions that classify IP addresses.

The ranges are a short fixed list, so they are compared in place: no join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgemark.config import V4_RANGES, V6_RANGES
from hedgemark.functions.hosts import QUAD


def v4_number(address: Column) -> Column:
    """A dotted quad as one number, else null."""
    value = F.aggregate(
        F.split(address, r"\."),
        F.lit(0).cast("bigint"),
        lambda acc, part: acc * F.lit(256) + part.cast("bigint"),
    )
    return F.when(address.rlike(QUAD), value)


def _v4_bound(address: str) -> int:
    return reduce(lambda acc, part: acc * 256 + int(part), address.split("."), 0)


def _v6_words(address: Column) -> Column:
    """A version 6 address with an embedded quad written as two words."""
    quad = F.regexp_extract(address, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    digits = F.lpad(F.lower(F.hex(v4_number(quad))), 8, "0")
    words = F.concat(F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
    return F.when(address.contains("."), F.concat(F.regexp_replace(address, r"[0-9]+(?:\.[0-9]+){3}$", ""), words)).otherwise(address)


def _full_words(text: Column) -> Column:
    """The words of an address, a ``::`` filled up to eight."""
    words_of = lambda part: F.filter(F.split(part, ":"), lambda w: w != "")
    head, tail = words_of(F.substring_index(text, "::", 1)), words_of(F.substring_index(text, "::", -1))
    none = F.array().cast("array<string>")
    tail = F.when(text.contains("::"), tail).otherwise(none)
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))
    return F.concat(head, gap, tail)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def _six_bits(text: Column) -> Column:
    """The bits of a version 6 address after a 6, of a wrapped version 4 one after a 4; null for text that is none."""
    def told(six: Column, words: Column) -> Column:
        given = F.size(F.filter(F.split(six, ":"), lambda w: w != ""))
        full = six.contains("::") & (given < 8) | (F.size(F.split(six, ":")) == 8)
        return full & ~six.rlike("::.*::|:::|^:[^:]|[^:]:$") & (F.size(words) == 8) & F.forall(words, lambda w: w.rlike("^[0-9a-f]{1,4}$"))

    half = lambda digits, at: F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0")
    spelt = lambda digits: F.when(
        digits.startswith("0" * 20 + "ffff"), F.concat(F.lit("4"), F.lpad(F.conv(F.substring(digits, 25, 8), 16, 2), 32, "0"))
    ).otherwise(F.concat(F.lit("6"), half(digits, 1), half(digits, 17)))
    digits = lambda words: F.array_join(F.transform(words, lambda w: F.lpad(w, 4, "0")), "")
    return once(_v6_words(F.lower(text)), lambda six: once(
        _full_words(six), lambda words: F.when(told(six, words), once(digits(words), spelt))))


def address_bits(address: Column) -> Column:
    """The bits of an address as text after its family (4 or 6), null for text that is none; a wrapped version 4 address is one of version 4."""
    return F.when(address.contains(":"), _six_bits(address)).otherwise(F.concat(F.lit("4"), F.lpad(F.bin(v4_number(address)), 32, "0")))


def address_classes(addresses: Column, allow_loopback: bool = False) -> Column:
    """For each address why it is not public, or ``public``; ``invalid`` for text that is none and for null.

    A version 6 address that wraps a version 4 one is judged as the latter.
    """
    parsed = F.transform(addresses, lambda a: F.struct(
        v4_number(a).alias("v4"), F.when(a.contains(":"), _full_words(_v6_words(F.lower(a)))).alias("words"),
    ))
    numbers = F.transform(parsed, lambda s: F.struct(
        s["v4"].alias("v4"),
        F.when(F.size(s["words"]) == 8, F.array_join(F.transform(s["words"], lambda w: F.lpad(w, 4, "0")), "")).alias("v6"),
    ))
    unwrapped = F.transform(numbers, lambda s: F.struct(
        F.when(s["v6"].startswith("0" * 20 + "ffff"), F.conv(F.substring(s["v6"], 25, 8), 16, 10).cast("bigint"))
        .otherwise(s["v4"]).alias("v4"),
        s["v6"].alias("v6"),
    ))

    def judge(s: Column) -> Column:
        rules = [(kind, s["v4"].between(_v4_bound(lo), _v4_bound(hi))) for kind, lo, hi in V4_RANGES]
        rules += [(kind, s["v4"].isNull() & s["v6"].between(lo, hi)) for kind, lo, hi in V6_RANGES]
        result = F.when(s["v4"].isNull() & s["v6"].isNull(), "invalid")
        for kind, test in rules:
            result = result.when(test, F.lit("public" if allow_loopback and kind == "loopback" else kind))
        return result.otherwise("public")

    return F.transform(unwrapped, judge)


def has_blocked_address(addresses: Column, allow_loopback: bool = False) -> Column:
    """True if any address of the array must not be contacted, or there is none that could be.

    Text that is no address, a missing address and a missing or empty array count as blocked.
    """
    blocked = F.exists(address_classes(addresses, allow_loopback), lambda c: c != "public")
    return F.coalesce(blocked | (F.size(addresses) == 0), F.lit(True))
