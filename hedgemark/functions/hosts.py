"""Column expressions for host names and registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgemark.config import TWO_LABEL_SUFFIXES

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_NUMERIC = r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}$"
_V6 = r"^[0-9a-f]*:[0-9a-f]*:[0-9a-f:.]*$"


def trimmed(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def host_text(host: Column) -> Column:
    """Lower case, no final dots, no brackets, no zone id."""
    lowered = F.regexp_replace(F.lower(trimmed(host)), r"\.+\z", "")
    return F.substring_index(F.regexp_replace(lowered, r"(?s)^\[(.*?)\]*\z", "$1"), "%", 1)


def is_plain_host(text: Column) -> Column:
    """True for ASCII names and dotted quads, which need no further encoding."""
    return text.rlike(r"^[a-z0-9._-]+$") & (~text.rlike(_NUMERIC) | text.rlike(QUAD))


def is_usable_host(text: Column) -> Column:
    """A host that can be kept: not empty and free of blanks and tabs."""
    return (text != "") & ~text.rlike(r"[ \t]")


def is_address(host: Column) -> Column:
    """True for a canonical IP literal."""
    return host.rlike(QUAD) | host.rlike(_V6)


def _domain_of_tidy(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return (
        F.when(~host.contains(".") | is_address(host), host)
        .when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(two)
    )


def registrable_domain(host: Column) -> Column:
    """Last two labels of a normal host, or three below a two-label suffix.

    Addresses and single labels stay whole.
    """
    tidy = F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.|\.$", "")
    return F.when(
        host.rlike(r"^\.|\.\.|\.$"), F.when(tidy.contains("."), _domain_of_tidy(tidy)).otherwise(host)
    ).otherwise(_domain_of_tidy(host))


def host_suffixes(host: Column) -> Column:
    """Every label suffix of a host, the host itself first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
