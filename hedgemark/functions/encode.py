"""The one Python helper: hosts that are not plain ASCII names."""

from __future__ import annotations

import ipaddress
import re
import socket
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgemark.functions.hosts import is_plain_host, is_usable_host

# Send the helper itself to the executors, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NUMERIC = re.compile(r"(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}\Z")
_LETTER_DIGIT = {"Ll", "Lo", "Lm", "Mn", "Mc", "Nd"}
_DEVIATIONS = {"ß", "ς"}
_DOTS = re.compile("[.。．｡]")


def _address(host: str) -> str | None:
    if _NUMERIC.match(host):
        try:
            return socket.inet_ntoa(socket.inet_aton(host))
        except OSError:
            return None
    if ":" in host:
        try:
            packed = ipaddress.IPv6Address(host).packed
        except ValueError:
            return None
        return socket.inet_ntop(socket.AF_INET6, packed)
    return None


def _mapped(label: str) -> str:
    """Fold case and compatibility forms but keep the deviation letters."""
    folded = (c if c in _DEVIATIONS else unicodedata.normalize("NFKC", c).casefold() for c in label)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", "".join(folded)))


def _label(label: str) -> str:
    label = _mapped(label)
    if not label or label.startswith("-") or label.endswith("-") or label[2:4] == "--":
        raise ValueError("label")
    if unicodedata.category(label[0]) in ("Mn", "Mc", "Me"):
        raise ValueError("mark first")
    if any(c != "-" and unicodedata.category(c) not in _LETTER_DIGIT for c in label):
        raise ValueError("character")
    if label.isascii():
        return label
    encoded = "xn--" + label.encode("punycode").decode("ascii")
    if len(encoded) > 63:
        raise ValueError("length")
    return encoded


def encode_host(host: str) -> str:
    """Canonical address or ASCII-compatible name; the host itself if neither works."""
    address = _address(host)
    if address is not None:
        return address
    try:
        return ".".join(_label(part) for part in _DOTS.split(host))
    except (ValueError, UnicodeError):
        return host


@F.pandas_udf(T.StringType())
def _encode(hosts: pd.Series) -> pd.Series:
    known: dict[str, str] = {h: encode_host(h) for h in hosts.dropna().unique()}
    return hosts.map(known).astype(object).where(hosts.notna(), None)


# The result depends on the host alone. The mark keeps the planner from copying the
# whole chain of URL expressions into every filter on a host or a normal URL.
_encode = _encode.asNondeterministic()


def canonical_host(text: Column) -> Column:
    """Host for matching. Plain names never reach Python: they are sent as null."""
    plain = is_plain_host(text)
    special = F.when(~plain & is_usable_host(text), text)
    return F.when(plain, text).otherwise(_encode(special))
