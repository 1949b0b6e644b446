"""Secret scans with multipart credential linking.

A small helper reads each text for strong finds (assignments, access identifiers, long
hex) and for weak parts that mean nothing alone: account identifiers, secret-like
strings and endpoints. Parts are intervals of a text; they are staged without the text
and linked in Spark: the parts of a scope are put in order, and each finds the nearest
complement on either side. A weak identifier or secret is reported only if the other
part lies in scope, an endpoint only if both do. Nearest neighbours suffice, so no pairs
are formed however many parts a text has.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches
from hedgemark.sources.tables import stage

#: Kinds in the order in which equal starts are listed (fixed values).
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Parts belong to one scope if no more than so many characters lie between them and no blank line does.
SCOPE_CHARS = 200

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(
    r"""(?i:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])"
                    r"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(
    r"""(?i:(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s"'<>]{3,})"""
    r"""|(?i:host|endpoint|server|region)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{3,})""", re.A)

#: Roles for linking, by rank of the kind: what names an account, what opens it, where it is.
NAMES, OPENS, PLACES = (1, 3), (0, 2, 4), (5,)
#: A text without any of these has neither strong finds nor parts that could be linked.
HINT = r"[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
PARTS = "array<struct<start:int,rank:int,end:int,scope:int>>"
BLANK = re.compile(r"\n[\t\r ]*\n")

Part = tuple[int, int, int]


def strong_parts(text: str) -> list[Part]:
    """The base kinds as (start, rank, end), leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def weak_parts(text: str, strong: list[Part]) -> list[Part]:
    """Candidates that only a complement makes worth reporting, outside the strong finds."""
    found = [(m.start(1), 3, m.end(1)) for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in SECRET.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    taken, end = [], -1
    for start, _, stop in sorted(strong):
        if stop > end:
            taken.append((start, stop))
            end = stop
    starts = [a for a, _ in taken]

    def free(part: Part) -> bool:
        at = bisect_right(starts, part[2] - 1) - 1
        return at < 0 or taken[at][1] <= part[0]

    return [p for p in found if free(p)]


def _parts(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in columns:
        out = []
        for text in texts:
            text = text or ""
            found = strong_parts(text)
            if ":" in text or "=" in text or "AKIA" in text:
                found += weak_parts(text, found)
            blanks = [m.start() for m in BLANK.finditer(text)] if len(found) > 1 else []
            out.append([(s, k, e, bisect_right(blanks, s)) for s, k, e in sorted(found)])
        yield pd.Series(out)


def parts_of(text: Column) -> Column:
    return F.pandas_udf(_parts, PARTS)(text)


def _near(role: tuple[int, ...], reach: int) -> Column:
    """Whether a part of ``role`` other than this one lies within ``reach`` characters in the same scope."""
    before = Window.partitionBy("row", "p.scope").orderBy("p.start", "p.rank", "p.end") \
        .rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "p.scope").orderBy(F.desc("p.start"), F.desc("p.rank"), F.desc("p.end")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("p.rank").isin(*role)
    left = F.col("p.start") - F.max(F.when(mine, F.col("p.end"))).over(before)
    right = F.min(F.when(mine, F.col("p.start"))).over(after) - F.col("p.end")
    return F.coalesce(left <= reach, F.lit(False)) | F.coalesce(right <= reach, F.lit(False))


def linked_parts(rows: DataFrame, reach: int = SCOPE_CHARS) -> DataFrame:
    """``row, linked``: the weak parts of each row (``row``, ``parts``) that a complement confirms."""
    weak = rows.where(F.exists("parts", lambda p: p["rank"] > 2)).select("row", F.explode("parts").alias("p"))
    seen = weak.withColumns({"named": _near(NAMES, reach), "opened": _near(OPENS, reach)})
    confirmed = seen.where(F.when(F.col("p.rank") == 3, F.col("opened")).when(F.col("p.rank") == 4, F.col("named"))
                           .when(F.col("p.rank") == 5, F.col("named") & F.col("opened")).otherwise(False))
    return confirmed.groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("linked"))


def _listed(parts: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(parts, lambda p: F.concat_ws(
        ":", F.element_at(kinds, p["rank"] + 1), p["start"].cast("string"), p["end"].cast("string"))))


def scan(docs: DataFrame, keep: list[str], reach: int = SCOPE_CHARS) -> DataFrame:
    """One row per document row: ``keep``, n_assign, n_access, n_hex, base_sha256, spans and ``parts`` (all reported).

    Whole texts; null and empty texts have no parts. Repeated rows and equal or null ids
    are judged each for itself. Positions are code points, ends exclusive. Other columns
    are dropped first, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), parts_of(F.col("text")).alias("parts"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "parts")
    base = F.filter("parts", lambda p: p["rank"] <= 2)
    joined = rows.join(linked_parts(rows, reach), "row", "left").withColumn("base", base)
    joined = joined.withColumn("all", F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(PARTS)))))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda p: p["rank"] == rank)).cast("long")

    return joined.select("doc.*", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                         F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
                         F.col("all").alias("parts"))


def _blanked(text: pd.Series, parts: pd.Series) -> pd.Series:
    out = []
    for whole, spans in zip(text, parts):
        pieces, at = [], 0
        for start, end in sorted((p["start"], p["end"]) for p in spans):
            if start >= at:
                pieces += [whole[at:start], "[secret]"]
            at = max(at, end)
        out.append("".join(pieces) + whole[at:])
    return pd.Series(out)


def redact(docs: DataFrame, reach: int = SCOPE_CHARS) -> DataFrame:
    """``docs`` with every reported part of its texts replaced by "[secret]" (overlapping parts by one) and, where
    there is such a column, ``n_chars`` set anew for those texts. Rows without a hint of a part pass by unchanged."""
    names = list(docs.columns)
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    rest = docs.where(~hinted)
    suspects = stage(docs.where(hinted).select(F.struct(*names).alias("whole"), "text"), "hinted")
    found = scan(suspects, ["whole"], reach).select("whole", "parts")
    blank = F.pandas_udf(_blanked, "string")
    slim = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    cut = found.where(F.size("parts") > 0).withColumn("text", blank(F.col("whole.text"), slim))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rest.unionByName(found.where(F.size("parts") == 0).select("whole.*")) \
        .unionByName(cut.select(*[(own[c] if c in own else F.col("whole")[c]).alias(c) for c in names]))
