"""Helpers of the text operators: tables, words, and text batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates the words of most operators (the six ASCII white-space characters).
SPACES = "[\\x20\\x09-\\x0D]+"


#: Most rows of a batch that goes to Python: texts differ in length a thousandfold, so few rows bound the bytes best.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that tasks hand to Python small, so that a worker's memory follows single texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a given table; other columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str = SPACES) -> Column:
    """The words between runs of separators; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def text_blocks(texts: Sequence[str | None], max_chars: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``max_chars`` together: (index of the first, texts).

    A longer text makes a run of its own, so memory is bounded by the longest text.
    """
    first, chars, run = 0, 0, []
    for at, text in enumerate(texts):
        text = text or ""
        if run and chars + len(text) > max_chars:
            yield first, run
            first, chars, run = at, 0, []
        run.append(text)
        chars += len(text)
    if run:
        yield first, run


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text begins and the last ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *map(len, texts)])


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds, zero where they meet."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def spans_of(starts: Sequence[int]) -> Iterator[tuple[int, int]]:
    return pairwise(starts)
