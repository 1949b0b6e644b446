"""The pipeline's near copies go through SimHash links; exact similarity decides what they are worth."""

import random

from pyspark.sql import functions as F

from hedgemark.llm import neardup, simhash
from hedgemark.sources.tables import stage
from tests.llm.test_neardup import alike, edited, plain_least, plain_shingles


def _docs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(0, 60, 2):
        words = [f"w{rng.randrange(9_000)}" for _ in range(rng.randrange(400, 900))]
        rows += [(k, " ".join(words)), (k + 1, " ".join(edited(words, 1, rng)))]
    line = " ".join(f"u{j}" for j in range(9))
    for k in (60, 61):  # fingerprints told by a line that repeats; the rest has nothing in common
        rows.append((k, " ".join([line] * 400 + [f"x{rng.getrandbits(40):x}" for _ in range(150)])))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def _signed(docs):
    sign = F.pandas_udf(neardup._signed, "node bigint, bands array<bigint>, fp bigint")
    rows = docs.select("doc_id", neardup._key().alias("key"), F.octet_length("text").cast("long").alias("bytes"), sign("text").alias("s"))
    return stage(rows.select("doc_id", "key", "bytes", "s.*"), "test-signed")


def test_fingerprints_alone_link_near_copies(spark):
    """Without a single band the pairs within four bits are still found, and no others are linked."""
    rows, docs = _docs(spark)
    signed = _signed(docs).withColumn("bands", F.array().cast("array<bigint>"))
    nodes = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"),
                                       F.max("bytes").alias("bytes"))
    found = {frozenset((r.a, r.b)) for r in neardup.links_between(docs, signed, nodes).collect()}
    node, fp = ({r.doc_id: r[c] for r in signed.collect()} for c in ("node", "fp"))
    assert fp == {d: neardup.np.uint64(simhash.fingerprint(t)).view(neardup.np.int64) for d, t in rows}
    near = [(k, k + 1) for k in range(0, 62, 2) if (fp[k] ^ fp[k + 1]).bit_count() <= 4 or (fp[k] ^ fp[k + 1]) < 0
            and ((fp[k] ^ fp[k + 1]) & (1 << 64) - 1).bit_count() <= 4]
    sets = {d: plain_shingles(t) for d, t in rows}
    assert (60, 61) in near and not alike(sets[60], sets[61])
    assert len(near) > 10
    assert found == {frozenset((node[a], node[b])) for a, b in near if alike(sets[a], sets[b])}


def test_similarity_decides(spark):
    rows, docs = _docs(spark)
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == plain_least(rows)
