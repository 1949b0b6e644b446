"""Decontamination and quality rules against plain versions, and their plans."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hedgemark.llm import decontaminate, quality
from hedgemark.llm.common import LOWER, UPPER

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def plain_judge(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def bench(spark, sf):
    given = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("long"), "text")
    own = spark.createDataFrame([(9001, "theta iota"), (9002, "Kappa, LAMBDA"), (9003, None), (9004, "..."), (9005, LINE),
                                 (9005, LINE)], "item_id long, text string")
    return given.unionByName(own)


@pytest.fixture(scope="module")
def docs(spark, odd_docs, sample):
    more = spark.createDataFrame([(1, LINE), (1, LINE), (2, f"x {LINE.upper()}! y"), (3, "theta; iota kappa"), (None, LINE)],
                                 "doc_id long, text string")
    return odd_docs.unionByName(sample, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)


@pytest.mark.parametrize("limit", [decontaminate.SET_LIMIT, 5])
def test_hits_like_plain(docs, bench, limit):
    found = decontaminate.judge(docs, decontaminate.Benchmark(bench, set_limit=limit), ["doc_id"]).drop("hits").collect()
    expected = plain_judge([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_clean_rows_stay_as_they_are(docs, bench):
    made = decontaminate.Benchmark(bench)
    flags = [x[5] for x in plain_judge([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])]
    clean = [tuple(r) for r, bad in zip(docs.collect(), flags) if not bad]
    kept = decontaminate.drop_contaminated(docs, made)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)
    cut = decontaminate.remove_spans(docs, made).collect()
    assert len(cut) == len(flags)
    assert not any(x[5] for x in plain_judge([(0, r.text) for r in cut if r.doc_id in (1, 2)], [(1, LINE)]))


def test_empty_tables(docs, bench, empty_docs):
    none = decontaminate.Benchmark(bench.where(F.lit(False)))
    assert decontaminate.judge(docs, none, ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.judge(empty_docs, decontaminate.Benchmark(bench), ["doc_id"]).count() == 0
    assert quality.judge(empty_docs, ["doc_id"]).count() == 0


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if at[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_measures_like_plain(docs):
    expected = sorted(((r.doc_id, *plain_measures(r.text)) for r in docs.collect()), key=str)
    found = quality.judge(docs, ["doc_id"]).drop("kept", "reasons").collect()
    assert sorted(map(tuple, found), key=str) == expected


def test_fences_follow_the_group(spark):
    def text(word, n=60):
        return " ".join(f"{word}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))

    rows = [(k, text("w" * (3 + k % 2)), "x", "a") for k in range(300)] + [(k, text("w" * (30 + k % 2)), "x", "b") for k in range(300, 600)]
    rows += [(600, text("w" * 30), "x", "a"), (601, text("w" * 3), "x", "b"), (602, text("w" * 4), "x", "rare"), (603, "few", "x", "a")]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    assert {r.doc_id for r in judged.where(~F.col("kept")).collect()} == {600, 601, 603}


def test_no_python_on_the_main_path(docs, bench):
    for df in (decontaminate.judge(docs, decontaminate.Benchmark(bench), ["doc_id"]), quality.judge(docs, ["doc_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_symbols_of_a_group_without_any(spark):
    def text(k, every):
        return " ".join(f"w{k}x{j}" + ("|" if every and j % every == 0 else "") for j in range(60))

    rows = [(k, text(k, 0), "x", "a") for k in range(300)] + [(300, text(300, 3), "x", "a"), (301, text(301, 0), "x", "a")]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    assert {r.doc_id: r.reasons for r in judged.where(~F.col("kept")).collect()} == {300: ["symbol_share"]}


def plain_kept(docs, rules=quality.Rules()):
    """(row, kept) by sorted lists: quartile = middle of the bucket of the least value that a quarter or three do not pass."""
    step, rows = math.log1p(rules.accuracy), []
    for r in docs:
        n, chars, symbols, dup, rep, failed = plain_measures(r.text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n"))
        v = {"w": (chars / max(n, 1), math.sqrt(chars) / max(n, 1))}
        for name, count, total in (("s", symbols, n), ("d", dup, lines), ("r", rep / 6, n / 6)):
            v[name] = math.sqrt((count + 0.375) / (total + 0.75)), 0.5 / math.sqrt(total + 0.75)
        rows.append((r, v, failed))

    def quartiles(group, m):
        at = sorted(math.floor(math.log(v[m][0]) / step) for _, v, _ in group)
        return [math.exp((at[math.ceil(q * len(at)) - 1] + 0.5) * step) for q in (0.25, 0.75)]

    fit, known = [x for x in rows if not x[2]], {}
    for r, v, failed in rows:
        if (r.lang, r.source) not in known:
            levels = [[x for x in fit if (x[0].lang, x[0].source) == (r.lang, r.source)], [x for x in fit if x[0].lang == r.lang], fit]
            group = next((x for x in levels if len(x) >= rules.min_rows), fit)
            known[r.lang, r.source] = {m: quartiles(group, m) for m in v} if group else {}
        kept = not failed
        for m, (q1, q3) in known[r.lang, r.source].items():
            reach = rules.reach * max(q3 - q1, v[m][1])
            kept = kept and v[m][0] <= q3 + reach and (m != "w" or v[m][0] >= q1 - reach)
        yield r, kept


def noisy(spark):
    """Three sources of one language: plain prose, tables full of marks, and verse of repeated lines; and strangers in each."""
    rng, rows = random.Random(7), []

    def prose(n, marks=0.0, again=0.0):
        words = [rng.choice("abcdefgh") * rng.randint(2, 8) + str(rng.randrange(9000)) + ("|" if rng.random() < marks else "")
                 for _ in range(n)]
        lines = [" ".join(words[i:i + 8]) for i in range(0, n, 8)]
        return "\n".join(lines[rng.randrange(k)] if k and rng.random() < again else line for k, line in enumerate(lines))

    for source, marks, again in (("prose", 0.0, 0.0), ("tables", 0.5, 0.0), ("verse", 0.0, 0.2)):
        rows += [(prose(rng.randint(100, 900), marks * rng.uniform(0.3, 1), again * rng.random()), source) for _ in range(220)]
        rows += [(prose(300, 0.5, 0.0), source), (prose(300, 0.0, 0.2), source), (prose(300), source), (None, source)]
    rows += [(prose(200), None), (prose(200, 0.9), None), ("few words", "prose")]
    return spark.createDataFrame([(k, text, "xx" if k % 50 else None, source, "x") for k, (text, source) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, g_all string")


def test_verdicts_like_plain(spark, sample):
    for docs in (noisy(spark), sample.select("doc_id", "text", "lang", "source")):
        for rules in (quality.Rules(min_rows=30), quality.Rules(reach=1.5, min_rows=20)):
            found = sorted((r.doc_id, r.kept) for r in quality.judge(docs, ["doc_id"], rules).collect())
            assert found == sorted((r.doc_id, kept) for r, kept in plain_kept(docs.collect(), rules))
            assert len({kept for _, kept in found}) == 2


def test_what_is_usual_in_one_source_is_not_in_another(spark):
    judged = {(r.source, r.doc_id % 224): r for r in quality.judge(noisy(spark), ["doc_id", "source"]).collect() if r.doc_id < 672}
    assert "symbol_share" in judged["prose", 220].reasons and "symbol_share" in judged["verse", 220].reasons
    assert judged["tables", 220].kept
    assert all(judged[source, 222].kept for source in ("prose", "verse"))


def test_verdicts_do_not_depend_on_the_partitions(spark):
    docs = noisy(spark)
    runs = [sorted((r.doc_id, r.kept) for r in quality.judge(docs.repartition(n), ["doc_id"]).collect()) for n in (1, 13)]
    assert runs[0] == runs[1]
