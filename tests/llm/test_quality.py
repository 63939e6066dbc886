from __future__ import annotations

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, queries
from tests.llm.conftest import rows_of, words


def slow(text):
    """The base and the verdict, word by word."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), []
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        if x in seen:
            dup.append(x)
        seen.add(x)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = (len(w), sum(map(len, w)), symbols, len(dup), len(covered))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    n_bytes = sum(len(x.encode()) for x in w)

    def top(n):
        grams = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return max([c * sum(len(x.encode()) for x in g) for g, c in grams.items() if c > 2], default=0)

    bad = failed or not 3 * len(w) <= base[1] <= 10 * len(w) or 10 * symbols > len(w) or 100 * sum(map(len, dup)) > 20 * len(text)
    letterless = sum(not re.search("[A-Za-z]|[^\x00-\x7f]", x) for x in w)
    bad = bad or 100 * letterless > 20 * len(w) or sum(x.lstrip(" \t\v\f\r")[:1] in "-*•" for x in lines) * 100 > 90 * len(lines)
    bad = bad or sum(x.rstrip(" \t\v\f\r").endswith(("...", "…")) for x in lines) * 100 > 30 * len(lines)
    bad = bad or any(100 * top(n) > limit * n_bytes for n, limit in ((2, 20), (3, 18), (4, 16)))
    return (*base, failed, not bad)


def junk(rng):
    """A text for each rule, most of them over 50 words, and clean ones."""
    clean = [words(rng, n) for n in (49, 50, 200, 3000)]
    w = words(rng, 120).split()
    return clean + [
        " ".join(x[:2] for x in w),
        " ".join(x * 4 for x in w),
        " ".join(f"{x}###" if i % 3 else x for i, x in enumerate(w)),
        "\n".join([words(rng, 40)] * 2 + [words(rng, 80)]),
        "\n".join([words(rng, 60), "short", "short", "\t", "\t", words(rng, 60)]),
        " ".join(x if i % 3 else "12,345" for i, x in enumerate(w)),
        "\n".join(f" - {words(rng, 6)}" for _ in range(20)),
        "\n".join(f"{words(rng, 9)}{e}" for e in ("...", "… ", "", "") * 5),
        " ".join([*w, *["same words"] * 12]),
        " ".join(f"{x} one two three four" if i % 5 == 0 else x for i, x in enumerate(w)),
        " ".join(["same"] * 200),
        " ".join(w[:3] * 2 + w[3:]),
        "x" * 100_000,
    ]


def all_texts():
    import random

    from tests.llm.conftest import texts

    return texts() + junk(random.Random(11))


def table(spark):
    return spark.createDataFrame(rows_of(all_texts()), "doc_id long, text string, kept string, rejected_by string, n_words long, a long, b long, c string, d int, e int, f long, g string")


def test_every_rule_against_brute_force(spark):
    values = all_texts()
    rows = quality.cascade(table(spark)).collect()
    assert {r.doc_id: (*r[1:6], r.base_failed, r.kept) for r in rows} == {i: slow(t) for i, t in enumerate(values)}
    met = {r.rejected_by for r in rows}
    assert {None, "few_words", "repeated_words", "short_words", "long_words", "symbols"} <= met
    alone = {rule.name for rule in quality.RULES for t in values if rule.rejects(quality.Text(t))}
    assert alone == {rule.name for rule in quality.RULES}


def test_the_order_changes_the_work_alone(spark, edge):
    forwards = quality.cascade(edge, quality.RULES).drop("rejected_by").collect()
    backwards = quality.cascade(edge, quality.RULES[::-1]).drop("rejected_by").collect()
    assert sorted(forwards, key=str) == sorted(backwards, key=str) and len(forwards) == edge.count()


def test_order_is_by_rejections_per_second():
    a, b, c, d = (quality.Rule(x, lambda t: False) for x in "abcd")
    # b rejects most, but costs most; what c rejects is rejected by a already; d rejects nothing
    seconds = {"a": 1.0, "b": 100.0, "c": 2.0, "d": 0.1}
    found = quality.ordered((a, b, c, d), quality.Measured(seconds, {0b0101: 30, 0b0010: 500, 0b0111: 5, 0: 1000}))
    assert [r.name for r in found] == ["a", "b", "d", "c"]


def test_a_rule_after_a_rejection_is_not_asked(spark):
    def never(text):
        raise AssertionError("asked")

    docs = table(spark).where("doc_id = 0")
    rules = (quality.Rule("all", lambda t: True), quality.Rule("never", never))
    assert [r.rejected_by for r in quality.cascade(docs, rules, base=()).collect()] == ["all"]


def test_measured_on_a_sample(spark):
    found = quality.measure(table(spark), rows=10_000)
    values = [t for t in all_texts() if not any(r.rejects(quality.Text(t)) for r in quality.BASE)]
    assert sum(found.rejected.values()) == len(values) and all(s > 0 for s in found.seconds.values())
    few = quality.measure(table(spark).withColumn("text", F.lit("a b c " * 40 + "d e f")), rows=20)
    assert sum(few.rejected.values()) <= 60


def test_windows_of_many_distinct_words_stay_exact():
    text = quality.Text(" ".join(map(str, range(2_100_000))) + " 0 1 2")
    assert text.n_repeat_words == 6 and len(text.grams(4)) == text.n_words - 3


def test_carried_and_empty(spark, edge, nothing):
    found = quality.cascade(edge, quality.RULES, carry=("n", "text", "c0"))
    assert found.columns[-3:] == ["c0", "text", "c2"] or found.columns[-3:] == ["c0", "c1", "c2"]
    assert {r.c0 for r in found.collect()} == {4} and found.where("doc_id IS NULL").count() == 2
    assert quality.cascade(nothing).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_query_against_sql_and_brute_force(spark, folder, tmp_path):
    if folder is None:
        folder = f"file://{tmp_path}"
        table(spark).write.parquet(f"{folder}/documents.parquet")
    found = queries.op11_quality_rules(spark, folder)
    got = sorted(tuple(r) for r in found.collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((i, *slow(t)) for i, t in docs)
    with duckdb.connect() as db:
        path = f"{folder.removeprefix('file://')}/documents.parquet"
        files = path if folder.startswith("/root") else f"{path}/*.parquet"
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
        told = db.execute(queries.oracle_sql()["op11_quality_rules"])
        assert [x[0] for x in told.description] == found.columns
        assert got == sorted(told.fetchall())
