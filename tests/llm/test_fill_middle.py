"""Fill-in-middle against pieces cut by a regular expression, and the exact text again."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import fill_middle
from clickloom.llm.fill_middle import Rules

from .test_corpus import docs, none, odd  # noqa: F401  fixtures

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "character": r"(?s:.)"}


def brute(doc_id, text, rules):
    text = text or ""
    h = [int(hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(PATTERNS[rules.unit], text)
    assert "".join(units) == text
    n = len(units)
    if not text or h[2] % 100 >= rules.rate or any(s in text for s in rules.sentinels):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < rules.spm_rate:
        return n, "spm", len(p), len(m), rules.suffix + s + rules.prefix + p + rules.middle + m
    return n, "psm", len(p), len(m), rules.prefix + p + rules.suffix + s + rules.middle + m


@pytest.mark.parametrize("rules", [Rules(), Rules(rate=50, spm_rate=20, seed=3), Rules(unit="word"), Rules(prefix="[pre]", suffix="[suf]", middle="[mid]", unit="character", spm_rate=0)])
def test_against_pieces(docs, odd, rules):  # noqa: F811
    for table in (docs, odd):
        rows = fill_middle.transformed(table, rules).withColumn("again", fill_middle.restored(rules=rules)).collect()
        texts = table.select("doc_id", "text").collect()
        want = sorted(((r["doc_id"], *brute(r["doc_id"], r["text"], rules)) for r in texts), key=str)
        assert sorted((tuple(r)[:-1] for r in rows), key=str) == want
        assert sorted(r["again"] for r in rows) == sorted(r["text"] or "" for r in texts)


def test_forms_and_cases(spark, none):  # noqa: F811
    long = "a line of text\n" * 100_000 + "the end"
    rows = [(i, t) for i, t in enumerate(["", None, "x <P> y", "<S>", "<M>\n", "<", "a<\nS>\n", "<P\n>", "\n", "\n\n\n", "no break", "é\n\U0001f600\n東\r\n", long])] + [(3, "<S>"), (None, "a\nb\n"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("z"), "n": F.lit(1), "output": F.lit(None)})
    got = fill_middle.digests(table).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r["restored_sha256"] for r in got) == sorted(digest(t) for _, t in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["form"] == "plain" and by_id[i]["prefix_chars"] is None for i in range(5))
    assert all(by_id[i]["form"] != "plain" for i in range(5, 13)) and by_id[12]["n"] == 100_001 and by_id[9]["n"] == 3
    assert by_id[0]["n"] == 0 and len(got) == len(rows)
    assert not fill_middle.digests(none).collect()


def test_shares(spark):
    table = spark.range(4000).selectExpr("id as doc_id", "'a\nb\nc\n' as text")
    found = {r["form"]: r["count"] for r in fill_middle.transformed(table, Rules(rate=60, spm_rate=25)).groupBy("form").count().collect()}
    assert abs(found["plain"] - 1600) < 150 and abs(found["spm"] - 600) < 120
    assert set(r["form"] for r in fill_middle.transformed(table, Rules(rate=0)).collect()) == {"plain"}


def test_rules_are_checked():
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "ab", "suffix": "bc"}, {"prefix": "aba"}, {"unit": "page"}):
        with pytest.raises(ValueError):
            Rules(**bad)


def test_one_pass(docs):  # noqa: F811
    assert "Exchange" not in fill_middle.digests(docs)._jdf.queryExecution().executedPlan().toString()
