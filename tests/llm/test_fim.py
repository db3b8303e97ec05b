"""Fill-in-middle: units against the grammars' own regular expressions, and every document against a loop."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import fim
from tests.llm.conftest import corpus, same

TEXTS = ["", "\n", "\n\n\n", "one", "one\n", "a\nb\n\nc", "\r\n\r", " lead two  three\n four ", "No. Yes! Who? end", "z y\x00\n\U0001f600\U0001f601 \U0001f602", "p\n\nq\n\n\nr\n", "x" * 100_000 + "\n" + "y\n" * 50_000]
#: What a grammar's units are, as a pattern that eats them.
EATEN = {"line": r"[^\n]*\n|[^\n]+", "word": r"^\s+|\S+\s*", "sentence": r"(?s:.+?)(?:(?<=[.!?]\s)(?=\S)|\Z)", "paragraph": r"(?s:.+?)(?:(?<=\n\n)(?=[^\n])|\Z)"}


@pytest.mark.parametrize("grammar", sorted(EATEN))
def test_units(spark, grammar):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").coalesce(1)
    for r in rows.select("k", fim.units(F.col("t"), grammar).alias("u")).collect():
        text = TEXTS[r.k]
        assert "".join(r.u) == text
        if len(text) < 1000 or grammar == "line":
            assert r.u == [m[0] for m in re.finditer(EATEN[grammar], text, re.ASCII)]


def loop(doc_id, text, rate=100):
    """n, form, prefix, middle, output by the contract."""
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < 50:
        return len(u), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


def test_op11_equals_sql(spark, odd, sql):
    same(fim.op11_fill_in_middle(spark, odd), sql, fim.ORACLE)


def test_op11_equals_loop(spark, odd):
    got = sorted(map(str, (tuple(r) for r in fim.op11_fill_in_middle(spark, odd).collect())))
    want = []
    for row in corpus():
        n, form, p, m, out = loop(row[0], row[1])
        digest = hashlib.sha256(out.encode()).hexdigest()
        want.append(str((row[0], n, form, None if p is None else len(p), None if m is None else len(m), digest, hashlib.sha256((row[1] or "").encode()).hexdigest())))
    assert got == sorted(want)


def test_marks_rates_and_other_columns(spark):
    rows = [(k, t, 7) for k, t in enumerate(["a<P>b", "a<S>", "<M>", None, "", "a\nb\nc<\n", "<S\n>\n", "one"])] + [(5, "a\nb\nc<\n", 7), (None, "x\ny\n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim int")
    for rate in (100, 0, 40):
        made = fim.transformed(docs, rate=rate)
        assert made.columns == ["doc_id", "text", "fim", "_fim"]
        for r in made.withColumn("back", fim.restored(F.col("_fim.output"), F.col("_fim.form"))).collect():
            n, form, p, m, out = loop(r.doc_id, r.text, rate)
            assert (r._fim.n, r._fim.form, r._fim.prefix, r._fim.middle, r._fim.output) == (n, form, p, m, out)
            assert r.back == (r.text or "")
            assert r.fim == 7


def test_empty(spark, nothing):
    assert fim.op11_fill_in_middle(spark, nothing).count() == 0


def test_stays_in_the_jvm(spark, odd):
    plan = fim.op11_fill_in_middle(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
