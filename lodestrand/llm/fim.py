"""Fill-in-middle transformation: a text's units, cut by lookaround, are dealt to prefix, middle and suffix.

A unit grammar says how a text falls into units, one behind the other and without gaps: lines,
words, sentences or runs of one kind of sign. Each is translated to a pattern of no width that matches between two characters
of neighbouring classes, where a unit ends and the next begins. Spark's split() at this
pattern keeps every character, so the units put together are the text. An empty text has no units,
which split() can't say, and is told apart.

Where a text is cut follows from a hash of its id alone. All of it are Column expressions within a row:
nothing is shuffled, and no row passes through Python.

Defined results: null texts are empty; empty texts, and those that hold one of the marks, stay plain;
a text of one unit has cuts before or behind it only; repeated rows get the same cuts; a null id hashes as an empty one; an
empty table gives an empty one; other columns are not read, or pass through transformed() as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import common


@dataclass(frozen=True)
class Grammar:
    """Units of which each ends with a character of class `last` (of what `after` says it stands behind),
    where the next character is one of class `first`."""

    last: str
    first: str
    after: str = ""

    @property
    def boundary(self) -> str:
        """A regular expression that matches nothing but the place between two units."""
        return f"(?<={self.after}{self.last})(?={self.first})"


ANY = r"[\s\S]"
GRAMMARS = {
    # A line with its end; the last may have none.
    "line": Grammar(r"\n", ANY),
    # A word with the (ASCII) white space behind it; white space at the text's begin is a unit.
    "word": Grammar(r"\s", r"\S"),
    # Up to a full stop, question or exclamation mark with one white space behind it.
    "sentence": Grammar(r"\s", r"\S", r"[.!?]"),
    # Lines up to an empty one, with it.
    "paragraph": Grammar(r"\n", r"[^\n]", r"\n"),
}

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
#: Of 100 texts, those that are transformed, and of these those whose suffix comes first.
RATE = 100
SPM_RATE = 50


def units(text: Column, grammar: str | Grammar = "line") -> Column:
    """A text's units as an array; joined they are the text. An empty text has none."""
    rule = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, rule.boundary, -1))


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1, the first 32 hexadecimal digits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grammar: str | Grammar = "line", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """docs with a column `fim` of structs: n units, form, prefix, middle, suffix and output.

    The prefix ends after the smaller of two drawn numbers of units, from none to all, the middle after the larger.
    Form: plain (output is the text; the parts are null), psm (prefix, suffix, middle) or spm (suffix first)."""
    names = docs.columns
    own, cut, hashed = (common.fresh(names, x) for x in ("fim_text", "fim_units", "fim_draws"))
    h1, h2, h3, h4 = (F.col(hashed)[k] for k in range(4))
    n = F.size(own_units := F.col(cut)).cast("long")
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    whole = F.col(own)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(whole, F.lit(mark))
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    part = lambda start, count: F.array_join(F.slice(own_units, start + 1, count), "")
    rows = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({cut: units(whole, grammar), hashed: F.array(*draws(F.col(doc_id), seed))})
    parts = F.struct(
        n.alias("n"),
        form.alias("form"),
        part(F.lit(0), low).alias("prefix"),
        part(low, high - low).alias("middle"),
        part(high, F.size(own_units) - high).alias("suffix"),
    )
    rows = rows.withColumn(cut, parts)
    x = F.col(cut)
    output = (
        F.when(x["form"] == "plain", whole)
        .when(x["form"] == "psm", F.concat(F.lit(PREFIX), x["prefix"], F.lit(SUFFIX), x["suffix"], F.lit(MIDDLE), x["middle"]))
        .otherwise(F.concat(F.lit(SUFFIX), x["suffix"], F.lit(PREFIX), x["prefix"], F.lit(MIDDLE), x["middle"]))
    )
    kept = [F.when(x["form"] != "plain", x[c]).alias(c) for c in ("prefix", "middle", "suffix")]
    fim = F.struct(x["n"].alias("n"), x["form"].alias("form"), *kept, output.alias("output"))
    return rows.select(*(F.col(f"`{c}`") for c in names), fim.alias(common.fresh(names, "fim")))


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it: a transformed text holds each mark once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    p_first = F.substring(head, len(PREFIX) + 1, F.length(head))
    s_first = F.substring(head, len(SUFFIX) + 1, F.length(head))
    psm = F.concat(F.substring_index(p_first, SUFFIX, 1), middle, F.substring_index(p_first, SUFFIX, -1))
    spm = F.concat(F.substring_index(s_first, PREFIX, -1), middle, F.substring_index(s_first, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(common.documents(spark, sf_dir, "doc_id", "text"))
    x = F.col("fim")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id",
        x["n"].alias("n"),
        x["form"].alias("form"),
        F.length(x["prefix"]).cast("long").alias("prefix_chars"),
        F.length(x["middle"]).cast("long").alias("middle_chars"),
        digest(x["output"]).alias("output_sha256"),
        digest(restored(x["output"], x["form"])).alias("restored_sha256"),
    )


ORACLE = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(('0x' || substr(h, 1, 8))::UBIGINT AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8))::UBIGINT AS BIGINT) AS h2, CAST(('0x' || substr(h, 25, 8))::UBIGINT AS BIGINT) AS h4,
    contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS marked FROM d
), y AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR marked THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x
), z AS (
  SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM y
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM z"""
