"""Quality rules: a threshold table compiled into one Spark projection.

``MEASURES`` are counts of a text, ``RULES`` a table of (name, measure, per,
least, most) in percent; ``compile_rules`` turns the table into one boolean
column of integer comparisons.  Everything is a built-in expression: no
explode, no shuffle, no Python, so a document of any length costs one pass of
its own row, and skew of sources or copies does not matter.

Defined results: a null text counts as empty; an empty text has all counts 0,
fails the base rule and is not kept; a null ``doc_id`` is passed through;
repeated rows are judged alike; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

SPACE = " \t\n\x0b\f\r"

#: Common function words of English, French, Spanish and German.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne on ou par pas pour qu que qui sa se ses son sur un une vous "
    "al como con del el ella ellos era es esta este fue ha la las lo los más me mi muy no para pero por si sin su sus también te todo un una y ya yo "
    "aber als auch auf aus bei das dem den der des die durch ein eine einer er es für hat ich ihr im in ist mit nach nicht oder sich sie sind so über und von war wie wir zu zum zur"
).split()

#: name, measure, base of the percentage (or None: the plain number), least, most; None is open.
RULES = (
    ("word_length", "word_chars", "n_words", 250, 1200),
    ("symbols", "n_symbols", "word_chars", None, 5),
    ("shouting", "n_marks", "n_words", None, 50),
    ("stop_words", "n_stop_words", "n_words", 5, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)


def _same(words: Column, a: Column, b: Column) -> Column:
    """Two hashed three-word windows are equal, word by word."""
    return reduce(lambda x, k: x & (words[a["p"] + k] == words[b["p"] + k]), range(3), a["h"] == b["h"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text, by built-in expressions on its own row."""
    words, lines, grams, ranked = F.col("words"), F.col("lines"), F.col("grams"), F.col("ranked")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(F.col("text"), F.lit(SPACE))
    at = F.sequence(F.lit(0), F.size(words) - 3)
    gram = lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("p"))
    again = lambda g, k: ((k > 0) & _same(words, g, ranked[k - 1])) | ((k < F.size(ranked) - 1) & _same(words, g, ranked[k + 1]))
    none = "array<struct<h:bigint,p:int>>"
    return (
        docs.select("doc_id", text.alias("text"))
        .withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
        .withColumn("grams", F.when(F.size(words) >= 3, F.transform(at, gram)).otherwise(F.array().cast(none)))
        # texts without a repeated window, by far the most, skip the sort
        .withColumn("ranked", F.when(F.size(F.array_distinct(grams["h"])) < F.size(grams), F.sort_array(grams)).otherwise(F.array().cast(none)))
        .withColumn("repeated", F.filter(ranked, again)["p"])
        .select(
            "doc_id",
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.array_distinct(F.flatten(F.transform("repeated", lambda p: F.array(p, p + 1, p + 2))))).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count("text", F.lit("!")).cast("long").alias("n_marks"),
            F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression of the measures."""
    tests = []
    for _, measure, per, least, most in rules:
        value, base = F.col(measure) * 100, F.col(per) if per else F.lit(100)
        tests += [value >= base * least] * (least is not None) + [value <= base * most] * (most is not None)
    return reduce(lambda a, b: a & b, tests)


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures of every document, ``base_failed`` and ``kept``."""
    return measures(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_rules": op1_quality_rules}


def _sql_rules() -> str:
    out = []
    for _, measure, per, least, most in RULES:
        base = per or "100"
        out += [f"100 * {measure} >= {least} * {base}"] * (least is not None) + [f"100 * {measure} <= {most} * {base}"] * (most is not None)
    return " AND ".join(out)


ORACLES = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' '))) AS w3 FROM d WHERE len(ws) >= 3
), twice AS (
  SELECT r, w3 FROM g GROUP BY r, w3 HAVING count(*) > 1
), rep AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g JOIN twice USING (r, w3)) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks,
         CAST(len(list_filter(ws, lambda w: list_contains(STOPS, w))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND RULES AS kept FROM b
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]").replace("RULES", _sql_rules()),
}
