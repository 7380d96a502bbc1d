"""Quality rules as a short-circuit cascade of SQL expressions.

Each rule is a rejecting condition over a text.  Some only compare the base
statistics, which every row has; others look at all words or characters, and
those expressions stand in the rule itself.  A spread sample of rows that pass
the base gives every rule's selectivity (share it rejects) and cost (mean
number of values it looks at).  Rules run in falling order of rejection per
cost inside one CASE, so a row that an early rule rejects evaluates none of
the later ones.  The order changes the work, never the verdict.  Everything is
an expression over its own row: no shuffle but one row of sums of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Bits of an array position in a packed (hash, position) key.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """reject: SQL condition over the statistics, words and _text; work: SQL expression for the values it looks at in a row."""

    name: str
    reject: str
    work: str


RULES = (
    Rule("distinct_words", "n_words > 100 AND 100 * size(array_distinct(words)) < 15 * n_words", "n_words"),
    Rule("words_with_letters", r"5 * size(filter(words, w -> w RLIKE '\\p{L}')) < 3 * n_words", "word_chars"),
    Rule("capitals", "2 * (octet_length(_text) - octet_length(translate(_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars", "octet_length(_text)"),
    Rule("duplicate_lines", "5 * n_dup_lines > 2 * n_lines", "2"),
    Rule("symbols", "10 * n_symbols > n_words", "2"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "4"),
)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the array `words`.

    Null texts count as empty.  For n_repeat_words, windows are hashed and
    packed with their position; only those whose 40-bit hash has an equal
    neighbour in sorted order (every true repeat does) are compared as
    strings.  Beyond 2^24 words all windows are compared so.
    """
    low = (1 << POSITION_BITS) - 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_text", text).withColumn("_trim", F.btrim("_text", F.lit(" \t\n\x0b\f\r")))
    symbols = sum((F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit(c))) for c in SYMBOLS), F.lit(0))
    d = d.withColumns({
        "words": F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE + "+")),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.when(F.col("_text").rlike(r"[#*$%&|<>]"), symbols).otherwise(0).cast("long"),
    })
    d = d.withColumn("_n", F.size("words"))
    d = d.withColumn(
        "_packed",
        F.expr(f"CASE WHEN _n >= {WINDOW} AND _n < {1 << POSITION_BITS} THEN sort_array(transform(sequence(0, _n - {WINDOW}), i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & {~low}L) | i)) END"),
    )
    # One long for each pair of sorted neighbours with the same hash: both positions.
    d = d.withColumn(
        "_pairs",
        F.expr(f"array_remove(zip_with(slice(_packed, 1, size(_packed) - 1), slice(_packed, 2, size(_packed)), (x, y) -> CASE WHEN shiftright(x ^ y, {POSITION_BITS}) = 0 THEN shiftleft(x & {low}L, {POSITION_BITS}) | (y & {low}L) ELSE -1L END), -1L)"),
    )
    d = d.withColumn(
        "_near",
        F.expr(f"CASE WHEN _n < {WINDOW} THEN array() WHEN _packed IS NULL THEN sequence(0L, _n - {WINDOW}L) ELSE array_distinct(flatten(transform(_pairs, p -> array(shiftright(p, {POSITION_BITS}), p & {low}L)))) END"),
    )
    gram = "concat_ws(' ', words[int(i)], words[int(i) + 1], words[int(i) + 2])"
    d = d.withColumn("_grams", F.expr(f"sort_array(transform(_near, i -> named_struct('g', {gram}, 'i', i)))"))
    d = d.withColumn(
        "_hits",
        F.expr("""sort_array(array_remove(transform(_grams, (x, j) -> CASE WHEN (j > 0 AND _grams[j - 1].g = x.g)
            OR (j + 1 < size(_grams) AND _grams[j + 1].g = x.g) THEN x.i ELSE -1L END), -1L))"""),
    )
    covered = f"aggregate(transform(_hits, (x, j) -> CASE WHEN j = 0 THEN {WINDOW}L ELSE least({WINDOW}L, x - _hits[j - 1]) END), 0L, (s, x) -> s + x)"
    return d.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(covered),
    })


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def base_failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def order_rules(texts: DataFrame, base: Column, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[Rule]:
    """Rules by falling rejection per cost over about sample_rows rows of texts (a column `text`), drawn evenly from all of them.

    One scan draws the rows at the rate that gives this number in the mean;
    only those that pass the base count.  One row of sums leaves the cluster.
    """
    rows = texts.count()
    sample = texts if rows <= sample_rows else texts.sample(fraction=sample_rows / rows, seed=42)
    number = lambda sql: F.coalesce(F.expr(sql).cast("double"), F.lit(0.0))
    passed = text_statistics(sample).withColumn("_base", base).select("_base", *[number(r.reject).alias(f"r{i}") for i, r in enumerate(rules)], *[number(r.work).alias(f"w{i}") for i, r in enumerate(rules)])
    count = lambda c: F.coalesce(F.sum(F.when(~F.col("_base"), F.col(c))), F.lit(0.0))
    found = passed.agg(*[count(f"r{i}") for i in range(len(rules))], *[count(f"w{i}") for i in range(len(rules))]).first()
    rank = {r.name: (-found[i] / max(found[len(rules) + i], 1e-9), found[len(rules) + i], r.name) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: rank[r.name])


def cascade(narrow: DataFrame, rules: tuple[Rule, ...], min_words: int, max_repeat_percent: int, sample_rows: int) -> DataFrame:
    """narrow without its text, with the statistics, base_failed and kept."""
    base = base_failed(min_words, max_repeat_percent)
    rejected = F.when(F.col("base_failed"), True)
    for rule in order_rules(narrow.select("text"), base, rules, sample_rows):
        rejected = rejected.when(F.expr(rule.reject), True)
    stats = text_statistics(narrow).withColumn("base_failed", base).withColumn("kept", ~rejected.otherwise(False))
    # Catalyst would push filters on these columns below the statistics, and so copy them into one condition that doubles
    # with each step.  It moves nothing below a column that is not deterministic.
    others = [c for c in narrow.columns if c != "text"]
    sealed = stats.select(*others, F.struct(*RESULT, F.rand(0).alias("seal")).alias("_s"))
    return sealed.select(*others, *[F.col(f"_s.{c}").alias(c) for c in RESULT])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = 500) -> DataFrame:
    """docs' id with the statistics, base_failed and kept.

    The cascade's order comes from about sample_rows rows; no size of sample
    changes a verdict.  Null and empty texts have zero counts and fail the
    base, if min_words is above 0.  Very long texts are read whole.  Repeated
    rows and tied ids are judged row by row; an empty table gives no rows.
    Clashing column names in docs are no matter: only the id and the text are
    read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = cascade(narrow, rules, min_words, max_repeat_percent, sample_rows)
    return out.withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = 500) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cascade(narrow, rules, min_words, max_repeat_percent, sample_rows).filter("kept").select("_row.*")
