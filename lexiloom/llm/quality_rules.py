"""Operator 5: quality rules, one Spark projection compiled from a threshold table (no user functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be by for from has have in is it of on or that the this to was were with
als auf aus das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu
au aux ce dans de des du elle en est et il la le les ne pas pour que qui sur un une
al con de del el en es la las lo los no para por que se su una y
""".split()

#: (metric, lower bound, upper bound); null: no bound. A text is kept if every metric is inside.
RULES = (
    ("n_words", 20.0, 1e6),
    ("mean_word_length", 1.5, 25.0),
    ("symbol_ratio", None, 0.30),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.70),
    ("bare_line_ratio", None, 0.95),
    ("distinct_line_ratio", 0.05, None),
    ("mean_line_words", 1.0, None),
)

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

_SPACES = " \t\n\x0b\x0c\r"


def _minus(a: Column, b: Column) -> Column:
    return (a - b).cast("bigint")


def base_metrics(text: Column, gram: int = 8) -> list[dict[str, Column]]:
    """Layers of columns; each layer may use those before it."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    hashes = F.expr(f"transform(sequence(1, n_words - {gram - 1}), i -> xxhash64({', '.join(f'element_at(_words, int(i + {k}))' for k in range(gram))}))")
    # rows (hash, position) in order: an entry next to one with its hash is found twice or more
    twice = F.expr(
        "sort_array(transform(filter(transform(_sorted, (x, k) -> struct(x.p as p, "
        "coalesce(x.h = try_element_at(_sorted, k + 2).h, false) or (k > 0 and coalesce(x.h = try_element_at(_sorted, greatest(k, 1)).h, false)) as twice)), "
        "x -> x.twice), x -> x.p))"
    )
    covered = F.expr(f"aggregate(_at, named_struct('n', 0L, 'last', -{gram}L), (s, p) -> named_struct('n', s.n + least({gram}L, p - s.last), 'last', bigint(p)), s -> s.n)")
    return [
        {"_words": words, "_lines": lines},
        {"n_words": F.size("_words").cast("bigint"), "word_chars": F.length(F.translate(t, _SPACES, "")).cast("bigint"),
         "n_symbols": _minus(F.length(t), F.length(F.translate(t, "#*$%&|<>", ""))),
         "_n_lines": F.size("_lines"), "n_dup_lines": _minus(F.size("_lines"), F.size(F.array_distinct("_lines"))),
         "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
         "_bare": F.size(F.filter("_lines", lambda x: x.rlike(r"\|")))},
        {"_hashes": F.when(F.col("n_words") >= gram, hashes)},
        {"_sorted": F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.expr("sort_array(transform(_hashes, (h, k) -> struct(h as h, k as p)))"))},
        {"_at": F.when(F.col("_sorted").isNotNull(), twice)},
        {"n_repeat_words": F.when(F.col("_at").isNotNull(), covered).otherwise(0).cast("bigint")},
    ]


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("_n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("_stops") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "bare_line_ratio": F.col("_bare") / lines,
        "distinct_line_ratio": (F.col("_n_lines") - F.col("n_dup_lines")) / lines,
        "mean_line_words": F.col("n_words") / lines,
    }


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    ok, by = F.lit(True), ratios()
    for metric, low, high in rules:
        if low is not None:
            ok = ok & (by[metric] >= low)
        if high is not None:
            ok = ok & (by[metric] <= high)
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept to ``docs``.

    Null and empty texts have no words, fail the base and are not kept. Rows are looked at one by one, so repeated
    rows get equal results and an empty table an empty one. Columns of ``docs`` that bear one of these names are
    replaced, all others are kept whatever they are called. A 64-bit hash stands for each window of eight words.
    """
    # the caller's columns travel inside one struct, so that none of them meets a name used here
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), F.col(text).alias("_text"))
    for layer in base_metrics(F.col("_text")):
        x = x.withColumns(layer)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    x = x.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    # a filter on a result must not be pushed below the layers: it would repeat their expressions
    given = [F.col("_given")[c].alias(c) for c in docs.columns if c not in RESULTS]
    return x.select(*given, F.inline(F.array(F.struct(*RESULTS))))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every whole text of
    ``documents``; nulls, empty texts and repeated rows as in ``quality_rules``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + "]"


OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS id FROM documents),
g AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT id, sum(least(8, i - coalesce(last, -8)))::BIGINT AS n FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS last FROM r) GROUP BY id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: list_contains(STOPS, lower(x)))) AS stops, len(list_filter(lines, lambda x: contains(x, '|'))) AS bare
    FROM w LEFT JOIN n USING (id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 1000000
    AND word_chars / nw BETWEEN 1.5 AND 25.0 AND n_symbols / nw <= 0.30 AND stops / nw >= 0.02 AND n_dup_lines / nl <= 0.70 AND bare / nl <= 0.95
    AND (n_lines - n_dup_lines) / nl >= 0.05 AND n_words / nl >= 1.0 AS kept FROM b
""".replace("STOPS", _sql_list(STOP_WORDS))
