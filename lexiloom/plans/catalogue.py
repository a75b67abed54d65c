"""The catalogue of queries over the corpus tables, each with SQL that gives the same rows where SQL can.

Every query runs over its whole table. Bytes are shown as capital hexadecimal digits. Where a query's SQL runs
over ``benchmark`` or ``part``, the query of the same name with ``_documents`` does the same over the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytestrings as B
from ..functions import codec
from ..operators import batches, bpb, bpe, grams, lattice, learner, matching, records, segment, tokenset
from ..session import shared_folder, spread, table, written
from ..sources import shards, tokensets
from ..streaming import counts as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def corpus(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, data): the UTF-8 bytes of a table's texts; null is empty."""
    return spread(table(spark, folder, name).select(key, text)).select(key, B.utf8(F.coalesce(F.col(text), F.lit(""))).alias("data"))


def benchmark(spark, folder):
    return corpus(spark, folder, "benchmark", "item_id")


def names(spark, folder):
    return corpus(spark, folder, "part", "p_partkey", "p_name")


#: Byte codes of a text as a SQL list.
BYTES = "regexp_extract_all(hex(encode(coalesce({}, ''))), '..')"

# ---------------------------------------------------------------- corpus and grams


@query("corpus_byte_stats", "SELECT lang, count(*) AS n_docs, count(DISTINCT text) AS n_distinct, sum(strlen(text))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars, max(strlen(text))::BIGINT AS max_bytes FROM documents GROUP BY lang")
def corpus_byte_stats(spark, folder):
    d = table(spark, folder, "documents").select("lang", "text", F.octet_length("text").alias("b"), F.length("text").alias("c"), *[F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(k), "text")).alias(f"h{k}") for k in (1, 2)])
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("h1", "h2").alias("n_distinct"), F.sum("b").alias("n_bytes"), F.sum("c").alias("n_chars"), F.max("b").cast("bigint").alias("max_bytes"))


@query("single_byte_histogram", f"SELECT ('0x' || h)::INT AS byte, count(*) AS n FROM (SELECT unnest({BYTES.format('text')}) AS h FROM documents) GROUP BY h")
def single_byte_histogram(spark, folder):
    return grams.gram_counts(corpus(spark, folder), [1]).select(B.packed_index("gram").cast("int").alias("byte"), "n")


def gram_sql(n: int, name: str = "documents", text: str = "text") -> str:
    pick = " || ".join(f"h[i + {k}]" for k in range(n))
    return f"SELECT {n} AS len, {pick} AS gram FROM (SELECT h, unnest(range(1, len(h) - {n - 2})) AS i FROM (SELECT {BYTES.format(text)} AS h FROM {name}) WHERE len(h) >= {n})"


def apart_sql(n: int, gram: str = "gram", code: str = "y") -> str:
    """Non-overlapping occurrences on codes with a comma after each byte."""
    return f"sum((length({code}) - length(replace({code}, regexp_replace({gram}, '(..)', '\\1,', 'g'), ''))) // {3 * n})::BIGINT"


@query("ngram_top_k", f"""WITH t AS (SELECT gram, count(*) AS n_total FROM ({gram_sql(4)}) GROUP BY gram ORDER BY n_total DESC, gram LIMIT 20),
y AS (SELECT regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g') AS y FROM documents)
SELECT gram, n_total, {apart_sql(4)} AS n_nonoverlap FROM t, y GROUP BY gram, n_total""")
def ngram_top_k(spark, folder):
    x = grams.top_grams_with_nonoverlap(corpus(spark, folder), 4, 20)
    return x.select(F.hex("gram").alias("gram"), "n_total", "n_nonoverlap")


@query("ngram_top_k_per_length", f"""SELECT len, gram, n, rank FROM (SELECT len, gram, count(*) AS n, row_number() OVER (PARTITION BY len ORDER BY count(*) DESC, gram)::INT AS rank
FROM ({' UNION ALL '.join(gram_sql(n) for n in (2, 3, 5, 8))}) GROUP BY len, gram) WHERE rank <= 10""")
def ngram_top_k_per_length(spark, folder):
    return grams.top_grams(grams.gram_counts(corpus(spark, folder), [2, 3, 5, 8]), 10).select("len", F.hex("gram").alias("gram"), "n", "rank")


@query("ngram_by_expressions", f"SELECT len, gram, count(*) AS n FROM ({gram_sql(3, 'benchmark')}) GROUP BY len, gram")
def ngram_by_expressions(spark, folder):
    return grams.gram_counts_sql(benchmark(spark, folder), 3).select("len", F.hex("gram").alias("gram"), "n")


@query("ngram_nonoverlap_counts", f"""WITH t AS (SELECT gram, count(*) AS n_total FROM ({gram_sql(2, 'benchmark')}) GROUP BY gram ORDER BY n_total DESC, gram LIMIT 50),
y AS (SELECT regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g') AS y FROM benchmark)
SELECT gram, n_total, {apart_sql(2)} AS n_nonoverlap FROM t, y GROUP BY gram, n_total""")
def ngram_nonoverlap_counts(spark, folder):
    x = grams.miner(benchmark(spark, folder), [2], 50)
    return x.select(F.hex("gram").alias("gram"), "n_total", "n_nonoverlap")


@query("all_substring_counts", f"SELECT len, gram, count(*) AS n FROM ({' UNION ALL '.join(gram_sql(n, 'part', 'p_name') for n in range(1, 13))}) GROUP BY len, gram")
def all_substring_counts(spark, folder):
    return grams.gram_counts(names(spark, folder), list(range(1, 13))).select("len", F.hex("gram").alias("gram"), "n")


@query("weighted_string_dedup", "SELECT length(p_type)::INT AS length, p_type AS content, sum(p_size)::BIGINT AS frequency FROM part GROUP BY p_type")
def weighted_string_dedup(spark, folder):
    p = table(spark, folder, "part")
    return grams.weighted_strings(p.select(F.length("p_type").alias("length"), F.col("p_type").alias("content"), F.col("p_size").alias("frequency")))


@query("weighted_lines", "SELECT length(p_name)::INT AS length, p_name AS content, p_size::BIGINT AS frequency FROM part")
def weighted_lines(spark, folder):
    """The text form of the table, with blank and broken lines in between, is parsed again."""
    p = table(spark, folder, "part")
    good = p.select(F.concat_ws(",", F.length("p_name"), "p_name", "p_size").alias("value"))
    odd = p.select(F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.concat_ws(",", "p_size", "p_name")).alias("value"))
    return tokensets.weighted_lines(good.unionByName(odd))[0]


@query("count_min_error", f"""WITH g AS (SELECT gram, count(*) AS n FROM ({gram_sql(4)}) GROUP BY gram)
SELECT count(*) AS n_grams, sum(n)::BIGINT AS n_total, 0::BIGINT AS n_below, true AS mean_error_is_small FROM g""")
def count_min_error(spark, folder):
    """Sketch estimates of all byte 4-grams of the corpus against their counts: how many lie below (none may), and
    whether the mean error is at most that of 2.72 grams a slot. The width follows the number of grams."""
    data = corpus(spark, folder)
    exact = written(grams.gram_counts(data, [4]).select("gram", "n"), "count-min")
    k, total = exact.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(grams.SLAB, 1 << max(0, k - 1).bit_length())
    est = grams.count_min_estimates(grams.count_min(data, 4, width), exact.select("gram"), width)
    x = grams.sketch_error(est, exact)
    return x.agg(F.count("*").alias("n_grams"), F.sum("n").alias("n_total"), F.count(F.when(F.col("est") < F.col("n"), 1)).alias("n_below"), (F.avg(F.col("est") - F.col("n")) <= 2.72 * total / width).alias("mean_error_is_small"))


@query("count_min_file_roundtrip", f"SELECT gram, count(*) AS n, true AS enough FROM ({gram_sql(2, 'benchmark')}) GROUP BY gram")
def count_min_file_roundtrip(spark, folder):
    """The sketches of two halves of a corpus are saved, loaded, merged and asked."""
    import uuid

    data = benchmark(spark, folder)
    paths = [f"{shared_folder(spark)}/lexiloom/sketch-{uuid.uuid4().hex}" for _ in range(2)]
    for k, path in enumerate(paths):
        half = data.filter(F.pmod(F.xxhash64("item_id"), F.lit(2)) == k)
        grams.save_sketch(grams.count_min(half, 2, 1 << 14, 4), path, width=1 << 14, depth=4, seed=1, length=2)
    loaded = [grams.load_sketch(spark, path) for path in paths]
    about = loaded[0][1]
    exact = grams.gram_counts(data, [about["length"]]).select("gram", "n")
    est = grams.count_min_estimates(grams.merge_sketches(*(x for x, _ in loaded)), exact.select("gram"), about["width"], about["depth"], about["seed"])
    return est.join(exact, "gram").select(F.hex("gram").alias("gram"), "n", (F.col("est") >= F.col("n")).alias("enough"))


@query("two_pass_counts", f"SELECT 5 AS len, gram, count(*) AS n FROM ({gram_sql(5)}) GROUP BY gram HAVING count(*) >= 20")
def two_pass_counts(spark, folder):
    """Byte 5-grams that stand twenty times or more: a sketch first, then exact counts of what may reach that."""
    return grams.survivors(corpus(spark, folder), 5, 20).select("len", F.hex("gram").alias("gram"), "n")


@query("ngram_top_many", f"""SELECT len, gram, n, rank FROM (SELECT len, gram, count(*) AS n, row_number() OVER (PARTITION BY len ORDER BY count(*) DESC, gram)::INT AS rank
FROM ({' UNION ALL '.join(gram_sql(n) for n in (3, 4))}) GROUP BY len, gram) WHERE rank <= 5000""")
def ngram_top_many(spark, folder):
    """The 5,000 most frequent grams of two lengths, ranked by blocks and not by one task a length."""
    return grams.top_grams(grams.gram_counts(corpus(spark, folder), [3, 4]), 5000).select("len", F.hex("gram").alias("gram"), "n", "rank")


@query("approx_top_words")
def approx_top_words(spark, folder):
    """Extension: the 20 most frequent words by a mergeable sketch."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''")
    return words.agg(F.expr("approx_top_k(word, 20, 100000)").alias("t")).select(F.inline("t"))


@query("ngram_counts_streaming", f"SELECT gram, count(*) AS n FROM ({gram_sql(3, 'benchmark')}) GROUP BY gram")
def ngram_counts_streaming(spark, folder):
    return _streamed(spark, f"{folder}/benchmark.parquet", "gram_counts_stream")


def _streamed(spark, path: str, name: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else path[:-1] + "[t]")  # streams read folders and patterns
    out = streaming.run_to_end(streaming.streaming_gram_counts(docs, 3), name)
    return out.select(F.hex("gram").alias("gram"), "n")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("event_windows", """SELECT time_bucket(INTERVAL 5 MINUTES, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, folder):
    """Extension: windowed counts of events (the batch form of the stream)."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = streaming.event_windows(e)
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---------------------------------------------------------------- token tables


def candidate_tokens(spark, folder) -> DataFrame:
    """Words of pages, pairs of neighbours of the benchmark's words, words with a space after, and byte 3-grams."""
    words = lambda t: F.filter(F.split(t, "[ \t\n\r\f\x0b]+"), lambda w: w != "")
    p = table(spark, folder, "pages").select(F.explode(words(F.col("html"))).alias("w"))
    b = table(spark, folder, "benchmark").select(words(F.col("text")).alias("w"))
    pair = b.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).alias("w"))
    after = b.select(F.explode("w").alias("w")).select(F.concat("w", F.lit(" ")).alias("w"))
    text = p.unionByName(pair).unionByName(after).distinct().select(B.utf8("w").alias("token"))
    three = grams.gram_counts(benchmark(spark, folder), [3]).select(F.col("gram").alias("token"))
    return text.unionByName(three).distinct()


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^ \t\n\r\f\x0B]+')"
TOKENS_SQL = rf"""tokens AS (SELECT DISTINCT token FROM (
SELECT hex(encode(unnest({_WORDS.format('html')}))) AS token FROM pages
UNION ALL SELECT hex(encode(unnest(CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) ELSE w END))) FROM (SELECT {_WORDS.format('text')} AS w FROM benchmark)
UNION ALL SELECT hex(encode(unnest(w) || ' ')) FROM (SELECT {_WORDS.format('text')} AS w FROM benchmark)
UNION ALL SELECT gram FROM ({gram_sql(3, 'benchmark')}))),
v AS (SELECT token, regexp_replace(token, '(..)', '\1,', 'g') AS x FROM tokens),
r AS (SELECT token, x, CASE
  WHEN regexp_matches(x, '3[0-9],') AND regexp_matches(x, '([0-24-9A-F][0-9A-F]|3[A-F]),') THEN 'digits_and_others'
  WHEN regexp_matches(x, '(4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]),.*20,$') THEN 'letters_then_space'
  WHEN len(regexp_extract_all(x, '3[0-9],')) > 3 THEN 'over_three_digits'
  WHEN NOT starts_with(x, '20,') AND regexp_matches(x, '(4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]),') AND regexp_matches(x, '20,') THEN 'latin_with_inner_space'
  WHEN regexp_matches(x, '^(([89AB].,){{3}}|([89AB].,){{1,2}}($|[0-7C-F].,))') AND
    regexp_matches(regexp_replace(x, '^([89AB].,){{1,3}}', ''), '^([0-7].,|[CD].,[89AB].,|E.,([89AB].,){{2}}|F[0-7],([89AB].,){{3}})*([CD].,|E.,([89AB].,)?|F[0-7],([89AB].,){{0,2}})?$')
    AND length(regexp_replace(x, '^([89AB].,){{1,3}}', '')) > 0 THEN 'tail_of_a_character' END AS reason FROM v)"""


@query("token_filter_reasons", f"WITH {TOKENS_SQL} SELECT token, reason FROM r")
def token_filter_reasons(spark, folder):
    return tokenset.with_reasons(candidate_tokens(spark, folder)).select(F.hex("token").alias("token"), "reason")


@query("token_filter_stats", f"""WITH {TOKENS_SQL}, names AS (SELECT unnest(['digits_and_others', 'letters_then_space', 'over_three_digits', 'latin_with_inner_space', 'tail_of_a_character', 'kept']) AS reason)
SELECT names.reason, count(r.token) AS n FROM names LEFT JOIN r ON names.reason = coalesce(r.reason, 'kept') GROUP BY names.reason""")
def token_filter_stats(spark, folder):
    return tokenset.filter_stats(candidate_tokens(spark, folder))


@query("tokens_kept", f"WITH {TOKENS_SQL} SELECT token FROM r WHERE reason IS NULL OR length(token) = 2")
def tokens_kept(spark, folder):
    return tokenset.kept(candidate_tokens(spark, folder)).select(F.hex("token").alias("token"))


_UNION = f"""u AS (SELECT gram AS token FROM ({gram_sql(2, 'benchmark')}) UNION SELECT gram FROM ({gram_sql(3, 'part', 'p_name')}) UNION SELECT gram FROM ({gram_sql(1, 'benchmark')}) UNION SELECT printf('%02X', i) FROM range(256) t(i))"""


@query("tokenset_union_complete", f"WITH {_UNION} SELECT (row_number() OVER (ORDER BY length(token), token) - 1)::BIGINT AS token_id, (length(token) // 2)::INT AS len, token FROM u")
def tokenset_union_complete(spark, folder):
    a = grams.gram_counts(benchmark(spark, folder), [1, 2]).select(F.col("gram").alias("token"))
    b = grams.gram_counts(names(spark, folder), [3]).select(F.col("gram").alias("token"))
    return tokenset.union_complete(a, b).select("token_id", "len", F.hex("token").alias("token"))


_COUNTED = f"c AS (SELECT len, gram AS token, count(*) AS n FROM ({' UNION ALL '.join(gram_sql(n, 'benchmark') for n in (1, 2, 3, 4))}) GROUP BY len, gram)"


def counted_tokens(spark, folder) -> DataFrame:
    return grams.gram_counts(benchmark(spark, folder), [1, 2, 3, 4]).select("len", F.col("gram").alias("token"), "n")


@query("tokenset_length_histogram", f"WITH {_COUNTED} SELECT len, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM c GROUP BY len")
def tokenset_length_histogram(spark, folder):
    return tokenset.length_histogram(counted_tokens(spark, folder))


@query("tokenset_top_n", f"WITH {_COUNTED} SELECT token, n FROM c WHERE n >= 5 ORDER BY n DESC, token LIMIT 50")
def tokenset_top_n(spark, folder):
    return tokenset.top_tokens(counted_tokens(spark, folder), 50, 5).select(F.hex("token").alias("token"), "n")


@query("tokenset_summary", f"WITH {_COUNTED} SELECT count(*) AS n_tokens, max(n) AS max_count, min(n) AS min_count, sum(n)::BIGINT AS sum_count, avg(n) AS mean_count, count(*) FILTER (len > 1) AS n_multi_byte FROM c")
def tokenset_summary(spark, folder):
    return tokenset.summary(counted_tokens(spark, folder))


@query("token_independence", """WITH c AS (SELECT DISTINCT p_name AS token FROM part), a AS (SELECT * FROM (VALUES ('ring'), ('red w'), ('tt'), ('bol'), ('dget x')) t(other)),
x AS (SELECT DISTINCT token FROM c, a WHERE contains(token, other) OR contains(other, token)
  OR EXISTS (SELECT 1 FROM range(1, least(length(token), length(other))) r(k) WHERE substr(token, length(token) - k + 1) = substr(other, 1, k) OR substr(other, length(other) - k + 1) = substr(token, 1, k)))
SELECT c.token, x.token IS NOT NULL AS conflict FROM c LEFT JOIN x USING (token)""")
def token_independence(spark, folder):
    c = names(spark, folder).select(F.col("data").alias("token")).distinct()
    a = spark.createDataFrame([(t,) for t in (b"ring", b"red w", b"tt", b"bol", b"dget x")], "token binary")
    return tokenset.conflicts(c, a).select(F.decode("token", "utf-8").alias("token"), "conflict")


# ---------------------------------------------------------------- matches

COMMON = ["th", "the", "he", "er", "on", "an", "nan", "re", "in", "ion", "and", "ing", "ent", "é", "que", "nn", "ee", " t", "e "]
#: A dictionary that spells every part name.
PIECES = [*"abcdefghijklmnopqrstuvwxyz ", "re", "red", "ed", "in", "ing", "ring", "bo", "olt", "bolt", "wid", "widget", "get", "sm", "all", "small", "l r", "ue", "blue", "ge", "ll"]


def sql_list(tokens) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in tokens) + "]"


def dictionary(tokens) -> matching.Dictionary:
    return matching.Dictionary([t.encode("utf-8") for t in tokens])


def match_sql(tokens, name: str, key: str, text: str) -> str:
    """Matches by byte codes: starts from 0, exclusive ends."""
    return f"""b AS (SELECT {key}, hex(encode(coalesce({text}, ''))) AS h FROM {name}),
dict AS (SELECT (row_number() OVER () - 1)::INT AS token_id, t, hex(encode(t)) AS g, length(hex(encode(t))) // 2 AS n FROM (SELECT unnest({sql_list(tokens)}) AS t)),
places AS (SELECT {key}, n, (i - 1)::INT AS s, array_to_string(z[i:i + n - 1], '') AS g FROM (SELECT {key}, n, z, unnest(range(1, len(z) - n + 2)) AS i FROM (SELECT {key}, regexp_extract_all(h, '..') AS z FROM b), (SELECT DISTINCT n::INT AS n FROM dict) WHERE len(z) >= n)),
m AS (SELECT {key}, s AS "start", (s + dict.n)::INT AS "end", token_id FROM places JOIN dict ON places.g = dict.g)"""


BENCH = match_sql(COMMON, "benchmark", "item_id", "text")
PART = match_sql(PIECES, "part", "p_partkey", "p_name")


@query("dictionary_matches", f'WITH {BENCH} SELECT item_id, "start", "end", token_id FROM m')
def dictionary_matches(spark, folder):
    return matching.matches(benchmark(spark, folder), dictionary(COMMON), "item_id")


@query("dictionary_matches_join", f'WITH {PART} SELECT p_partkey, "start", "end", token_id FROM m')
def dictionary_matches_join(spark, folder):
    d = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(PIECES)], "token_id int, token binary")
    return matching.matches_by_join(names(spark, folder), d, sorted({len(t) for t in PIECES}), "p_partkey")


@query("dictionary_matches_past_end", f"""WITH {PART}, e AS (SELECT p_partkey, length(p_name) AS size, k, token_id, length(t) AS n FROM part, dict, range(1, 6) r(k) WHERE k < length(t) AND k <= length(p_name) AND right(p_name, k) = left(t, k))
SELECT p_partkey, "start", "end", token_id FROM m UNION ALL SELECT p_partkey, (size - k)::INT, (size - k + n)::INT, token_id FROM e""")
def dictionary_matches_past_end(spark, folder):
    return matching.matches(names(spark, folder), dictionary(PIECES), "p_partkey", past_end=True)


_ASCII = [t for t in COMMON if t.isascii()]


@query("token_total_and_nonoverlap", f"""WITH dict AS (SELECT unnest({sql_list(_ASCII)}) AS t), a AS (SELECT gram, count(*) AS n_total FROM ({gram_sql(2)} UNION ALL {gram_sql(3)}) GROUP BY gram),
o AS (SELECT t, sum((length(text) - length(replace(text, t, ''))) // length(t))::BIGINT AS n_nonoverlap FROM documents, dict GROUP BY t)
SELECT dict.t AS token, coalesce(n_total, 0) AS n_total, n_nonoverlap, (n_nonoverlap * (length(t) - 1))::BIGINT AS est_savings FROM dict JOIN o USING (t) LEFT JOIN a ON hex(encode(t)) = gram""")
def token_total_and_nonoverlap(spark, folder):
    x = matching.match_counts(corpus(spark, folder), dictionary(_ASCII))
    return x.select(F.decode("token", "utf-8").alias("token"), "n_total", "n_nonoverlap", "est_savings")


@query("first_match_position", f'WITH {BENCH} SELECT item_id, token_id, min("end") AS first_end FROM m GROUP BY item_id, token_id')
def first_match_position(spark, folder):
    return matching.first_places(matching.matches(benchmark(spark, folder), dictionary(COMMON), "item_id"), "item_id")


@query("covered_occurrences", f"WITH {PART} SELECT token_id, sum(p_size)::BIGINT AS n_covered FROM m JOIN part USING (p_partkey) GROUP BY token_id")
def covered_occurrences(spark, folder):
    found = matching.matches(names(spark, folder).withColumnRenamed("p_partkey", "used_id"), dictionary(PIECES), "used_id")
    uses = table(spark, folder, "part").select(F.col("p_partkey").alias("used_id"), F.col("p_size").alias("n_uses"))
    return matching.covered(found, uses)


# ---------------------------------------------------------------- segmentations

_PLAIN = r"' ?[^ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+'"


@query("pre_segments", f"SELECT item_id, (unnest(range(len(s))) + 1)::INT AS pos, unnest(s) AS segment FROM (SELECT item_id, regexp_extract_all(text, {_PLAIN}) AS s FROM benchmark)")
def pre_segments(spark, folder):
    b = table(spark, folder, "benchmark")
    return b.select("item_id", F.posexplode(segment.pre_segments(F.col("text"), segment.PLAIN_SEGMENT)).alias("pos", "segment")).withColumn("pos", F.col("pos") + 1)


#: White space in SQL patterns, as the Unicode property has it.
_BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The pre-segments without look-ahead: a mark (U+F8FF) cuts each run of white space before its last character where a
#: word follows, and a run ends at the mark.
_MARKED = rf"regexp_replace(text, '([{_BLANK}])([{_BLANK}][^{_BLANK}])', '\1' || chr(63743) || '\2', 'g')"
_PRE = rf"'''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}\x{{F8FF}}]+|[{_BLANK}]+'"


@query("pre_segment_counts", f"SELECT segment, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_MARKED}, {_PRE})) AS segment FROM documents) GROUP BY segment")
def pre_segment_counts(spark, folder):
    """Counts of the byte-level pre-segments of the corpus."""
    return segment.segment_counts(spread(table(spark, folder, "documents").select("text")))


@query("pre_segments_of_odd_texts", f"""SELECT i, (unnest(range(len(s))) + 1)::INT AS pos, unnest(s) AS segment FROM (SELECT i, regexp_extract_all({_MARKED}, {_PRE}) AS s FROM
(SELECT p_partkey AS i, replace(replace(p_name, 'o', '  ' || chr(10) || chr(160)), 'e', '''ll 12x' || chr(233) || '!? ''s   ') || p_size || ' ' || chr(8195) AS text FROM part))""")
def pre_segments_of_odd_texts(spark, folder):
    """Runs of white space of several kinds, contractions, letters beyond ASCII, digits and marks."""
    text = F.concat(F.replace(F.replace("p_name", F.lit("o"), F.lit("  \n ")), F.lit("e"), F.lit("'ll 12xé!? 's   ")), "p_size", F.lit("  "))
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("i"), text.alias("text"))
    return p.select("i", F.posexplode(segment.pre_segments(F.col("text"))).alias("pos", "segment")).withColumn("pos", F.col("pos") + 1)


def cost_sql(tokens, banned: str | None = None) -> str:
    """Fewest-token counts of the distinct part names: one recursive step for each byte."""
    best = ", ".join(f"CASE WHEN i + 1 >= {len(t)} AND substr(t, i + 2 - {len(t)}, {len(t)}) = '{t}' THEN dp[i + 2 - {len(t)}] ELSE 1000000 END" for t in tokens if t != banned)
    return f"""(WITH RECURSIVE s(t, i, dp) AS (SELECT DISTINCT p_name, 0, [0] FROM part UNION ALL SELECT t, i + 1, list_append(dp, 1 + least({best})) FROM s WHERE i < length(t))
SELECT t, dp[length(t) + 1]::INT AS cost FROM s WHERE i = length(t))"""


@query("optimal_segmentation_cost", f"SELECT p_partkey, cost AS n_tokens FROM part JOIN {cost_sql(PIECES)} c ON p_name = c.t")
def optimal_segmentation_cost(spark, folder):
    return segment.covers(names(spark, folder), dictionary(PIECES), "p_partkey").select("p_partkey", "n_tokens")


@query("optimal_segmentation_fold", f"SELECT p_partkey, cost AS n_tokens FROM part JOIN {cost_sql(PIECES)} c ON p_name = c.t")
def optimal_segmentation_fold(spark, folder):
    """The same by expressions alone."""
    n = segment.cover_costs_sql(F.col("p_name"), [t.encode() for t in PIECES])
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    one = p.select("p_name").distinct().select("p_name", n.alias("n_tokens"))
    return p.join(one, "p_name").select("p_partkey", "n_tokens")


@query("corpus_token_total", f"SELECT count(*) AS n_texts, sum(cost)::BIGINT AS n_tokens FROM part JOIN {cost_sql(PIECES)} c ON p_name = c.t")
def corpus_token_total(spark, folder):
    return segment.cover_total(segment.covers(names(spark, folder), dictionary(PIECES), "p_partkey"))


@query("cover_usage")
def cover_usage(spark, folder):
    """Uses of each token in the fewest-token cover of the corpus (of equals, the longest last token), with bytes and common tokens."""
    d = matching.Dictionary([*learner.BYTES, *(t.encode() for t in COMMON)])
    return segment.cover_totals(corpus(spark, folder), d)


@query("greedy_longest_suffix")
def greedy_longest_suffix(spark, folder):
    """Each document cut from the right, the longest common token first."""
    x = segment.suffix_cuts(corpus(spark, folder), [t.encode() for t in COMMON])
    return x.select("doc_id", F.transform("tokens", lambda t: F.hex(t)).alias("tokens"))


@query("canonical_encoding")
def canonical_encoding(spark, folder):
    """Byte-pair encoding of the documents, and that it decodes to the same bytes."""
    tokens, data = [*learner.BYTES, *(t.encode() for t in COMMON)], corpus(spark, folder)
    x = segment.encode_texts(data, tokens)
    vocab = spark.createDataFrame(list(enumerate(tokens)), "token_id int, token binary").dropDuplicates(["token_id"])
    back = segment.decode_tokens(x, vocab).withColumnRenamed("data", "back")
    same = F.coalesce("back", F.lit(b"")) == F.col("data")  # an empty text has no tokens
    return x.join(data, "doc_id").join(back, "doc_id", "left").select("doc_id", F.size("token_ids").alias("n_tokens"), same.alias("same"))


# ---------------------------------------------------------------- codecs


@query("utf8_lax_validity", f"""SELECT gram, regexp_matches(x, '^([0-7].,|[CD].,[89AB].,|E.,([89AB].,){{2}}|F[0-7],([89AB].,){{3}})*$') AS valid FROM (SELECT DISTINCT gram, regexp_replace(gram, '(..)', '\\1,', 'g') AS x FROM ({gram_sql(3, 'benchmark')}))""")
def utf8_lax_validity(spark, folder):
    return grams.gram_counts(benchmark(spark, folder), [3]).select(F.hex("gram").alias("gram"), B.lax_utf8(F.col("gram")).alias("valid"))


@query("byte_letter_codec", """WITH b AS (SELECT i::INT AS byte, i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i >= 174 AS own FROM range(256) t(i))
SELECT byte, chr(CASE WHEN own THEN byte ELSE 255 + (sum((NOT own)::INT) OVER (ORDER BY byte))::INT END) AS letter, true AS back FROM b""")
def byte_letter_codec(spark, folder):
    x = codec.byte_table(spark)
    return x.select("byte", "letter", (codec.bytes_udf("letter") == F.col("token")).alias("back"))


@query("escape_roundtrip", f"SELECT gram, true AS same FROM ({gram_sql(3, 'benchmark')}) GROUP BY gram")
def escape_roundtrip(spark, folder):
    """Byte 3-grams, many of them no valid UTF-8, through the escape and back."""
    g = grams.gram_counts(benchmark(spark, folder), [3])
    return g.select(F.hex("gram").alias("gram"), (codec.unescape_udf(codec.escape_udf("gram")) == F.col("gram")).alias("same"))


@query("printable_tokens", f"""SELECT gram, array_to_string(list_transform(regexp_extract_all(gram, '..'), lambda h: CASE WHEN ('0x' || h)::INT BETWEEN 32 AND 126 THEN chr(('0x' || h)::INT) ELSE '\\x' || lower(h) END), '') AS shown
FROM ({gram_sql(2, 'benchmark')}) GROUP BY gram""")
def printable_tokens(spark, folder):
    return grams.gram_counts(benchmark(spark, folder), [2]).select(F.hex("gram").alias("gram"), B.printable(F.col("gram")).alias("shown"))


@query("ascii_upper", "SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS shown FROM benchmark")
def ascii_upper(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", B.ascii_upper("text").alias("shown"))


@query("gram_index_packing", f"SELECT gram, ('0x' || gram)::BIGINT AS packed FROM ({gram_sql(2)}) GROUP BY gram")
def gram_index_packing(spark, folder):
    return grams.gram_counts(corpus(spark, folder), [2]).select(F.hex("gram").alias("gram"), B.packed_index("gram").alias("packed"))


# ---------------------------------------------------------------- learning

LETTERS = [t for t in PIECES if len(t) == 1]
ASKED = ["ing", "ring", "bolt", "widget", "all", "l r"]


def _sum_cost(tokens, banned=None) -> str:
    return f"(SELECT sum(cost) FROM part JOIN {cost_sql(tokens, banned)} c ON p_name = c.t)"


def _times(t: str) -> str:
    return f"(SELECT count(*) FROM part, range(1, 30) r(i) WHERE substr(p_name, i::INT, {len(t)}) = '{t}')"


@query("candidate_savings", " UNION ALL ".join(f"SELECT '{t}' AS token, {_times(t)}::BIGINT AS n_occurrences, ({_sum_cost(LETTERS)} - {_sum_cost([*LETTERS, t])})::BIGINT AS savings" for t in ASKED))
def candidate_savings(spark, folder):
    x = learner.candidate_savings(names(spark, folder), [t.encode() for t in LETTERS], [t.encode() for t in ASKED])
    return x.select(F.decode("token", "utf-8").alias("token"), "n_occurrences", "savings")


@query("removal_loss", " UNION ALL ".join(f"SELECT '{t}' AS token, {_times(t)}::BIGINT AS n_occurrences, ({_sum_cost(PIECES, t)} - {_sum_cost(PIECES)})::BIGINT AS loss" for t in ASKED))
def removal_loss(spark, folder):
    x = learner.removal_loss(names(spark, folder), [t.encode() for t in PIECES], [t.encode() for t in ASKED])
    return x.select(F.decode("token", "utf-8").alias("token"), "n_occurrences", "loss")


def _learnt(spark, folder) -> tuple[DataFrame, list[bytes]]:
    """The documents, dealt to all cores, and their 20 most frequent grams of each of five lengths."""
    data = written(corpus(spark, folder), "learn")
    return data, [bytes(r["gram"]) for r in grams.top_grams(grams.gram_counts(data, [2, 3, 4, 5, 6]), 20).collect()]


@query("vocab_learn_step")
def vocab_learn_step(spark, folder):
    """The first tokens that join a vocabulary of single bytes, from the documents' most frequent grams."""
    data, candidates = _learnt(spark, folder)
    state = learner.State()
    learner.grow(data, state, candidates)
    return spark.createDataFrame([(s, a.decode("latin-1"), e) for s, a, _, e in state.history], "step int, added string, savings double")


@query("vocab_learn")
def vocab_learn(spark, folder):
    data, candidates = _learnt(spark, folder)
    state = learner.learn(data, candidates, 280, 8)
    return spark.createDataFrame([(i, t) for i, t in enumerate(state.vocab)], "token_id int, token binary").select("token_id", F.hex("token").alias("token"))


@query("bpe_pair_counts", "SELECT substr(p_name, i::INT, 1) AS \"first\", substr(p_name, i::INT + 1, 1) AS \"second\", sum(p_size)::BIGINT AS n FROM part, range(1, 30) r(i) WHERE i < length(p_name) GROUP BY ALL")
def bpe_pair_counts(spark, folder):
    p = table(spark, folder, "part")
    return bpe.pair_counts(bpe.segments(p, "p_name", "p_size"))


def _weighted(spark, folder):
    """The distinct byte-level pre-segments of the documents with their counts."""
    return segment.segment_counts(spread(table(spark, folder, "documents").select("text"))).select(F.col("segment").alias("content"), F.col("n").alias("frequency"))


@query("bpe_train")
def bpe_train(spark, folder):
    merged, _ = bpe.train(_weighted(spark, folder), 12)
    return spark.createDataFrame(list(enumerate(merged)), "rank int, token string")


@query("bpe_war")
def bpe_war(spark, folder):
    """Worth of each of twelve merged tokens over the documents' weighted pre-segments."""
    tokens, seg = bpe.train(_weighted(spark, folder), 12)
    return bpe.worth(seg, tokens)


# ---------------------------------------------------------------- bits per byte


@query("unigram_bpb", f"""WITH s AS (SELECT lang, unnest(regexp_extract_all(text, {_PLAIN})) AS w FROM documents), u AS (SELECT w, count(*) / (SELECT count(*) FROM s) AS p FROM s GROUP BY w)
SELECT lang, count(*) AS n_tokens, sum(strlen(w))::BIGINT AS n_bytes, round(avg(-ln(p)), 6) AS loss, round(count(*) / sum(strlen(w)) * avg(-ln(p)) / ln(2), 6) AS bpb FROM s JOIN u USING (w) GROUP BY lang""")
def unigram_bpb(spark, folder):
    d = spread(table(spark, folder, "documents").select("lang", "text"))
    scored = bpb.segment_bits(d, bpb.unigrams(d), "lang")
    return bpb.bits_per_byte(scored, ["lang"]).select("lang", "n_tokens", "n_bytes", F.round("loss", 6).alias("loss"), F.round("bpb", 6).alias("bpb"))


@query("perplexity", f"""WITH d AS (SELECT unnest(regexp_extract_all(text, {_PLAIN})) AS w FROM documents), u AS (SELECT w, count(*) / (SELECT count(*) FROM d) AS p FROM d GROUP BY w),
b AS (SELECT item_id, unnest(regexp_extract_all(text, {_PLAIN})) AS w FROM benchmark)
SELECT item_id, count(p) AS n_tokens, count(*) - count(p) AS n_unseen, round(exp(avg(-ln(p))), 4) AS perplexity FROM b LEFT JOIN u USING (w) GROUP BY item_id""")
def perplexity(spark, folder):
    """The benchmark's texts under the corpus's unigrams: perplexity over the segments the corpus has, and how many it lacks."""
    model = bpb.unigrams(table(spark, folder, "documents"))
    scored = bpb.segment_bits(table(spark, folder, "benchmark"), model, "item_id")
    return bpb.bits_per_byte(scored, ["item_id"]).select("item_id", "n_tokens", "n_unseen", F.round("perplexity", 4).alias("perplexity"))


_P = [round(1 / (3 + i), 6) for i in range(len(PIECES))]


def _paths_sql() -> str:
    terms = " + ".join(f"CASE WHEN i + 1 >= {len(t)} AND substr(t, i + 2 - {len(t)}, {len(t)}) = '{t}' THEN a[i + 2 - {len(t)}] * {p} ELSE 0 END" for t, p in zip(PIECES, _P, strict=True))
    tail = " + ".join(f"CASE WHEN length(t) >= {k} AND right(t, {k}) = '{t[:k]}' THEN a[length(t) + 1 - {k}] * {p} ELSE 0 END" for t, p in zip(PIECES, _P, strict=True) for k in range(1, len(t)))
    return f"""WITH RECURSIVE s(t, i, a) AS (SELECT DISTINCT p_name, 0, [1.0::DOUBLE] FROM part UNION ALL SELECT t, i + 1, list_append(a, ({terms})::DOUBLE) FROM s WHERE i < length(t)),
f AS (SELECT t, a[length(t) + 1] + {tail} AS p FROM s WHERE i = length(t))
SELECT p_partkey, length(p_name) AS n_bytes, round(-log2(p) / length(p_name), 8) AS bpb FROM part JOIN f ON p_name = f.t"""


@query("all_paths_bpb", _paths_sql())
def all_paths_bpb(spark, folder):
    x = bpb.all_paths_bpb(names(spark, folder), [t.encode() for t in PIECES], _P, "p_partkey")
    return x.select("p_partkey", "n_bytes", F.round("bpb", 8).alias("bpb"))


# ---------------------------------------------------------------- lattices

LATTICE = f'{PART}, l AS (SELECT p_partkey, "start" + 1 AS start1, "end" AS end1, token_id FROM m)'


def _lattice(spark, folder):
    return lattice.lattice(names(spark, folder), dictionary(PIECES), "p_partkey")


@query("token_lattice", f"WITH {LATTICE} SELECT p_partkey, start1::INT AS start1, end1, token_id, end1 / 4.0 AS position, (start1 + end1 - 1) / 4.0 AS position_compat FROM l")
def token_lattice(spark, folder):
    return lattice.end_positions(_lattice(spark, folder))


@query("token_ancestry", f"""WITH one AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), {LATTICE.replace('FROM part)', 'FROM one)')},
x AS (SELECT a.p_partkey, a.token_id, a.start1, b.token_id AS anc_id, b.start1 AS anc_start FROM l a JOIN l b ON a.p_partkey = b.p_partkey AND b.end1 < a.start1 UNION ALL SELECT p_partkey, token_id, start1, token_id, start1 FROM l)
SELECT part.p_partkey, token_id, start1::INT AS start1, anc_id, anc_start::INT AS anc_start FROM x JOIN one USING (p_partkey) JOIN part ON part.p_name = one.p_name""")
def token_ancestry(spark, folder):
    return lattice.text_ancestry(names(spark, folder), dictionary(PIECES), "p_partkey")


@query("ancestor_counts", f"WITH {LATTICE} SELECT a.p_partkey, a.token_id, a.start1::INT AS start1, count(b.token_id) AS position FROM l a LEFT JOIN l b ON a.p_partkey = b.p_partkey AND b.end1 < a.start1 GROUP BY ALL")
def ancestor_counts(spark, folder):
    return lattice.ancestor_counts(_lattice(spark, folder), "p_partkey")


_FREE = "o AS (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE a.p_partkey = b.p_partkey AND b.start1 <= a.start1 AND a.end1 <= b.end1 AND a.token_id <> b.token_id))"
_MEANS = "c AS (SELECT p_partkey, byte::INT AS byte, avg((token_id + 1) / 10.0) AS mean FROM (SELECT p_partkey, token_id, unnest(range(start1, end1 + 1)) AS byte FROM o) GROUP BY ALL)"


@query("non_dominated_tokens", f"WITH {LATTICE}, {_FREE} SELECT p_partkey, start1::INT AS start1, end1, token_id FROM o")
def non_dominated_tokens(spark, folder):
    return lattice.non_dominated(_lattice(spark, folder), "p_partkey")


def _params(spark):
    return spark.createDataFrame([(i, (i + 1) / 10.0) for i in range(len(PIECES))], "token_id int, param double")


@query("byte_coverage_mean", f"WITH {LATTICE}, {_FREE}, {_MEANS} SELECT p_partkey, byte, round(mean, 9) AS mean FROM c")
def byte_coverage_mean(spark, folder):
    x = lattice.byte_means(lattice.non_dominated(_lattice(spark, folder), "p_partkey"), _params(spark), "p_partkey")
    return x.select("p_partkey", "byte", F.round("mean", 9).alias("mean"))


@query("cumulative_position", f"WITH {LATTICE}, {_FREE}, {_MEANS} SELECT l.p_partkey, token_id, start1::INT AS start1, round(sum(mean), 8) AS position FROM l JOIN c ON l.p_partkey = c.p_partkey AND c.byte <= l.end1 GROUP BY ALL")
def cumulative_position(spark, folder):
    rows = _lattice(spark, folder)
    means = lattice.byte_means(lattice.non_dominated(rows, "p_partkey"), _params(spark), "p_partkey")
    return lattice.cumulative(rows, means, "p_partkey").withColumn("position", F.round("position", 8))


@query("invariant_encoding")
def invariant_encoding(spark, folder):
    """The first 16 lattice tokens of each document with order, number of ancestors and position."""
    params = spark.createDataFrame([(i, (i + 1) / 10.0) for i in range(len(COMMON))], "token_id int, param double")
    return lattice.encoding(corpus(spark, folder), dictionary(COMMON), params, 16).select("doc_id", "slot", "token_id", "start1", "n_ancestors", F.round("position", 8).alias("position"))


@query("spell_loss", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE label <> 0),
a AS (SELECT *, avg(x) OVER (PARTITION BY label, dim) AS m, count(*) OVER (PARTITION BY label, dim) AS k FROM e)
SELECT count(DISTINCT vec_id) AS n_tokens, round(sum((x - m) ** 2) / count(DISTINCT vec_id), 6) AS loss FROM a WHERE k > 1""")
def spell_loss(spark, folder):
    x = lattice.spell_loss(table(spark, folder, "embeddings"), "label", "embedding", "vec_id")
    return x.select("n_tokens", F.round("loss", 6).alias("loss"))


# ---------------------------------------------------------------- token streams


def stream(spark, folder) -> DataFrame:
    """(shard, pos, token_id, n_bytes): the words of each conversation, a separator before each turn."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r\f\x0b]+"), lambda w: w != "")
    rows = F.concat(F.array(F.struct(F.lit(batches.EOT).alias("token_id"), F.lit(0).alias("n_bytes"))), F.transform(words, lambda w: F.struct((F.ascii(w) % 1000 * 50 + F.least(F.length(w), F.lit(49))).cast("int").alias("token_id"), F.octet_length(w).alias("n_bytes"))))
    t = table(spark, folder, "conversations").select(F.col("conv_id").alias("shard"), F.col("turn").cast("bigint").alias("turn"), F.posexplode(rows).alias("i", "t"))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("shard").orderBy("turn", "i")) - 1
    return t.select("shard", pos.cast("bigint").alias("pos"), "t.token_id", "t.n_bytes")


STREAM = rf"""w AS (SELECT conv_id AS shard, turn, list_prepend(NULL, {_WORDS.format('text')}) AS ws FROM conversations),
x AS (SELECT shard, turn, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
st AS (SELECT shard, (row_number() OVER (PARTITION BY shard ORDER BY turn, i) - 1)::BIGINT AS pos, CASE WHEN i = 0 THEN 50256 ELSE (unicode(word) % 1000 * 50 + least(length(word), 49))::INT END::INT AS token_id, coalesce(strlen(word), 0)::INT AS n_bytes FROM x),
dd AS (SELECT *, (sum((token_id = 50256)::INT) OVER (PARTITION BY shard ORDER BY pos))::BIGINT AS doc FROM st)"""


@query("token_stream_doc_ids", f"WITH {STREAM} SELECT shard, pos, token_id, doc FROM dd")
def token_stream_doc_ids(spark, folder):
    return batches.document_ids(stream(spark, folder)).select("shard", "pos", "token_id", "doc")


@query("stream_documents", f"WITH {STREAM} SELECT shard, doc, count(*)::INT AS n_tokens, sum(token_id)::BIGINT AS id_sum FROM dd WHERE token_id <> 50256 GROUP BY ALL")
def stream_documents(spark, folder):
    x = batches.documents(stream(spark, folder))
    return x.select("shard", "doc", "n_tokens", F.aggregate("token_ids", F.lit(0).cast("bigint"), lambda s, t: s + t).alias("id_sum"))


@query("next_token_labels", f"WITH {STREAM} SELECT shard, pos, token_id, coalesce(lead(token_id) OVER (PARTITION BY shard ORDER BY pos), -100) AS label FROM st")
def next_token_labels(spark, folder):
    return batches.next_tokens(stream(spark, folder)).select("shard", "pos", "token_id", "label")


@query("token_end_offsets", f"WITH {STREAM} SELECT shard, pos, CASE WHEN token_id = 50256 THEN 0 ELSE (sum(n_bytes) OVER (PARTITION BY shard ORDER BY pos))::BIGINT END AS end_offset FROM st")
def token_end_offsets(spark, folder):
    return batches.end_offsets(stream(spark, folder)).select("shard", "pos", "end_offset")


_SIZES = r"d AS (SELECT doc_id, (1 + len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')))::BIGINT AS n_tokens FROM documents), o AS (SELECT *, (sum(n_tokens) OVER (ORDER BY doc_id) - n_tokens)::BIGINT AS \"offset\" FROM d)".replace('\\"', '"')


def sized(spark, folder):
    words = F.regexp_count("text", F.lit("[^ \t\n\r\f\x0b]+"))
    return table(spark, folder, "documents").select("doc_id", (F.coalesce(words, F.lit(0)) + 1).cast("bigint").alias("n_tokens"))


@query("shard_assignment", f"""WITH {_SIZES}, p AS (SELECT *, unnest(range("offset" // 100000, ("offset" + n_tokens - 1) // 100000 + 1))::INT AS shard FROM o)
SELECT doc_id, shard, CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split, (greatest("offset", shard * 100000::BIGINT) - "offset")::BIGINT AS "from", (least("offset" + n_tokens, (shard + 1) * 100000::BIGINT) - "offset")::BIGINT AS "to", (greatest("offset", shard * 100000::BIGINT) - shard * 100000::BIGINT)::BIGINT AS "at" FROM p""")
def shard_assignment(spark, folder):
    """Documents of one separator and their words, cut into shards of 100,000 tokens."""
    x = batches.shard_pieces(batches.global_offsets(written(sized(spark, folder), "sizes"), "doc_id", "n_tokens"), 100_000)
    return x.select("doc_id", "shard", "split", "from", "to", "at")


@query("training_batches", f"""WITH {STREAM}, n AS (SELECT shard, count(*) AS n FROM st GROUP BY shard), b AS (SELECT shard, unnest(range((n - 1) // 64))::INT AS batch FROM n)
SELECT shard, batch, r::INT AS rank, (batch * 64 + r * 16)::BIGINT AS "from", (batch * 64 + r * 16 + 17)::BIGINT AS "to" FROM b, range(4) t(r)""")
def training_batches(spark, folder):
    lengths = stream(spark, folder).groupBy("shard").agg(F.count("*").alias("n_tokens"))
    return batches.training_batches(lengths, 64, 4)


@query("shard_file_roundtrip", f"WITH {STREAM} SELECT 'tokens_train_' || lpad(shard::VARCHAR, 6, '0') || '.bin' AS shard, pos, token_id FROM st WHERE shard > 0 UNION ALL SELECT 'tokens_val_000000.bin', pos, token_id FROM st WHERE shard = 0")
def shard_file_roundtrip(spark, folder):
    """Each conversation is written as a shard file; the files are read through the token shard source."""
    import uuid

    s = stream(spark, folder).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("t"))
    pieces = s.select(F.col("shard").cast("int").alias("shard"), F.when(F.col("shard") == 0, "val").otherwise("train").alias("split"), F.lit(0).cast("bigint").alias("at"), F.col("t.token_id").alias("token_ids"))
    out = f"{shared_folder(spark)}/lexiloom/shards-{uuid.uuid4().hex}"
    written(shards.write_shards(pieces, out), "shard-files")
    spark.dataSource.register(shards.ShardSource)
    return spark.read.format("tokenshard").option("path", out).load()


_BLOCKS = f"{STREAM}, bl AS (SELECT shard, (pos // 16)::INT AS b, min(doc) AS lo, max(doc) AS hi FROM dd GROUP BY ALL HAVING count(*) = 16), mk AS (SELECT q.shard, q.b AS q, k.b AS k, q.b > k.b AND q.lo = k.hi AND q.hi = k.lo AS \"full\" FROM bl q JOIN bl k ON q.shard = k.shard AND q.b >= k.b AND q.lo <= k.hi AND q.hi >= k.lo)"


def _mask(spark, folder):
    return batches.block_mask(batches.blocks(batches.document_ids(stream(spark, folder)), 16))


@query("document_block_mask", f'WITH {_BLOCKS} SELECT shard, q, k, "full" FROM mk')
def document_block_mask(spark, folder):
    return _mask(spark, folder)


@query("sliding_window_blocks", f"""WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard, q, "full" ORDER BY k DESC) AS r, sum("full"::INT) OVER (PARTITION BY shard, q) AS n FROM mk)
SELECT shard, q, k, "full" FROM r WHERE CASE WHEN "full" THEN r <= 2 ELSE r <= greatest(3 - n, 1) END""")
def sliding_window_blocks(spark, folder):
    return batches.sliding_blocks(_mask(spark, folder), 3)


@query("lr_schedule", "SELECT i AS step, round(CASE WHEN i / 1390.0 < 1 - 0.4 THEN 1.0 ELSE (1 - i / 1390.0) / 0.4 + (1 - (1 - i / 1390.0) / 0.4) * 0.1 END, 9)::DOUBLE AS lr, round((1 - least(i / 300.0, 1)) * 0.85 + least(i / 300.0, 1) * 0.95, 9)::DOUBLE AS momentum FROM range(1390) t(i)")
def lr_schedule(spark, folder):
    s = spark.range(1390).withColumnRenamed("id", "step")
    return s.select("step", F.round(batches.learning_rate(F.col("step"), 1390), 9).alias("lr"), F.round(batches.momentum(F.col("step")), 9).alias("momentum"))


@query("window_schedule", "SELECT i AS step, greatest(ceil(1728.0::DOUBLE * i / 1390.0::DOUBLE / 128), 1)::INT AS n_blocks FROM range(1391) t(i)")
def window_schedule(spark, folder):
    return spark.range(1391).select(F.col("id").alias("step"), batches.window_blocks(F.col("id"), 1390).alias("n_blocks"))


# ---------------------------------------------------------------- records and upkeep


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


@query("record_progression", f"""WITH r AS (SELECT n::INT AS n, minutes::DOUBLE AS minutes FROM (VALUES {_values(records.RECORD_MINUTES)}) t(n, minutes))
SELECT n, minutes, lag(minutes) OVER w AS previous, lag(minutes) OVER w / minutes AS speed_up, first(minutes) OVER w / minutes AS total_speed_up FROM r WINDOW w AS (ORDER BY n)""")
def record_progression(spark, folder):
    return records.progression(records.record_table(spark))


@query("run_significance", f"""SELECT count(*) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, round((avg(x) - 3.28) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM (SELECT unnest({records.RUN_LOSSES}::DOUBLE[]) AS x)""")
def run_significance(spark, folder):
    x = records.significance(records.run_table(spark))
    return x.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("t", 6).alias("t"), "df")


@query("stats_cache_valid", "SELECT 'same' AS what, true AS valid UNION ALL SELECT 'one text changed', false")
def stats_cache_valid(spark, folder):
    """The manifest of a corpus against itself, and against one in which the text of the least id differs."""
    m = table(spark, folder, "documents").select("doc_id", F.substring(F.sha1(B.utf8(F.coalesce("text", F.lit("")))), 1, 16).alias("hash"))
    first = m.agg(F.min("doc_id")).first()[0]
    other = m.withColumn("hash", F.when(F.col("doc_id") == first, "0").otherwise(F.col("hash")))
    return tokenset.differ(m, m).withColumn("what", F.lit("same")).unionByName(tokenset.differ(m, other).withColumn("what", F.lit("one text changed"))).select("what", "valid")


@query("content_fingerprints", "SELECT doc_id, substr(sha1(encode(coalesce(text, ''))), 1, 16) AS hash FROM documents")
def content_fingerprints(spark, folder):
    return tokensets.fingerprints(corpus(spark, folder).select(F.col("doc_id").alias("name"), F.col("data").alias("content"))).withColumnRenamed("name", "doc_id")


@query("corpus_sample_cursor", """WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
s AS (SELECT i, (n * 3 // 4 + i) % n AS k, i // n AS turn FROM n, range((SELECT n FROM n) * 3 // 2) t(i))
SELECT doc_id, turn::BIGINT AS turn FROM s JOIN o USING (k)""")
def corpus_sample_cursor(spark, folder):
    """One and a half passes from three quarters of the corpus on; ordinals come from block-wise running counts."""
    d = table(spark, folder, "documents").select("doc_id").withColumn("one", F.lit(1).cast("bigint"))
    o = batches.global_offsets(d, "doc_id", "one")
    n = d.count()
    return batches.cursor_sample(o, "offset", n * 3 // 4, n * 3 // 2, n).select("doc_id", "turn")


@query("tokenset_file_roundtrip", f"WITH {_COUNTED} SELECT 'counted' AS name, len, token, n FROM c UNION ALL SELECT 'legacy', len, token, NULL FROM c UNION ALL SELECT 'vocabulary', len, token, NULL FROM c")
def tokenset_file_roundtrip(spark, folder):
    """One token table in three binary forms and back."""
    rows = [(bytes(r["token"]), r["n"]) for r in counted_tokens(spark, folder).orderBy("len", "token").collect()]  # a vocabulary
    forms = [("counted", tokensets.pack_counted(rows)), ("legacy", tokensets.pack_legacy([t for t, _ in rows])), ("vocabulary", tokensets.pack_vocabulary([t for t, _ in rows]))]
    out = None
    for name, raw in forms:
        x = tokensets.read_tokens(spark.createDataFrame([(name, raw)], "name string, content binary"), name)
        out = x if out is None else out.unionByName(x)
    return out.select("name", "len", F.hex("token").alias("token"), "n")


# ---------------------------------------------------------------- the same over the documents

#: Spells every text. SQL for covers (by recursion) and matches is too slow on whole documents; tests compare with brute force.
SPELLING = [*learner.BYTES, *(t.encode() for t in COMMON)]
_SEGMENTS = f"SELECT unnest(regexp_extract_all(text, {_PLAIN})) AS w FROM documents"


@query("ngram_nonoverlap_counts_documents", f"""WITH t AS (SELECT gram, count(*) AS n_total FROM ({gram_sql(2)}) GROUP BY gram ORDER BY n_total DESC, gram LIMIT 50),
y AS (SELECT regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g') AS y FROM documents)
SELECT gram, n_total, {apart_sql(2)} AS n_nonoverlap FROM t, y GROUP BY gram, n_total""")
def ngram_nonoverlap_counts_documents(spark, folder):
    return grams.miner(corpus(spark, folder), [2], 50).select(F.hex("gram").alias("gram"), "n_total", "n_nonoverlap")


@query("ngram_counts_streaming_documents", f"SELECT gram, count(*) AS n FROM ({gram_sql(3)}) GROUP BY gram")
def ngram_counts_streaming_documents(spark, folder):
    return _streamed(spark, f"{folder}/documents.parquet", "gram_counts_stream_documents")


_COUNTED_DOCS = f"c AS (SELECT len, gram AS token, count(*) AS n FROM ({' UNION ALL '.join(gram_sql(n) for n in (1, 2, 3, 4))}) GROUP BY len, gram)"


def _counted_documents(spark, folder) -> DataFrame:
    return grams.gram_counts(corpus(spark, folder), [1, 2, 3, 4]).select("len", F.col("gram").alias("token"), "n")


@query("tokenset_length_histogram_documents", f"WITH {_COUNTED_DOCS} SELECT len, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM c GROUP BY len")
def tokenset_length_histogram_documents(spark, folder):
    return tokenset.length_histogram(_counted_documents(spark, folder))


@query("tokenset_top_n_documents", f"WITH {_COUNTED_DOCS} SELECT token, n FROM c WHERE n >= 5 ORDER BY n DESC, token LIMIT 50")
def tokenset_top_n_documents(spark, folder):
    return tokenset.top_tokens(_counted_documents(spark, folder), 50, 5).select(F.hex("token").alias("token"), "n")


@query("tokenset_summary_documents", f"WITH {_COUNTED_DOCS} SELECT count(*) AS n_tokens, max(n) AS max_count, min(n) AS min_count, sum(n)::BIGINT AS sum_count, avg(n) AS mean_count, count(*) FILTER (len > 1) AS n_multi_byte FROM c")
def tokenset_summary_documents(spark, folder):
    return tokenset.summary(_counted_documents(spark, folder))


@query("dictionary_matches_documents")
def dictionary_matches_documents(spark, folder):
    return matching.matches(corpus(spark, folder), dictionary(COMMON))


@query("dictionary_matches_past_end_documents")
def dictionary_matches_past_end_documents(spark, folder):
    return matching.matches(corpus(spark, folder), dictionary(COMMON), past_end=True)


@query("first_match_position_documents")
def first_match_position_documents(spark, folder):
    return matching.first_places(matching.matches(corpus(spark, folder), dictionary(COMMON)))


@query("pre_segments_documents", f"SELECT doc_id, (unnest(range(len(s))) + 1)::INT AS pos, unnest(s) AS segment FROM (SELECT doc_id, regexp_extract_all(text, {_PLAIN}) AS s FROM documents)")
def pre_segments_documents(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(segment.pre_segments(F.col("text"), segment.PLAIN_SEGMENT)).alias("pos", "segment")).withColumn("pos", F.col("pos") + 1)


@query("optimal_segmentation_cost_documents")
def optimal_segmentation_cost_documents(spark, folder):
    return segment.covers(corpus(spark, folder), matching.Dictionary(SPELLING)).select("doc_id", "n_tokens")


@query("corpus_token_total_documents")
def corpus_token_total_documents(spark, folder):
    return segment.cover_total(segment.covers(corpus(spark, folder), matching.Dictionary(SPELLING)))


@query("utf8_lax_validity_documents", f"""SELECT gram, regexp_matches(x, '^([0-7].,|[CD].,[89AB].,|E.,([89AB].,){{2}}|F[0-7],([89AB].,){{3}})*$') AS valid FROM (SELECT DISTINCT gram, regexp_replace(gram, '(..)', '\\1,', 'g') AS x FROM ({gram_sql(3)}))""")
def utf8_lax_validity_documents(spark, folder):
    return grams.gram_counts(corpus(spark, folder), [3]).select(F.hex("gram").alias("gram"), B.lax_utf8(F.col("gram")).alias("valid"))


@query("escape_roundtrip_documents", f"SELECT gram, true AS same FROM ({gram_sql(3)}) GROUP BY gram")
def escape_roundtrip_documents(spark, folder):
    g = grams.gram_counts(corpus(spark, folder), [3])
    return g.select(F.hex("gram").alias("gram"), (codec.unescape_udf(codec.escape_udf("gram")) == F.col("gram")).alias("same"))


_ASKED_DOCS = [t.encode() for t in COMMON]


@query("candidate_savings_documents")
def candidate_savings_documents(spark, folder):
    x = learner.candidate_savings(corpus(spark, folder), learner.BYTES, _ASKED_DOCS)
    return x.select(F.hex("token").alias("token"), "n_occurrences", "savings")


@query("removal_loss_documents")
def removal_loss_documents(spark, folder):
    x = learner.removal_loss(corpus(spark, folder), SPELLING, _ASKED_DOCS)
    return x.select(F.hex("token").alias("token"), "n_occurrences", "loss")


@query("bpe_pair_counts_documents", f"""WITH s AS (SELECT regexp_extract_all(hex(encode(w)), '..') AS z FROM ({_SEGMENTS})), p AS (SELECT z, unnest(range(1, len(z))) AS i FROM s WHERE len(z) > 1)
SELECT chr(('0x' || z[i])::INT) AS "first", chr(('0x' || z[i + 1])::INT) AS "second", count(*) AS n FROM p GROUP BY ALL""")
def bpe_pair_counts_documents(spark, folder):
    s = segment.segment_counts(table(spark, folder, "documents"), pattern=segment.PLAIN_SEGMENT)
    return bpe.pair_counts(bpe.segments(s, "segment", "n"))


@query("all_paths_bpb_documents")
def all_paths_bpb_documents(spark, folder):
    """Every path of the documents over single bytes and common tokens, all equally probable."""
    x = bpb.all_paths_bpb(corpus(spark, folder), SPELLING, [1 / len(SPELLING)] * len(SPELLING))
    return x.select("doc_id", "n_bytes", F.round("bpb", 8).alias("bpb"))


def _lattice_documents(spark, folder) -> DataFrame:
    return lattice.lattice(corpus(spark, folder), dictionary(COMMON))


@query("token_lattice_documents")
def token_lattice_documents(spark, folder):
    return lattice.end_positions(_lattice_documents(spark, folder))


@query("ancestor_counts_documents")
def ancestor_counts_documents(spark, folder):
    return lattice.ancestor_counts(_lattice_documents(spark, folder))


@query("non_dominated_tokens_documents")
def non_dominated_tokens_documents(spark, folder):
    return lattice.non_dominated(_lattice_documents(spark, folder))


def _byte_means_documents(spark, folder) -> DataFrame:
    params = spark.createDataFrame([(i, (i + 1) / 10.0) for i in range(len(COMMON))], "token_id int, param double")
    return lattice.byte_means(lattice.non_dominated(_lattice_documents(spark, folder)), params)


@query("byte_coverage_mean_documents")
def byte_coverage_mean_documents(spark, folder):
    return _byte_means_documents(spark, folder).select("doc_id", "byte", F.round("mean", 9).alias("mean"))


@query("cumulative_position_documents")
def cumulative_position_documents(spark, folder):
    return lattice.cumulative(_lattice_documents(spark, folder), _byte_means_documents(spark, folder)).withColumn("position", F.round("position", 8))


from . import part_queries  # noqa: E402, F401
