"""Queries over the part names and other short inputs, each with SQL that gives the same rows.

Many operators (covers, merges, path sums, the learner) have no SQL that is fast enough on whole documents; here the same
operators run over short strings, where recursive SQL is. Their counterparts over the documents are in ``catalogue``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytestrings as B
from ..functions import codec
from ..functions.register import register
from ..operators import batches, bpb, bpe, grams, lattice, learner, matching, records, segment, tokenset
from ..session import resident, shared_folder, table, written
from ..sources import shards, tokensets
from . import pipelines
from .catalogue import _FREE, _MARKED, _MEANS, _P, _PRE, _UNION, COMMON, LATTICE, LETTERS, PART, PIECES, SQL, STREAM, _params, _paths_sql, benchmark, cost_sql, dictionary, gram_sql, names, query, sql_list, stream

MULTI = [t for t in PIECES if len(t) > 1]
RAW = [t.encode() for t in PIECES]
_NAMES = "SELECT DISTINCT p_name AS t FROM part"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- byte-pair encoding


#: Each byte of a segment as the letter U+E100 + byte, in the same order.
_BYTE_LETTERS = "array_to_string(list_transform(regexp_extract_all(hex(encode(segment)), '..'), lambda h: chr((57600 + ('0x' || h)::INT)::INT)), '')"


def canon_sql(source: str) -> str:
    """(t, s): each string t of ``source`` as its canonical tokens in angle brackets."""
    steps = []
    for w in MULTI:  # in the order of rank: the first that applies is the merge of lowest rank
        cuts = "|".join(f"<{w[:k]}><{w[k:]}>" for k in range(1, len(w)) if w[:k] in PIECES and w[k:] in PIECES)
        if cuts:
            steps.append(f"WHEN regexp_matches(s, '{cuts}') THEN regexp_replace(s, '{cuts}', '<{w}>', 'g')")
    case = f"CASE {' '.join(steps)} END"
    return f"""(WITH RECURSIVE c(t, s) AS (SELECT t, regexp_replace(t, '(.)', '<\\1>', 'g') FROM ({source}) UNION ALL SELECT t, n FROM (SELECT t, {case} AS n FROM c) WHERE n IS NOT NULL)
SELECT t, s FROM c WHERE {case} IS NULL)"""


def canon_bytes_sql(source: str, tokens) -> str:
    """(t, s): the same for byte letters and multi-byte tokens, over single bytes."""
    letters = ["".join(chr(57600 + b) for b in w.encode()) for w in tokens]
    known = {*letters}
    steps = []
    for w in letters:
        cuts = "|".join(f"<{w[:k]}><{w[k:]}>" for k in range(1, len(w)) if (k == 1 or w[:k] in known) and (k == len(w) - 1 or w[k:] in known))
        if len(w) > 1 and cuts:
            steps.append(f"WHEN regexp_matches(s, '{cuts}') THEN regexp_replace(s, '{cuts}', '<{w}>', 'g')")
    case = f"CASE {' '.join(steps)} END"
    return f"""(WITH RECURSIVE c(t, s) AS (SELECT t, regexp_replace(t, '(.)', '<\\1>', 'g') FROM ({source}) UNION ALL SELECT t, n FROM (SELECT t, {case} AS n FROM c) WHERE n IS NOT NULL)
SELECT t, s FROM c WHERE {case} IS NULL)"""


_IDS = f"list_transform(regexp_extract_all(s, '<([^>]*)>', 1), lambda k: (list_position({sql_list(PIECES)}, k) - 1)::INT)"


@query("canonical_encoding_parts", f"SELECT p_partkey, array_to_string({_IDS}, ' ') AS ids, true AS same FROM part JOIN {canon_sql(_NAMES)} c ON p_name = c.t")
def canonical_encoding_parts(spark, folder):
    """Byte-pair encoding of the part names, and that it decodes to the same bytes; each name is one segment."""
    data = names(spark, folder)
    x = segment.encode_bytes(data, RAW, "p_partkey")
    vocab = spark.createDataFrame(list(enumerate(RAW)), "token_id int, token binary")
    back = segment.decode_tokens(x, vocab, "p_partkey").withColumnRenamed("data", "back")
    return x.join(data, "p_partkey").join(back, "p_partkey").select("p_partkey", F.array_join("token_ids", " ").alias("ids"), (F.col("back") == F.col("data")).alias("same"))


@query("unknown_ids_decode", "SELECT p_partkey, regexp_replace(p_name, 'o', '?', 'g') AS shown FROM part")
def unknown_ids_decode(spark, folder):
    """Letters as ids, decoded with a vocabulary that lacks the letter o: a question mark stands for it."""
    p = table(spark, folder, "part").select("p_partkey", F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("token_ids"))
    vocab = spark.createDataFrame([(b, bytes([b])) for b in range(256) if b != ord("o")], "token_id int, token binary")
    return segment.decode_tokens(p, vocab, "p_partkey").select("p_partkey", F.decode("data", "utf-8").alias("shown"))


@query("tokenized_documents", f"SELECT p_partkey, '50256 ' || array_to_string({_IDS}, ' ') AS ids, (1 + len({_IDS}))::INT AS n_tokens FROM part JOIN {canon_sql(_NAMES)} c ON p_name = c.t")
def tokenized_documents(spark, folder):
    """A separator and the canonical tokens of each part name."""
    x = pipelines.tokenize(names(spark, folder), RAW, "p_partkey", whole=True)
    return x.select("p_partkey", F.array_join("token_ids", " ").alias("ids"), F.size("token_ids").alias("n_tokens"))


@query("corpus_to_shards", f"""WITH d AS (SELECT p_partkey, [50256] || {_IDS} AS ids FROM part JOIN {canon_sql(_NAMES)} c ON p_name = c.t),
o AS (SELECT *, sum(len(ids)) OVER (ORDER BY p_partkey) - len(ids) AS o FROM d), x AS (SELECT o + unnest(range(len(ids))) AS z, unnest(ids) AS token_id FROM o)
SELECT CASE WHEN z < 1000 THEN 'tokens_val_' ELSE 'tokens_train_' END || lpad((z // 1000)::BIGINT::VARCHAR, 6, '0') || '.bin' AS shard, (z % 1000)::BIGINT AS pos, token_id::INT AS token_id FROM x""")
def corpus_to_shards(spark, folder):
    """The part names as shard files of 1,000 tokens, read again."""
    out = _folder(spark, "shards")
    written(pipelines.build_shards(names(spark, folder), RAW, out, 1000, "p_partkey", whole=True), "shard-files")
    return shards.tokens(shards.files(spark, out))


SQL["canonical_encoding"] = f"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all({_MARKED}, {_PRE})) AS segment FROM documents), x AS (SELECT doc_id, {_BYTE_LETTERS} AS t FROM g),
n AS (SELECT doc_id, sum(len(regexp_extract_all(s, '<([^>]*)>', 1))) AS n FROM x JOIN {canon_bytes_sql("SELECT DISTINCT t FROM x", COMMON)} c USING (t) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_tokens, true AS same FROM documents LEFT JOIN n USING (doc_id)"""


def prefix_sql(key: str = "p_partkey") -> str:
    """q: (t, token_id, start1, end1, prefix) of the distinct tokens of all prefixes of the distinct names."""
    return f"""pf AS (SELECT t AS whole, left(t, n::INT) AS t, n FROM ({_NAMES}), range(1, 40) r(n) WHERE n <= length(t)),
cn AS (SELECT DISTINCT t, s FROM {canon_sql("SELECT DISTINCT t FROM pf")}),
tk AS (SELECT whole, n, unnest(regexp_extract_all(s, '<([^>]*)>', 1)) AS k, unnest(range(length(s))) AS i FROM pf JOIN cn USING (t)),
ps AS (SELECT whole, n, k, (sum(length(k)) OVER (PARTITION BY whole, n ORDER BY i))::INT AS end1 FROM tk WHERE k IS NOT NULL),
q AS (SELECT whole AS t, (list_position({sql_list(PIECES)}, k) - 1)::INT AS token_id, (end1 - length(k) + 1)::INT AS start1, end1, min(n)::INT AS prefix FROM ps GROUP BY ALL)"""


@query("prefix_token_positions", f"WITH {prefix_sql()} SELECT p_partkey, token_id, start1, end1, prefix, row_number() OVER (PARTITION BY p_partkey ORDER BY end1, start1, token_id)::INT AS rank FROM part JOIN q ON p_name = t")
def prefix_token_positions(spark, folder):
    """Distinct tokens of the canonical segmentations of every prefix of each part name, in order."""
    return bpb.prefix_order(bpb.prefix_tokens(names(spark, folder), RAW, "p_partkey"), "p_partkey")


@query("prefix_ancestry", f"""WITH {prefix_sql()} SELECT p_partkey, a.token_id, a.start1, b.token_id AS anc_id, b.start1 AS anc_start FROM q a JOIN q b ON a.t = b.t AND b.end1 < a.start1 AND b.prefix <= a.prefix JOIN part ON p_name = a.t""")
def prefix_ancestry(spark, folder):
    x = written(bpb.prefix_tokens(names(spark, folder), RAW, "p_partkey"), "prefixes")
    return bpb.prefix_ancestry(x, "p_partkey")


_LETTERED = "SELECT p_name AS t, sum(p_size)::BIGINT AS f FROM part GROUP BY p_name"
#: The distinct pre-segments of the documents with their counts.
_SEGMENTED = f"SELECT {_BYTE_LETTERS} AS t, n AS f FROM ({SQL['pre_segment_counts']})"


def _latin(k: str) -> str:
    """Byte letters as the letters of latin-1."""
    return f"array_to_string(list_transform(list_filter(string_split({k}, ''), lambda c: c <> ''), lambda c: chr((unicode(c) - 57600)::INT)), '')"


def train_sql(merges: int, source: str = _LETTERED) -> str:
    """CTEs s0 .. sN (s, f) of the weighted strings (t, f) after each merge, and m1 .. mN with the merged pair."""
    parts = [f"s0 AS MATERIALIZED (SELECT regexp_replace(t, '(.)', '<\\1>', 'g') AS s, f FROM ({source}))"]
    for i in range(1, merges + 1):
        pairs = f"SELECT x[j] AS a, x[j + 1] AS b, f FROM (SELECT x, f, unnest(range(1, len(x))) AS j FROM (SELECT regexp_extract_all(s, '<([^>]*)>', 1) AS x, f FROM s{i - 1}))"
        parts.append(f"m{i} AS MATERIALIZED (SELECT a, b FROM ({pairs}) GROUP BY a, b ORDER BY sum(f) DESC, a, b LIMIT 1)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT replace(s, '<' || a || '><' || b || '>', '<' || a || b || '>') AS s, f FROM s{i - 1}, m{i})")
    return ", ".join(parts)


def _weighted_names(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("content"), F.col("p_size").alias("frequency"))


SQL["bpe_train"] = f"WITH {train_sql(12, _SEGMENTED)} {' UNION ALL '.join(f'SELECT {i - 1} AS rank, {_latin("a || b")} AS token FROM m{i}' for i in range(1, 13))}"


@query("bpe_train_parts", f"WITH {train_sql(12)} {' UNION ALL '.join(f'SELECT {i - 1} AS rank, a || b AS token FROM m{i}' for i in range(1, 13))}")
def bpe_train_parts(spark, folder):
    merged, _ = bpe.train(_weighted_names(spark, folder), 12)
    return spark.createDataFrame(list(enumerate(merged)), "rank int, token string")


def worth_sql(merges: int, source: str = _LETTERED) -> str:
    """w: (token, war, n_strings) of the merged tokens."""
    tokens = " UNION ALL ".join(f"SELECT {i} AS i, a || b AS k FROM m{i}" for i in range(1, merges + 1))
    return f"""WITH RECURSIVE {train_sql(merges, source)}, tk AS MATERIALIZED ({tokens}),
every AS MATERIALIZED (SELECT list_distinct(list(k) || (SELECT list(DISTINCT c) FROM (SELECT unnest(string_split(t, '')) AS c FROM ({source})) WHERE c <> '')) AS ks FROM tk),
jobs AS MATERIALIZED (SELECT DISTINCT tk.k, replace(replace(s, '<', ''), '>', '') AS t, len(regexp_extract_all(s, '<([^>]*)>', 1)) AS n, f, list_filter(ks, lambda x: x <> tk.k) AS ks FROM tk, s{merges}, every WHERE contains(s, '<' || tk.k || '>')),
d(k, t, n, f, ks, i, a) AS (SELECT k, t, n, f, ks, 0, [0] FROM jobs UNION ALL
SELECT k, t, n, f, ks, i + 1, list_append(a, 1 + list_min(list_transform(list_filter(ks, lambda x: length(x) <= i + 1 AND substr(t, i + 2 - length(x), length(x)) = x), lambda x: a[i + 2 - length(x)]))) FROM d WHERE i < length(t)),
w AS (SELECT tk.k AS token, coalesce(sum((a[length(t) + 1] - n) * f), 0)::BIGINT AS war, count(t) AS n_strings FROM tk LEFT JOIN (SELECT * FROM d WHERE i = length(t)) d ON d.k = tk.k GROUP BY tk.k)"""


@query("bpe_war_parts", f"{worth_sql(8)} SELECT token, war, n_strings FROM w")
def bpe_war_parts(spark, folder):
    """By how much the token count of the weighted names rises without each of eight merged tokens."""
    tokens, seg = bpe.train(_weighted_names(spark, folder), 8)
    return bpe.worth(seg, tokens)


SQL["bpe_war"] = f"{worth_sql(12, _SEGMENTED)} SELECT {_latin('token')} AS token, war, n_strings FROM w"


@query("lowest_worth_token", f"{worth_sql(8)} SELECT token, war FROM w ORDER BY war, token LIMIT 1")
def lowest_worth_token(spark, folder):
    tokens, seg = bpe.train(_weighted_names(spark, folder), 8)
    return bpe.least_worth(bpe.worth(seg, tokens)).select("token", "war")


@query("bpe_pruned", f"{worth_sql(8)} SELECT token, war, n_strings FROM (SELECT *, row_number() OVER (ORDER BY war, token) AS r FROM w) WHERE r > 3")
def bpe_pruned(spark, folder):
    """Eight merges, of which the three least worthy go."""
    return bpe.prune(_weighted_names(spark, folder), 8, 5)[1]


@query("inverted_index", "SELECT c AS token, t AS string_id, count(*) AS n FROM (SELECT t, unnest(string_split(t, '')) AS c FROM (SELECT DISTINCT p_name AS t FROM part)) WHERE c <> '' GROUP BY ALL")
def inverted_index(spark, folder):
    return bpe.inverted_index(bpe.segments(_weighted_names(spark, folder)))


@query("strings_with_both", "SELECT DISTINCT p_name AS string_id FROM part WHERE contains(p_name, 'r') AND contains(p_name, 'g')")
def strings_with_both(spark, folder):
    return bpe.with_both(bpe.segments(_weighted_names(spark, folder)), "r", "g").select("string_id")


# ---------------------------------------------------------------- covers and the learner


def dp_sql(tokens) -> str:
    """(t, a): fewest tokens that spell each prefix of the distinct names."""
    best = ", ".join(f"CASE WHEN i + 1 >= {len(t)} AND substr(t, i + 2 - {len(t)}, {len(t)}) = '{t}' THEN a[i + 2 - {len(t)}] ELSE 1000000 END" for t in tokens)
    return f"""(WITH RECURSIVE s(t, i, a) AS (SELECT DISTINCT p_name, 0, [0] FROM part UNION ALL SELECT t, i + 1, list_append(a, 1 + least({best})) FROM s WHERE i < length(t)) SELECT t, a FROM s WHERE i = length(t))"""


_LONGEST = sql_list(sorted(PIECES, key=lambda t: -len(t)))
COVER = f"""WITH RECURSIVE dp AS ({dp_sql(PIECES)}), p(t, a, z, ids) AS (SELECT t, a, length(t), []::INT[] FROM dp UNION ALL
SELECT t, a, z - length(k), list_prepend((list_position({sql_list(PIECES)}, k) - 1)::INT, ids) FROM
(SELECT *, list_filter({_LONGEST}, lambda k: length(k) <= z AND substr(t, z - length(k) + 1, length(k)) = k AND a[z - length(k) + 1] = a[z + 1] - 1)[1] AS k FROM p WHERE z > 0)),
cv AS (SELECT p_partkey, ids FROM part JOIN p ON p_name = t WHERE z = 0)"""


@query("cover_tokens_parts", f"{COVER} SELECT p_partkey, array_to_string(ids, ' ') AS ids FROM cv")
def cover_tokens_parts(spark, folder):
    """A fewest cover of each part name: from the end, the longest token on a fewest path."""
    return segment.covers(names(spark, folder), dictionary(PIECES), "p_partkey").select("p_partkey", F.array_join("token_ids", " ").alias("ids"))


@query("cover_usage_parts", f"{COVER} SELECT token_id, count(*) AS n_uses FROM (SELECT unnest(ids) AS token_id FROM cv) GROUP BY token_id")
def cover_usage_parts(spark, folder):
    return segment.cover_totals(names(spark, folder), dictionary(PIECES))


@query("greedy_longest_suffix_parts", f"""WITH RECURSIVE p(t, z, ks) AS (SELECT t, length(t), []::VARCHAR[] FROM ({_NAMES}) UNION ALL
SELECT t, z - length(k), list_prepend(k, ks) FROM (SELECT *, list_filter({_LONGEST}, lambda k: length(k) <= z AND substr(t, z - length(k) + 1, length(k)) = k)[1] AS k FROM p WHERE z > 0))
SELECT p_partkey, array_to_string(ks, '|') AS tokens FROM part JOIN p ON p_name = t WHERE z = 0""")
def greedy_longest_suffix_parts(spark, folder):
    x = segment.suffix_cuts(names(spark, folder), RAW, "p_partkey")
    return x.select("p_partkey", F.array_join(F.transform("tokens", lambda t: F.decode(t, "utf-8")), "|").alias("tokens"))


CANDIDATES = ["ing", "ring", "bolt", "widget", "all", "l r", "get", "sm", "ed", "gear"]


def _cost(tokens, banned=None) -> str:
    return f"(SELECT sum(cost) FROM part JOIN {cost_sql(tokens, banned)} c ON p_name = c.t)"


_SAVINGS = " UNION ALL ".join(f"SELECT '{t}' AS token, ({_cost(LETTERS)} - {_cost([*LETTERS, t])})::BIGINT AS savings" for t in CANDIDATES)
#: Of a ranked list: those before the first that contains, is contained in or meets the end of an earlier one.
_APART = """contains(a.token, b.token) OR contains(b.token, a.token)
  OR EXISTS (SELECT 1 FROM range(1, least(length(a.token), length(b.token))) r(k) WHERE right(a.token, k) = left(b.token, k) OR right(b.token, k) = left(a.token, k))"""


@query("vocab_learn_step_parts", f"""WITH v AS ({_SAVINGS}), r AS (SELECT *, row_number() OVER (ORDER BY savings DESC, token) AS r FROM v WHERE savings > 0),
stop AS (SELECT coalesce(min(a.r), 1000) AS r FROM r a JOIN r b ON b.r < a.r AND ({_APART}))
SELECT 1 AS step, token AS added, savings::DOUBLE AS savings FROM r WHERE r < (SELECT r FROM stop) AND r <= 10""")
def vocab_learn_step_parts(spark, folder):
    """A growth step over the part names: the independent candidates of the largest exact savings."""
    state = learner.State([t.encode() for t in LETTERS])
    learner.grow(written(names(spark, folder), "names"), state, [t.encode() for t in CANDIDATES])
    return spark.createDataFrame([(s, a.decode(), e) for s, a, _, e in state.history], "step int, added string, savings double")


@query("minimum_evidence", f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{t}' AS token, (SELECT count(*) FROM part, range(1, 30) r(i) WHERE substr(p_name, i::INT, {len(t)}) = '{t}') AS n, ({_cost(LETTERS)} - {_cost([*LETTERS, t])})::BIGINT AS savings" for t in CANDIDATES[:4])})
SELECT token, n >= 120 AS counts, CASE WHEN n >= 120 THEN savings END AS savings FROM v""")
def minimum_evidence(spark, folder):
    """Savings count only where a candidate was seen 120 times or more."""
    x = learner.candidate_savings(names(spark, folder), [t.encode() for t in LETTERS], [t.encode() for t in CANDIDATES[:4]])
    return learner.with_evidence(x, 120).select(F.decode("token", "utf-8").alias("token"), "counts", "savings")


_SHRUNK = ["ing", "ring", "bolt", "widget", "all", "get", "gear", "re", "ed"]
_LOSSES = " UNION ALL ".join(f"SELECT '{t}' AS token, ({_cost([*LETTERS, *_SHRUNK], t)} - {_cost([*LETTERS, *_SHRUNK])})::BIGINT AS loss" for t in _SHRUNK)


@query("vocab_shrink_step_parts", f"""WITH v AS ({_LOSSES}), w AS (SELECT token, loss FROM v ORDER BY loss, token LIMIT 3), c AS (SELECT token, loss FROM v WHERE token NOT IN (SELECT token FROM w) ORDER BY md5('0:' || token), token LIMIT 2)
SELECT token AS removed, loss::DOUBLE AS loss FROM w UNION ALL SELECT token, loss FROM c""")
def vocab_shrink_step_parts(spark, folder):
    """The third of the members whose removal costs least, and a seeded third of the others."""
    state = learner.State([t.encode() for t in [*LETTERS, *_SHRUNK]])
    learner.shrink(written(names(spark, folder), "names"), state)
    return spark.createDataFrame([(r.decode(), e) for _, _, r, e in state.history], "removed string, loss double")


@query("tightened_bounds", f"""{COVER}, u AS (SELECT token_id, count(*) AS n FROM (SELECT unnest(ids) AS token_id FROM cv) GROUP BY token_id), pc AS (SELECT (unnest(range({len(PIECES)})))::INT AS id, unnest({sql_list(PIECES)}) AS k),
c AS (SELECT unnest(['ring', 'widget', 'l r', 'all b']) AS token), cost AS (SELECT token, len(ids) AS n FROM (SELECT 'ring' AS token, ['ring'] AS ids UNION ALL SELECT 'widget', ['widget'] UNION ALL SELECT 'l r', ['l r'] UNION ALL SELECT 'all b', ['all', ' ', 'b'])),
o AS (SELECT token, sum((length(p_name) - length(replace(p_name, token, ''))) // length(token))::BIGINT AS n FROM c, part GROUP BY token),
z AS (SELECT token, coalesce(sum(((length(k) - length(replace(k, token, ''))) // length(token)) * u.n), 0)::BIGINT AS n FROM c LEFT JOIN (u JOIN pc ON token_id = id) ON contains(k, token) GROUP BY token)
SELECT token, (greatest(o.n - z.n, 0) * (cost.n - 1))::BIGINT AS bound FROM o JOIN z USING (token) JOIN cost USING (token)""")
def tightened_bounds(spark, folder):
    """Bounds of savings without the occurrences that lie inside tokens of the present cover."""
    data, vocab = names(spark, folder), RAW
    uses = segment.cover_totals(data, matching.Dictionary(vocab))
    found = learner.tightened(data, vocab, [b"ring", b"widget", b"l r", b"all b"], uses)
    return spark.createDataFrame([(t.decode(), n) for t, n in found.items()], "token string, bound long")


# ---------------------------------------------------------------- lattices and path sums


@query("invariant_encoding_parts", f"""WITH {LATTICE}, {_FREE}, {_MEANS},
an AS (SELECT a.p_partkey, a.token_id, a.start1, a.end1, count(b.token_id) AS n_ancestors FROM l a LEFT JOIN l b ON a.p_partkey = b.p_partkey AND b.end1 < a.start1 GROUP BY ALL),
cu AS (SELECT l.p_partkey, token_id, start1, round(sum(mean), 8) AS position FROM l JOIN c ON l.p_partkey = c.p_partkey AND c.byte <= l.end1 GROUP BY ALL),
z AS (SELECT an.*, position, row_number() OVER (PARTITION BY an.p_partkey ORDER BY an.start1, end1, an.token_id)::INT AS slot FROM an JOIN cu USING (p_partkey, token_id, start1))
SELECT p_partkey, slot, token_id, start1::INT AS start1, n_ancestors, position FROM z WHERE slot <= 8""")
def invariant_encoding_parts(spark, folder):
    x = lattice.encoding(names(spark, folder), dictionary(PIECES), _params(spark), 8, "p_partkey")
    return x.select("p_partkey", "slot", "token_id", "start1", "n_ancestors", F.round("position", 8).alias("position"))


@query("matches_by_first_end", f"""WITH {PART}, f AS (SELECT *, min("end") OVER (PARTITION BY p_partkey, token_id) AS first_end FROM m)
SELECT p_partkey, token_id, "start", "end", row_number() OVER (PARTITION BY p_partkey ORDER BY first_end DESC, token_id, "end")::INT AS place FROM f""")
def matches_by_first_end(spark, folder):
    return matching.by_first_end(matching.matches(names(spark, folder), dictionary(PIECES), "p_partkey"), "p_partkey").select("p_partkey", "token_id", "start", "end", "place")


@query("all_paths_bpb_by_position", """WITH RECURSIVE pr AS (SELECT (j - 1)::INT AS id, k FROM (SELECT unnest(P) AS k, unnest(range(1, len(P) + 1)) AS j FROM (SELECT LIST AS P))), s(t, i, a) AS (SELECT DISTINCT p_name, 0, [1.0::DOUBLE] FROM part UNION ALL
SELECT t, i + 1, list_append(a, coalesce((SELECT sum(a[i + 2 - length(k)] / (3 + id + (i + 1 - length(k)) % 5)) FROM pr WHERE length(k) <= i + 1 AND substr(t, i + 2 - length(k), length(k)) = k), 0.0)) FROM s WHERE i < length(t)),
f AS (SELECT t, a[length(t) + 1] + (SELECT coalesce(sum(a[length(t) + 1 - n] / (3 + id + (length(t) - n) % 5)), 0.0) FROM pr, range(1, 6) r(n) WHERE n < length(k) AND n <= length(t) AND right(t, n) = left(k, n)) AS p FROM s WHERE i = length(t))
SELECT p_partkey, length(p_name) AS n_bytes, round(-log2(p) / length(p_name), 8) AS bpb FROM part JOIN f ON p_name = f.t""".replace("LIST", sql_list(PIECES)))
def all_paths_bpb_by_position(spark, folder):
    """All paths where a token's probability depends on where it starts in its text."""
    data = names(spark, folder)
    found = matching.matches(data, dictionary(PIECES), "p_partkey", past_end=True)
    p = found.select("p_partkey", "start", "token_id", (1 / (3 + F.col("token_id") + F.col("start") % 5)).alias("p"))
    return bpb.all_paths_table(data, RAW, p, "p_partkey").select("p_partkey", "n_bytes", F.round("bpb", 8).alias("bpb"))


_COVERED = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform({_IDS}, lambda i: -log2({_P}[i + 1]))), lambda x, y: x + y)"


@query("bpb_report", f"""SELECT a.p_partkey, n_bytes, round({_COVERED} / n_bytes, 8) AS bpb, a.bpb AS all_paths_bpb FROM ({_paths_sql()}) a JOIN part USING (p_partkey) JOIN {canon_sql(_NAMES)} c ON p_name = c.t""")
def bpb_report(spark, folder):
    """Bits per byte of the canonical encoding and of all paths, written as a JSON report and read again."""
    x = pipelines.evaluate(names(spark, folder), RAW, _P, "p_partkey", whole=True)
    out = _folder(spark, "report")
    pipelines.report(x, out)
    back = spark.read.schema("p_partkey long, n_bytes long, bpb double, all_paths_bpb double").json(out)
    return back.select("p_partkey", "n_bytes", F.round("bpb", 8).alias("bpb"), F.round("all_paths_bpb", 8).alias("all_paths_bpb"))


@query("masked_mean_loss", f"""WITH {STREAM}, y AS (SELECT shard, (token_id % 97 + 1) / 100.0::DOUBLE AS p, CASE WHEN token_id = 50256 THEN -100 ELSE token_id END AS label FROM st)
SELECT count(*) AS n, round(avg(-ln(p)), 9) AS mean_loss, round(sum(-ln(p)), 5) AS sum_loss, round(exp(avg(-ln(p))), 8) AS perplexity FROM y WHERE label <> -100""")
def masked_mean_loss(spark, folder):
    s = stream(spark, folder).select(((F.col("token_id") % 97 + 1) / F.lit(100.0)).alias("p"), F.when(F.col("token_id") == batches.EOT, -100).otherwise(F.col("token_id")).alias("label"))
    x = bpb.mean_loss(s)
    return x.select("n", F.round("mean_loss", 9).alias("mean_loss"), F.round("sum_loss", 5).alias("sum_loss"), F.round("perplexity", 8).alias("perplexity"))


@query("validation_loss_mean", """WITH x AS (SELECT o_orderkey % 5 AS step, o_orderkey % 4 AS rank, o_totalprice AS loss FROM orders), r AS (SELECT step, rank, avg(loss) AS loss FROM x GROUP BY ALL) SELECT step, round(avg(loss), 5) AS loss FROM r GROUP BY step""")
def validation_loss_mean(spark, folder):
    x = table(spark, folder, "orders").select((F.col("o_orderkey") % 5).alias("step"), (F.col("o_orderkey") % 4).alias("rank"), F.col("o_totalprice").alias("loss"))
    return records.mean_over_ranks(x).withColumn("loss", F.round("loss", 5))


def _below_sql(t: str) -> str:
    """Student's distribution function by Simpson's rule over 20,000 steps."""
    f = "power(1 + pow({u}, 2) / df, -(df + 1) / 2.0) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi())"
    total = f"sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f.format(u=f'({t} * i / 20000.0::DOUBLE)')})"
    return f"(SELECT 0.5 + {t} / 20000.0::DOUBLE / 3 * {total} FROM range(20001) r(i))"


@query("run_significance_p", f"""WITH x AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, count(*) - 1 AS df FROM (SELECT unnest({records.RUN_LOSSES}::DOUBLE[]) AS x)),
y AS (SELECT *, (mean - 3.28) / (std / sqrt(n)) AS t, 1.99045 * std / sqrt(n) AS e FROM x)
SELECT n, round({_below_sql('t')}, 7) AS p, round(mean - e, 6) AS low, round(mean + e, 6) AS high FROM y""")
def run_significance_p(spark, folder):
    """The chance of such losses at the threshold, and where the mean lies with 95 %; 1.99045 is the quantile for 79 degrees."""
    x = records.judged(records.significance(records.run_table(spark)))
    return x.select("n", F.round("p", 7).alias("p"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("top_completions", "SELECT p_type, token_id, p, rank FROM (SELECT p_type, p_partkey::INT AS token_id, p_size / 100.0::DOUBLE AS p, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey)::INT AS rank FROM part) WHERE rank <= 10")
def top_completions(spark, folder):
    x = table(spark, folder, "part").select("p_type", F.col("p_partkey").cast("int").alias("token_id"), (F.col("p_size") / F.lit(100.0)).alias("p"))
    return bpb.top_completions(x, 10, "p_type")


# ---------------------------------------------------------------- files


def _packed_shards(spark, folder, cut: int = 0) -> DataFrame:
    """(shard, content): each conversation as the bytes of a shard file, the last ``cut`` bytes missing."""
    s = stream(spark, folder).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("t")).select(F.col("shard").cast("string").alias("shard"), F.col("t.token_id").alias("ids"))

    def run(batch_iter):
        for batch in batch_iter:
            raw = [shards.pack(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[: len(r) - cut] for r in raw], pa.binary())], ["shard", "content"])

    return s.mapInArrow(run, "shard string, content binary")


@query("shard_lenient_read", f"WITH {STREAM}, n AS (SELECT shard, count(*) AS n FROM st GROUP BY shard) SELECT shard::VARCHAR AS shard, pos, token_id FROM st JOIN n USING (shard) WHERE pos < n - 2")
def shard_lenient_read(spark, folder):
    """Shards that lost three bytes: as many whole tokens as there are."""
    return shards.tokens(_packed_shards(spark, folder, 3), strict=False)


@query("shard_header_peek", f"WITH {STREAM} SELECT shard::VARCHAR AS shard, 20240520::BIGINT AS magic, 1::BIGINT AS version, count(*) AS n_tokens FROM st GROUP BY shard")
def shard_header_peek(spark, folder):
    return shards.peek(_packed_shards(spark, folder))


@query("shard_first_files", f"""WITH {STREAM}, n AS (SELECT DISTINCT shard, 'tokens_train_' || lpad(shard::VARCHAR, 6, '0') || '.bin' AS name FROM st), f AS (SELECT * FROM n ORDER BY name LIMIT 3)
SELECT name AS shard, pos, token_id FROM st JOIN f USING (shard)""")
def shard_first_files(spark, folder):
    """The first three shard files of a folder by name, in which other files lie too, read in bulk."""
    s = stream(spark, folder).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("t"))
    pieces = s.select(F.col("shard").cast("int").alias("shard"), F.lit("train").alias("split"), F.lit(0).cast("bigint").alias("at"), F.col("t.token_id").alias("token_ids"))
    out = _folder(spark, "listing")
    written(shards.write_shards(pieces, out), "listing-files")
    spark.range(3).write.mode("append").format("json").save(out)
    return shards.tokens(shards.files(spark, out, first=3))


@query("vocabulary_json", f"SELECT (row_number() OVER (ORDER BY gram) - 1)::INT AS token_id, gram AS token FROM (SELECT DISTINCT gram FROM ({gram_sql(2, 'benchmark')}))")
def vocabulary_json(spark, folder):
    """A vocabulary as a JSON object from printable strings to ids, read again."""
    g = grams.gram_counts(benchmark(spark, folder), [2]).select(codec.letters_udf("gram").alias("letters"), "gram")
    ranked = g.withColumn("id", F.row_number().over(Window.orderBy("gram")) - 1)  # a vocabulary
    one = ranked.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("letters", "id")))).alias("value"))
    out = _folder(spark, "vocabulary")
    one.coalesce(1).write.text(out)
    return tokensets.vocabulary_json(spark, out).select("token_id", F.hex("token").alias("token"))


_GRAMS3 = f"SELECT gram, count(*) AS n FROM ({gram_sql(3, 'benchmark')}) GROUP BY gram"


def _gram_rows(spark, folder, length: int) -> list[tuple[bytes, int]]:
    """Tokens and counts of a small vocabulary, in the order of bytes."""
    return [(bytes(r["gram"]), r["n"]) for r in grams.gram_counts(benchmark(spark, folder), [length]).orderBy("gram").collect()]


@query("tokenset_any_format", f"WITH g AS ({_GRAMS3}) SELECT 'counted.bin' AS name, gram AS token, n FROM g UNION ALL SELECT 'legacy.bin', gram, NULL FROM g UNION ALL SELECT 'vocabulary.bin', gram, NULL FROM g")
def tokenset_any_format(spark, folder):
    """Three forms of one token table, compressed, told apart by their first bytes."""
    import zstandard

    rows = _gram_rows(spark, folder, 3)
    forms = {"counted": tokensets.pack_counted(rows), "legacy": tokensets.pack_legacy([t for t, _ in rows]), "vocabulary": tokensets.pack_vocabulary([t for t, _ in rows])}
    files = spark.createDataFrame([(f"{k}.bin.zst", zstandard.ZstdCompressor().compress(v)) for k, v in forms.items()], "name string, content binary")
    return tokensets.read_tokens(tokensets.unzstd(files), "auto").select("name", F.hex("token").alias("token"), "n")


@query("tokens_up_to_two_bytes", f"SELECT gram AS token, count(*) AS n FROM ({gram_sql(1, 'benchmark')} UNION ALL {gram_sql(2, 'benchmark')}) GROUP BY gram")
def tokens_up_to_two_bytes(spark, folder):
    """Longer tokens of a file are left out while it is read."""
    rows = [r for n in (1, 2, 3) for r in _gram_rows(spark, folder, n)]
    files = spark.createDataFrame([("t", tokensets.pack_counted(rows))], "name string, content binary")
    return tokensets.read_tokens(files, "counted", most=2).select(F.hex("token").alias("token"), "n")


@query("vocabulary_alignment", f"WITH v AS ({_GRAMS3}), c AS (SELECT gram, (row_number() OVER (ORDER BY gram) - 1)::INT AS token_id FROM v WHERE n > 1) SELECT v.gram AS token, token_id, token_id IS NOT NULL AS known FROM v LEFT JOIN c USING (gram)")
def vocabulary_alignment(spark, folder):
    """A vocabulary meets the ids of the candidates; tokens that are no candidate are told."""
    rows = _gram_rows(spark, folder, 3)
    vocab = spark.createDataFrame([(t,) for t, _ in rows], "token binary")
    candidates = spark.createDataFrame([(i, t) for i, t in enumerate(t for t, n in rows if n > 1)], "token_id int, token binary")
    known, strange = tokensets.align(vocab, candidates)
    both = known.select("token", "token_id", F.lit(True).alias("known")).unionByName(strange.select("token", F.lit(None).cast("int").alias("token_id"), F.lit(False).alias("known")))
    return both.select(F.hex("token").alias("token"), "token_id", "known")


@query("statistics_cache", f"""WITH dict AS (SELECT unnest(['th', 'the', 'an', 'zzz']) AS t), o AS (SELECT t, sum((length(text) - length(replace(text, t, ''))) // length(t))::BIGINT AS n FROM benchmark, dict GROUP BY t)
SELECT form, t AS token, n AS n_nonoverlap FROM o, (SELECT unnest(['parquet', 'file']) AS form)""")
def statistics_cache(spark, folder):
    """Counts of some tokens, computed once and then read from the cache, in both of its forms."""
    data, tokens, out = benchmark(spark, folder), [b"th", b"the", b"an", b"zzz"], None
    for form in ("parquet", "file"):
        cache = _folder(spark, "statistics")
        for _ in range(2):
            x = pipelines.statistics(data, tokens, cache, form)
        x = x.select(F.lit(form).alias("form"), F.decode("token", "utf-8").alias("token"), "n_nonoverlap")
        out = x if out is None else out.unionByName(x)
    return out


@query("combined_tokenset", f"WITH {_UNION}, t AS (SELECT (row_number() OVER (ORDER BY length(token), token) - 1)::INT AS token_id, token FROM u), n AS (SELECT gram, count(*) AS n FROM ({gram_sql(2, 'benchmark')} UNION ALL {gram_sql(1, 'benchmark')} UNION ALL {gram_sql(3, 'part', 'p_name')}) GROUP BY gram) SELECT token_id, token, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN n ON gram = token")
def combined_tokenset(spark, folder):
    """Two counted tables as one token table with every byte, and a statistics file of the same ids, read again."""
    a = grams.gram_counts(benchmark(spark, folder), [1, 2]).select(F.col("gram").alias("token"), "n")
    b = grams.gram_counts(names(spark, folder), [3]).select(F.col("gram").alias("token"), "n")
    raw, stats = pipelines.combine([a, b])
    tokens = tokensets.read_tokens(spark.createDataFrame([("t", raw)], "name string, content binary"), "legacy").select("token_id", "token")
    counts = spark.createDataFrame([(i, n) for i, n, _, _ in tokensets.unpack_stats(stats)], "token_id int, n long")
    return tokens.join(counts, "token_id").select("token_id", F.hex("token").alias("token"), "n")


@query("tokenset_prepared", """WITH g AS (SELECT DISTINCT t AS token FROM (SELECT p_name || ' ' || p_size AS t FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type || ' ' FROM part UNION ALL SELECT p_type FROM part))
SELECT CASE WHEN regexp_matches(token, '[0-9]') THEN 'digits_and_others' WHEN regexp_matches(token, '[A-Za-z].* $') THEN 'letters_then_space' WHEN regexp_matches(token, '^[^ ].* ') THEN 'latin_with_inner_space' ELSE 'kept' END AS reason, count(*) AS n FROM g GROUP BY 1
UNION ALL SELECT reason, n FROM (VALUES ('over_three_digits', 0), ('tail_of_a_character', 0)) t(reason, n)""")
def tokenset_prepared(spark, folder):
    """Four token tables united, completed and filtered; how many tokens each filter met, single bytes apart."""
    p = table(spark, folder, "part")
    tables = [p.select(B.utf8(F.concat_ws(" ", "p_name", "p_size")).alias("token")), p.select(B.utf8("p_name").alias("token")), p.select(B.utf8(F.concat("p_type", F.lit(" "))).alias("token")), p.select(B.utf8("p_type").alias("token"))]
    kept, stats = pipelines.prepare(tables)
    n = kept.filter("len > 1").count()
    return stats.select("reason", F.when(F.col("reason") == "kept", F.lit(n)).otherwise(F.col("n")).cast("bigint").alias("n"))


@query("file_order", "SELECT 'tokenset_' || i || '.bin.zst' AS name, (row_number() OVER (ORDER BY i))::INT AS place FROM (SELECT DISTINCT p_size AS i FROM part)")
def file_order(spark, folder):
    x = table(spark, folder, "part").select(F.concat(F.lit("tokenset_"), "p_size", F.lit(".bin.zst")).alias("name")).distinct()
    return tokenset.file_order(x).select("name", F.row_number().over(Window.orderBy(tokenset.file_number("name"), "name")).alias("place"))  # a list of files


@query("metadata_consistency", "SELECT 'same' AS what, true AS consistent UNION ALL SELECT 'another seed', false")
def metadata_consistency(spark, folder):
    rows = _gram_rows(spark, folder, 2)
    metas = [tokensets.unpack_counted(tokensets.pack_counted(rows, 5, seed, [1, 2, 3]))[1] for seed in (7, 7, 8)]
    df = spark.createDataFrame([(m["file_count"], m["hash_seed"]) for m in metas], "file_count int, hash_seed long")
    return tokenset.consistent(df.filter("hash_seed = 7")).withColumn("what", F.lit("same")).unionByName(tokenset.consistent(df).withColumn("what", F.lit("another seed"))).select("what", "consistent")


@query("dummy_tokens", "SELECT 5000::BIGINT AS n, true AS in_range, true AS repeats")
def dummy_tokens(spark, folder):
    """Made-up tokens where there are no shards: their number, their range, and that a seed gives the same ones again."""
    x = batches.dummy_tokens(spark, 5000, 3)
    same = x.join(batches.dummy_tokens(spark, 5000, 3), ["pos", "token_id"]).count() == 5000
    return x.agg(F.count("*").alias("n"), ((F.min("token_id") >= 0) & (F.max("token_id") < 50_000)).alias("in_range")).withColumn("repeats", F.lit(same))


@query("first_of_each_length", f"SELECT len, min(gram) AS token FROM ({' UNION ALL '.join(gram_sql(n, 'benchmark') for n in (1, 2, 3))}) GROUP BY len")
def first_of_each_length(spark, folder):
    return tokenset.samples(grams.gram_counts(benchmark(spark, folder), [1, 2, 3]).select("len", F.col("gram").alias("token"))).select("len", F.hex("token").alias("token"))


@query("merged_counts", f"SELECT gram, count(*) AS n FROM ({gram_sql(3, 'benchmark')} UNION ALL {gram_sql(3, 'part', 'p_name')}) GROUP BY gram ORDER BY n DESC, gram LIMIT 100")
def merged_counts(spark, folder):
    """The counts of two corpora added up, and their most frequent grams."""
    x = grams.merge_counts(grams.gram_counts(benchmark(spark, folder), [3]), grams.gram_counts(names(spark, folder), [3]))
    return grams.top_grams_one(x, 100).select(F.hex("gram").alias("gram"), "n")


# ---------------------------------------------------------------- functions


@query("set_bits", "SELECT p_partkey, bit_count(p_size)::INT AS n, list_reduce(list_prepend(0, list_filter(range(0, 63), lambda k: (p_size >> k) & 1 = 1)), lambda a, b: a * 64 + b)::BIGINT AS places, CASE WHEN p_size = 0 THEN NULL ELSE list_filter(range(0, 63), lambda k: (p_size >> k) & 1 = 1)[1]::INT END AS lowest, (p_size & ~(p_size & -p_size))::INT AS cleared FROM part")
def set_bits(spark, folder):
    """Number, places and lowest place of the set bits of a mask, and the mask without the lowest."""
    p = table(spark, folder, "part").select("p_partkey", "p_size", B.bit_positions(F.col("p_size")).alias("b"))
    places = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, b: a * 64 + b)
    return p.select("p_partkey", F.bit_count("p_size").alias("n"), places.alias("places"), F.get("b", F.lit(0)).alias("lowest"), F.col("p_size").bitwiseAND(F.bitwise_not(F.col("p_size").bitwiseAND(-F.col("p_size")))).alias("cleared"))


_STRICT = "^([0-7].,|(C[2-9A-F]|D.),[89AB].,|E0,[AB].,[89AB].,|(E[1-9ABCEF]),[89AB].,[89AB].,|ED,[89].,[89AB].,|F0,[9AB].,([89AB].,){2}|F[1-3],([89AB].,){3}|F4,8.,([89AB].,){2})*$"


@query("strict_utf8", f"SELECT gram, regexp_matches(regexp_replace(gram, '(..)', '\\1,', 'g'), '{_STRICT}') AS valid FROM (SELECT DISTINCT gram FROM ({gram_sql(3, 'benchmark')} UNION ALL {gram_sql(2)}))")
def strict_utf8(spark, folder):
    """Byte strings that are text, and those that are none."""
    from .catalogue import corpus

    g = grams.gram_counts(benchmark(spark, folder), [3]).unionByName(grams.gram_counts(corpus(spark, folder), [2]))
    return g.select("gram").distinct().select(F.hex("gram").alias("gram"), B.utf8_or_null(F.col("gram")).isNotNull().alias("valid"))


@query("gram_fingerprints", f"SELECT count(DISTINCT gram) AS n, true AS told_apart FROM ({gram_sql(4, 'benchmark')})")
def gram_fingerprints(spark, folder):
    """Seeded 64-bit hashes of grams of one length tell them apart."""
    g = grams.gram_counts(benchmark(spark, folder), [4]).select("gram", F.xxhash64("gram", F.lit(11)).alias("h"))
    return g.agg(F.countDistinct("gram").alias("n"), (F.countDistinct("gram") == F.countDistinct("h")).alias("told_apart"))


@query("sql_matches", f'WITH {PART} SELECT p_partkey, "start", "end", token_id FROM m')
def sql_matches(spark, folder):
    """The matcher as a table function in SQL."""
    register(spark, dictionary(PIECES))
    names(spark, folder).createOrReplaceTempView("lexiloom_names")
    return spark.sql('SELECT p_partkey, m.start, m.`end`, m.token_id FROM lexiloom_names, LATERAL token_matches(data, false) m')


@query("sql_codecs", "SELECT p_partkey, p_name AS letters, true AS same FROM (SELECT p_partkey, replace(p_name, ' ', chr(288)) AS p_name FROM part)")
def sql_codecs(spark, folder):
    """The codecs as functions in SQL; a space shows as its letter."""
    register(spark)
    names(spark, folder).createOrReplaceTempView("lexiloom_names")
    return spark.sql("SELECT p_partkey, byte_letters(data) AS letters, letter_bytes(byte_letters(data)) = data AND unescape_bytes(escape_bytes(data)) = data AS same FROM lexiloom_names")


@query("resident_corpus", f"SELECT pass, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM ({gram_sql(2, 'benchmark')})), (SELECT unnest([1, 2])::INT AS pass) GROUP BY pass")
def resident_corpus(spark, folder):
    """Two passes over a corpus that stays in memory (on disk, where it does not fit)."""
    data = resident(benchmark(spark, folder))
    total = lambda k: grams.gram_counts(data, [2]).agg(F.sum("n").alias("n")).select(F.lit(k).alias("pass"), "n")
    return total(1).unionByName(total(2))


@query("wrapped_cursor", "SELECT i AS step, (i * 16) // 1000 AS epoch, (i * 16) % 1000 AS place FROM range(200) t(i)")
def wrapped_cursor(spark, folder):
    """An endless loader's cursor: steps of sixteen tokens over a shard of a thousand."""
    epoch, place = batches.wrapped(F.col("id") * 16, 1000)
    return spark.range(200).select(F.col("id").alias("step"), epoch.alias("epoch"), place.alias("place"))


@query("resumed_documents", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ordinal FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) > (SELECT count(*) // 3 FROM documents)")
def resumed_documents(spark, folder):
    """The documents from a saved place on: a third of them were read before."""
    from ..streaming.cursor import Cursor

    d = table(spark, folder, "documents").select("doc_id")
    c = Cursor(d, "doc_id")
    c.skip(c.total // 3)
    return Cursor.resume(d, "doc_id", c.state()).rest().select("doc_id", "ordinal")
