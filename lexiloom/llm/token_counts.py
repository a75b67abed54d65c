"""Operator 7: token counts under a public vocabulary, by the whole-token shortcut."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, flat, slices, table

#: Distinct chunks of text whose counts one worker remembers; then it starts anew.
MEMORY = 150_000
#: Longer chunks are counted each time, so memory stays bounded.
MEMORABLE = 64
#: A text over so many tokens is over the limit.
LIMIT = 2048

#: The pattern that the vocabulary file gives for pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of these characters are stable under NFC, have the same classes in every Unicode version,
#: and lower-case character by character; any other chunk goes to the library whole.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-įı-ɏ]*\Z")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token, as the plain text they stand for.

    Run once on the driver: each word-ending string of the vocabulary goes through the model's own
    merges; it is kept only if exactly that token comes out.
    """
    from tokenizers import Tokenizer

    tokenizer, end = Tokenizer.from_str(spec), json.loads(spec)["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in enumerate(byte_letters())}
    proved = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not token.endswith(end) or len(token) == len(end):
            continue
        letters = token[: len(token) - len(end)]
        try:
            text = bytes(back[c] for c in letters).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if [t.value for t in tokenizer.model.tokenize(letters)] == [token]:
            proved.add(text)
    return frozenset(proved)


class Counter(dict):
    """chunk (bytes without ASCII white space) -> tokens; misses are computed and remembered."""

    def __init__(self, spec: str, whole: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_str(spec), whole
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in json.loads(spec).get("added_tokens", [])]
        self.pattern, self.letters, self.merged = regex.compile(PRE_TOKEN), byte_letters(), {}

    def merge(self, pre: str) -> int:
        """Tokens of a pre-token that isn't proved whole: the model's own merges."""
        n = self.merged.get(pre)
        if n is None:
            n = len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, pre.encode("utf-8")))))
            if len(pre) <= MEMORABLE:
                if len(self.merged) >= MEMORY:
                    self.merged.clear()
                self.merged[pre] = n
        return n

    def __missing__(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8", "replace")
        if not _PLAIN.match(text) or any(x in text for x in self.special):
            n = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            lower = text.lower()
            if lower in self.whole and lower.isalpha():
                n = 1
            else:
                n, whole, merge = 0, self.whole, self.merge
                for pre in self.pattern.findall(lower):
                    n += 1 if pre in whole else merge(pre)
        if len(chunk) <= MEMORABLE:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


def count_tokens(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row of ``docs`` under the vocabulary ``spec`` (the JSON text).

    Pre-tokens never span white space, so a text is counted chunk by chunk. A chunk that holds a
    special string or an unusual character is given to the library whole, so results equal it.
    Null and empty texts have 0 tokens. No row is dropped, repeated rows get equal counts, other columns are not looked
    at, an empty table gives an empty result; there is no shuffle. The driver ships
    the vocabulary (fixed size) to the workers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast((spec, whole_tokens(spec)))

    def run(batches):
        counter = Counter(*shipped.value)
        for batch in batches:
            data, off = flat(batch.column(1))
            raw, n = data.tobytes(), []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n.append(counter.count(raw[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text of ``documents``; ``vocabulary`` is the path of the JSON file.

    Null, empty and very long texts, repeated rows and empty tables: see ``count_tokens``."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    out = count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), spec)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
