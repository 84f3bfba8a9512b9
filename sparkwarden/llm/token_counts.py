"""Token counts of texts, kept in a cache under digests of the text and of the tokenizer.

A count is the same for all texts that a tokenizer can't tell apart, so texts are brought to a normal form first, as far as the
tokenizer's own rules allow (:func:`normal_form`), and known by its SHA-256.  A tokenizer's version is a digest of its file and
of the library that reads it.  Digests are joined with the stored counts of that version; each different text that
is not there is encoded once and appended; all counts are then read from the cache.

The cache is a Parquet table, one folder per version.  Appending is Spark's own commit, so lost tasks leave nothing.  Two jobs that append the
same text at once store its count twice; readers take one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import SPACE_RUN, SPACES, process_cache, stored
from sparkwarden.llm.hot import spread_join
from sparkwarden.llm.tokens import Encoder

LIMIT = 2048
CACHE = "digest binary, n_tokens long"
#: Missing digests up to which they are broadcast to the texts (32 bytes each); more meet the texts by a shuffle.
BROADCAST_MISSES = 100_000


class Counter:
    """Counts a text's tokens as the library of a tokenizer file does, without special tokens of its own, truncation or padding."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text, num_threads=1))
        elif drops_spaces(path):
            encoder = Encoder(path)
            encoder.tokenizer.no_truncation()
            encoder.tokenizer.no_padding()
            self.count = lambda text: len(encoder.ids(text))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            raise ValueError(f"no library for {path}: .json and .model are known")


def version(path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def _config(path: str) -> dict:
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def drops_spaces(path: str) -> bool:
    """Whether a tokenizer file makes one blank of white space, ignores case and never has a blank in a token."""
    config = _config(path)
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (config.get("normalizer") or {}).get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        return False
    parts = config["pre_tokenizer"].get("pretokenizers", [{}])
    kept = parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed"
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in config["added_tokens"])
    return bool(kept and plain and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"]["Regex"])


def normal_form(text: Column, path: str) -> Column:
    """A text with the same number of tokens, equal for texts that the tokenizer can't tell apart.

    For a tokenizer that drops white space: ASCII white space trimmed and its runs as one blank; ASCII texts in lower case
    unless that would make a special token's string.  For any other the text itself.  A null is an empty text.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    if not drops_spaces(path):
        return whole
    even = F.regexp_replace(F.btrim(whole, F.lit(SPACES)), SPACE_RUN, " ")
    low = F.lower(even)
    special = F.lit(False)
    for token in _config(path)["added_tokens"]:
        special = special | F.contains(low, F.lit(token["content"].lower()))
    return F.when((F.octet_length(even) == F.char_length(even)) & ~special, low).otherwise(even)


def cached(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """CACHE rows of a tokenizer's version, one per digest; none if nothing was stored."""
    folder = f"{cache}/version={version(path)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """CACHE rows of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = process_cache(f"counter {path}", lambda: Counter(path)).count
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE)


def fill(texts: DataFrame, wanted: DataFrame, cache: str, path: str) -> int:
    """Encode the texts (digest, text) of ``wanted`` digests that the cache lacks, once each, and append them: how many.

    A text that many rows share goes to its task once per task that read it, not once per row.
    """
    spark = texts.sparkSession
    lacking = stored(wanted.select("digest").join(cached(spark, cache, path), "digest", "left_anti"), "token-misses")
    n = lacking.count()
    if n == 0:
        return 0
    first = lambda df: df.groupBy("digest").agg(F.any_value("text").alias("text"))
    if n <= BROADCAST_MISSES:
        missed = first(texts.join(F.broadcast(lacking), "digest", "left_semi"))
    else:
        missed = first(texts).join(lacking, "digest", "left_semi")
    encoded(missed, path).write.mode("append").parquet(f"{cache}/version={version(path)}")
    return n


def counted(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as empty (no bytes, no tokens).  Rows that repeat a doc_id, or have none, are counted each.  An
    empty table gives no rows and stores nothing.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    text = normal_form(F.col("text"), path)
    digest = lambda c: F.unhex(F.sha2(c, 256))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(text).alias("digest"))
    rows = stored(rows, "token-digests")
    wanted = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows")), "token-wanted")
    fill(docs.select(text.alias("text")).select(digest(F.col("text")).alias("digest"), "text"), wanted, cache, path)
    counts = stored(wanted.join(cached(spark, cache, path), "digest"), "token-counts")
    found = spread_join(rows, counts, "digest", "n_rows")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
