"""Token counts behind a digest cache.

A text's key is the SHA-256 of its content together with a digest of the tokenizer file
and its mode. The content is normalised only as far as the tokenizer itself is blind to
it; for a vocabulary that keeps case and white space that is null -> empty. Keys
are reduced to distinct ones map side, so a text that a third of all rows share moves
once per map task; keys that the cache has are dropped, the rest is encoded and appended.
Counts then come from a join on the key: those of texts that more than 1 / HOT of all rows share, at most
HOT of them, are broadcast, all others are dealt by key.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row;
an empty table gives no rows; other columns are ignored; very long texts are encoded whole.
A cache that holds a key twice (two jobs appending at once) still gives one row per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, stage_path, staged, table

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"
#: Entries of a worker's memo of counted words; beyond it the memo starts again.
MEMO = 500_000

#: A text with more than this share of all rows is hot.
HOT = 10_000

_counters: dict = {}


class PieceCounter:
    """Token counts of whole texts. Words are counted once where no piece of the vocabulary joins text across a space."""

    def __init__(self, path: str, most: int = MEMO):
        import sentencepiece

        self.model, self.most, self.memo = sentencepiece.SentencePieceProcessor(model_file=path), most, {}
        m = self.model
        self.by_word = not any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())) and m.encode("a") + m.encode("b") == m.encode("a b")

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") if self.by_word and t and not ("  " in t or t[0] == " " or t[-1] == " " or "▁" in t) else None for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        new = list({w for s in split if s for w in s if w not in memo})
        memo.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return [sum([memo[w] for w in s]) if s is not None else len(self.model.encode(t)) for s, t in zip(split, texts, strict=True)]


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def version_of(path: str, mode: str = "plain-1") -> str:
    with open(path, "rb") as f:
        return f"{mode}:{hashlib.sha256(f.read()).hexdigest()}"


def token_counts(docs: DataFrame, model: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs; encodes what the cache at that path lacks, and appends it."""
    spark, version = docs.sparkSession, version_of(model)
    keyed = documents(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    try:
        old = spark.read.schema(CACHE).parquet(cache)
        known = old.where(F.col("version") == version).select("digest")
    except Exception as e:  # the first run: there is no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "digest binary")
    missing = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model).count
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                yield pd.DataFrame({"digest": part["digest"], "version": version, "n_tokens": count(part["text"].tolist())})

    missing.mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = staged(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    hot = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > rows.count() / HOT).select("digest")
    hot = staged(counts.join(hot, "digest", "left_semi"), "hot-counts")
    first = rows.join(F.broadcast(hot), "digest", "left")
    rest = first.where("n_tokens is null").drop("n_tokens").join(counts, "digest")
    out = first.where("n_tokens is not null").unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), stage_path(spark, "token-cache"))
