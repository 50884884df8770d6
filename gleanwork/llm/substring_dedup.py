"""Removal of word runs that occur earlier in the corpus: seed and extend.

A window is LENGTH consecutive words of one document. Anchors are the SEED-word runs
that winnowing picks, the smallest hash among the seeds of a window, so equal windows
have equal anchors at equal places. An anchor with every window that picked it is one
row (a reach); reaches meet on the anchor and are extended both ways:

* a reach whose words are the same as an earlier one's is a repeat as a whole;
* reaches that share the anchor but differ further out are extended for all of them at once: a
  window is the anchor with so many words to its left and the rest to its right, told by
  128 bits of its words' hashes; only the first reach of each wording takes part.

Runs of repeated windows that touch or overlap merge to maximal repeats when they are
cut from the document.

Hot passages: within a block of documents (BLOCK bytes of text, of which only hashes are held)
only a reach's first occurrence goes on as a row that is compared; the rest are repeats already
and are dealt by their own position.

Edge cases: null and empty texts have no words; texts under LENGTH words keep all; the
earlier of two windows is the one with the smaller doc_id, then the smaller start; an
empty table gives no rows; other columns are ignored; very long texts are read whole. doc_id is a
key: rows that repeat a doc_id are compared by start alone, so equal rows are no repeats of each
other and keep their words alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions.batches import lists
from gleanwork.llm.common import BASE_A, BASE_B, Rolling, as_long, documents, hashed_words, slices, staged, table

LENGTH = 20
SEED = 8
#: Bytes of text whose words are hashed at once, and of a block whose reaches are compared before they move.
TEXT, BLOCK = 1_000_000, 24_000_000

REACHES = "anchor long, wording long, doc_id long, start int, windows int, repeat boolean"
REACH = [c.split()[0] for c in REACHES.split(", ")]


def _reaches(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> pd.DataFrame:
    n = len(hashes) - length + 1
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(ids)), counts)
    if n <= 0:
        return pd.DataFrame({c: np.zeros(0, kind) for c, kind in zip(REACH, ("i8", "i8", "i8", "i4", "i4"), strict=False)})
    rolling = Rolling(hashes, BASE_A)
    seeds = rolling.of(np.arange(len(hashes) - seed + 1), seed)
    best, at, have, want = seeds, np.arange(len(seeds)), 1, length - seed + 1
    while have < want:  # smallest seed of ever more consecutive ones; of equal ones the last
        step = min(have, want - have)
        left, right = slice(0, len(best) - step), slice(step, None)
        later = best[right] <= best[left]
        best, at, have = np.where(later, best[right], best[left]), np.where(later, at[right], at[left]), have + step
    valid = doc[:n] == doc[length - 1 :]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (doc[1:n] == doc[: n - 1]) & (at[1:n] == at[: n - 1]))
    start = np.flatnonzero(first)
    ends = np.flatnonzero(valid & np.append(~valid[1:] | first[1:], True))
    windows = ends - start + 1
    return pd.DataFrame({"anchor": as_long(seeds[at[start]]), "wording": as_long(Rolling(hashes, BASE_B).of(start, windows + length - 1)), "doc_id": ids[doc[start]], "start": (start - bounds[doc[start]]).astype(np.int32), "windows": windows.astype(np.int32)})


def _block(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The reaches of a block; repeat says that the block has the same words at an earlier place."""
    rows = pd.concat(parts)
    rows = rows.iloc[np.lexsort((rows["start"], rows["doc_id"], rows["wording"], rows["anchor"]))]
    anchor, wording, doc, start = (rows[c].to_numpy() for c in ("anchor", "wording", "doc_id", "start"))
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (wording[1:] != wording[:-1])) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rows.assign(repeat=(doc != doc[first]) | (start != start[first]))


def _starts_by_document(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()) for c in REACH], names=REACH)
    for part, (texts,) in lists(batches, ["text"], "text", TEXT):
        hashes, counts = hashed_words(texts)
        parts.append(_reaches(part.column("doc_id").to_numpy(), hashes, np.concatenate([[0], np.cumsum(counts)]), length, seed))
        size += sum(map(len, texts))
        if size > BLOCK:
            yield as_batch(_block(parts))
            parts, size = [], 0
    if parts:
        yield as_batch(_block(parts))


def _window_hashes(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The windows of the reaches listed with each document."""
    for batch in batches:
        for i, j in slices(batch["text"].str.len().tolist(), TEXT):
            part = batch.iloc[i:j]
            hashes, words = hashed_words(part["text"].tolist())
            bounds = np.concatenate([[0], np.cumsum(words)])
            starts = [np.array([r["start"] for r in x], dtype=np.int64) for x in part["reaches"]]
            counts = [np.array([r["windows"] for r in x], dtype=np.int64) for x in part["reaches"]]
            own = np.concatenate([np.repeat(s, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) for s, c in zip(starts, counts, strict=True)])
            doc = np.repeat(np.arange(len(part)), [c.sum() for c in counts])
            at = own + bounds[doc]
            yield pd.DataFrame({"a": as_long(Rolling(hashes, BASE_A).of(at, length)), "b": as_long(Rolling(hashes, BASE_B).of(at, length)), "doc_id": part["doc_id"].to_numpy()[doc], "start": own.astype(np.int32)})


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, start, words): word runs all of whose windows occur earlier; runs may overlap."""
    texts = documents(docs)
    place = F.struct("doc_id", "start")
    reaches = texts.mapInArrow(lambda b: _starts_by_document(b, length, seed), REACHES)
    # What a block knows to be a repeat is spread by its own place, so that it meets no other row.
    spread = F.when(F.col("repeat"), F.xxhash64("doc_id", "start", "anchor"))
    rows = reaches.withColumns({"anchor": F.coalesce(spread, "anchor"), "place": place})
    same_anchor = Window.partitionBy("anchor", "repeat")
    judged = (
        rows.withColumns({"low": F.min("wording").over(same_anchor), "high": F.max("wording").over(same_anchor)})
        .withColumn("first", F.min("place").over(Window.partitionBy("anchor", "repeat", "wording")))
        .withColumn("whole", F.col("repeat") | (F.col("first") != F.col("place")))
        .where(F.col("whole") | (F.col("low") != F.col("high")))
        .select("doc_id", "start", "windows", "whole")
    )
    judged = staged(judged, "reaches")
    listed = judged.where(~F.col("whole")).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("reaches"))
    windows = texts.join(listed, "doc_id").mapInPandas(lambda b: _window_hashes(b, length), "a long, b long, doc_id long, start int")
    windows = staged(windows, "windows")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = windows.join(firsts, ["a", "b"]).where(F.col("first") != place).select("doc_id", "start", F.lit(length).alias("words"))
    return judged.where("whole").select("doc_id", "start", (F.col("windows") + length - 1).alias("words")).unionByName(later)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, after every repeat is cut."""
    runs = repeats(docs, length, seed).groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                words = text.encode().split()
                if found is None:
                    out.append((doc, len(words), 0, b" ".join(words).decode()))
                    continue
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                begin = np.array([r["start"] for r in found])
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + np.array([r["words"] for r in found]), -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                out.append((doc, len(words), len(words) - len(kept), b" ".join([words[k] for k in kept]).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])

    return documents(docs).join(runs, "doc_id", "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
