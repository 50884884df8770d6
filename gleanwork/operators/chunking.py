"""Cleaning and chunking of long documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Our own patterns; the study names the kinds of damage, not the expressions.
FOOTNOTE = r"([.!?])\d{1,3}(?=\s|$)"
CAPTION = r"(?i)^\s*(table|figure|fig\.|표|그림)\s*\d+"
BROKEN_END = r"[^.!?\s]\s*$"
SENTENCE = r"(?<=[.!?])\s+"


def cleaned(c: Column, foreign: str | None = None, footnote: str = FOOTNOTE, caption: str = CAPTION) -> Column:
    """Without footnote numbers at sentence ends, caption lines, and lines of another language (pattern)."""
    lines = F.split(F.regexp_replace(c, footnote, "$1"), "\n")
    keep = lambda x: ~x.rlike(caption) & (F.lit(True) if foreign is None else ~x.rlike(foreign))
    return F.array_join(F.filter(lines, keep), "\n")


def damage(c: Column, foreign: str) -> dict[str, Column]:
    lines = F.split(c, "\n")
    return {"foreign": c.rlike(foreign), "broken_end": c.rlike(BROKEN_END), "caption": F.exists(lines, lambda x: x.rlike(CAPTION))}


def fixed(rows: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """One row per chunk: chunk_index and content, `size` characters every size - overlap; an empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size")
    step, n = size - overlap, F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(chunks).alias("chunk_index", "content"))


def by_line(rows: DataFrame, text: str = "text", pattern: str = "\n") -> DataFrame:
    """One row per part that is not blank, numbered as they stand."""
    parts = F.filter(F.split(text, pattern), lambda x: F.trim(x) != "")
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(parts).alias("chunk_index", "content"))


def packed(rows: DataFrame, size: int, text: str = "text", pattern: str = "\n", joiner: str = "\n") -> DataFrame:
    """Parts joined in order as long as a chunk stays within `size`; a longer part is a chunk of its own."""
    parts = F.filter(F.split(text, pattern), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit(None).cast("string").alias("open"))

    def add(s: Column, x: Column) -> Column:
        joined = F.concat(s["open"], F.lit(joiner), x)
        fits = F.length(joined) <= size
        return F.struct(
            F.when(s["open"].isNull() | fits, s["full"]).otherwise(F.array_append(s["full"], s["open"])).alias("full"),
            F.when(s["open"].isNull(), x).when(fits, joined).otherwise(x).alias("open"),
        )

    chunks = F.aggregate(parts, start, add, lambda s: F.when(s["open"].isNull(), s["full"]).otherwise(F.array_append(s["full"], s["open"])))
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(chunks).alias("chunk_index", "content"))


def _split(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text]
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    head, *rest = separators
    out: list[str] = []
    parts = text.split(head)
    for i, part in enumerate(parts):
        part += head if i < len(parts) - 1 else ""
        if out and len(out[-1]) + len(part) <= size:
            out[-1] += part
        elif part:
            out += _split(part, size, tuple(rest))
    return out


def recursive(rows: DataFrame, size: int, key: str, text: str = "text", separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """(key, chunk_index, content): split at the coarsest separator that makes parts small enough; the parts joined are the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, c) for k, t in zip(batch[key], batch[text].fillna(""), strict=True) for i, c in enumerate(_split(t, size, separators)) if c]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "content"])

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, chunk_index int, content string")


def parent_child(rows: DataFrame, size: int, overlap: int, key: str, text: str = "text") -> DataFrame:
    """Small chunks (content) of each paragraph (payload)."""
    parents = by_line(rows.select(key, text), text).select(key, F.col("chunk_index").alias("parent_index"), F.col("content").alias("payload"))
    return fixed(parents.withColumn("_t", F.col("payload")), size, overlap, "_t")


def breaks(rows: DataFrame, by: list[str], order: str, sim: str, threshold: float) -> DataFrame:
    """rows with a chunk number that grows where the similarity to the row before is under the threshold."""
    new = F.when(F.col(sim) < threshold, 1).otherwise(0)
    return rows.withColumn("chunk", F.sum(new).over(Window.partitionBy(*by).orderBy(order)))


#: A sentence ends with the white space behind its last mark; what is left at the end is one too.
SENTENCES = r"(?s).*?[.!?]+[\t\n\r ]+|.+"


def semantic(rows: DataFrame, factory, id: str, text: str = "text", threshold: float | None = None, percentile: float | None = None, most: int = 64) -> DataFrame:
    """(id, chunk_index, start, sentences, content): whole texts cut where a sentence is unlike the one before; chunks joined are the text.

    A break is a similarity of neighbours under `threshold`, or under this percentile of the text's own similarities.
    Sentences are encoded in order, `most` at once, and the last vector of a batch meets the first of the next, so
    nothing is joined. start counts characters. Null and empty texts have no chunk. factory() is called once a task.
    """
    from gleanwork.operators.models import unit_rows

    if (threshold is None) == (percentile is None):
        raise ValueError("give a threshold or a percentile")
    types, find = dict(rows.dtypes), re.compile(SENTENCES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for part in parts:
            for row, t in enumerate(part.column(text).to_pylist()):
                sentences, sims, last = find.findall(t or ""), [], None
                for i in range(0, len(sentences), most):
                    v = unit_rows(encoder(sentences[i : i + most]))
                    near = v if last is None else np.concatenate([last, v])
                    sims.append(np.round((near[1:] * near[:-1]).sum(axis=1), 9))
                    last = v[-1:]
                if not sentences:
                    continue
                sims = np.concatenate(sims)
                edge = threshold if threshold is not None else (float(np.percentile(sims, percentile)) if len(sims) else 0.0)
                begin = np.flatnonzero(np.append(True, sims < edge))
                size = np.diff(np.append(begin, len(sentences)))
                content = ["".join(sentences[b : b + n]) for b, n in zip(begin, size, strict=True)]
                start = np.cumsum([0, *(len(c) for c in content[:-1])])
                arrays = [part.column(id).take(pa.array(np.full(len(begin), row))), pa.array(np.arange(len(begin), dtype=np.int32)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id, "chunk_index", "start", "sentences", "content"])

    return rows.select(id, text).mapInArrow(run, f"`{id}` {types[id]}, chunk_index int, start long, sentences int, content string")


def decomposed(rows: DataFrame, flag: str, text: str = "content", pattern: str = SENTENCE) -> DataFrame:
    """Flagged rows become one row per question; one that does not split, and all others, stay as they are."""
    parts = F.filter(F.split(text, pattern), lambda x: F.trim(x) != "")
    chosen = F.when(F.col(flag) & (F.size(parts) > 1), parts).otherwise(F.array(text))
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(chosen).alias("part", text))
