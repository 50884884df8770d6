"""Jobs around models. The model is a function of a batch; the job is what Spark does around it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.batches import with_made

#: A batch's rows, and its rows times the length of its longest text.
MAX_ROWS, MAX_CHARS = 32, 8000

Encoder = Callable[[Sequence[str]], np.ndarray]


def batches(lengths: Sequence[int], max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges within both budgets; each has one row at least."""
    begin, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > begin and (i - begin >= max_rows or (i - begin + 1) * longest > max_chars):
            yield begin, i
            begin, longest = i, n
    if begin < len(lengths):
        yield begin, len(lengths)


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashed words."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.split():
                h = xxhash.xxh3_64_intdigest(word.encode())
                row[h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def letter_encoder() -> Encoder:
    """A deterministic stand-in that SQL can repeat: how often a text has each letter a to z."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]

    def encode(texts: Sequence[str]) -> np.ndarray:
        return np.array([[t.count(x) for x in letters] for t in texts], dtype=np.float64).reshape(-1, len(letters))

    return encode


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def vectors(rows: DataFrame, factory: Callable[[], Encoder], text: str, kept: Sequence[str]) -> DataFrame:
    """(kept, v): unit vectors of a text column, a model's batch at a time; factory() is called once a task. Null is the empty text."""
    types = dict(rows.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for part in parts:
            texts = [t or "" for t in part.column(text).to_pylist()]
            for i, j in batches([len(t) for t in texts]):
                v = pa.array(list(unit_rows(encoder(texts[i:j]))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(i, j - i) for c in kept), v], names=[*kept, "v"])

    return rows.select(*dict.fromkeys([*kept, text])).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "v array<double>"]))


def vectors_with_own(rows: DataFrame, factory: Callable[[], Encoder], text: str, lists: str, digits: int, at_once: int = 256) -> DataFrame:
    """(id, part, content, v, own): the unit vectors of the texts of rows (id, text, lists), and of each text in their lists.

    A text's own row has no part, a list's has its place in it and own, its rounded similarity to the row's text. Each is encoded once.
    """
    kind = dict(rows.dtypes)["id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for whole in parts:
            for part in (whole.slice(k, at_once) for k in range(0, whole.num_rows, at_once)):
                ids, texts, more = part.column("id"), part.column(text).to_pylist(), [x or [] for x in part.column(lists).to_pylist()]
                row = np.repeat(np.arange(len(texts)), [1 + len(x) for x in more])
                first = np.append(0, np.cumsum([1 + len(x) for x in more]))[:-1]
                flat = [t for own, x in zip(texts, more, strict=True) for t in (own, *x)]
                made = [unit_rows(encoder([t or "" for t in flat[i:j]])) for i, j in batches([len(t or "") for t in flat])]
                v = np.concatenate(made)
                place, asked = np.arange(len(flat)) - first[row] - 1, np.arange(len(flat)) != first[row]
                own = np.round((v * v[first[row]]).sum(axis=1), digits)
                content = pa.array([t if a else None for t, a in zip(flat, asked, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(place.astype(np.int32), mask=~asked), content, pa.array(list(v), pa.list_(pa.float64())), pa.array(own, mask=~asked)], names=["id", "part", "content", "v", "own"])

    return rows.select("id", text, lists).mapInArrow(run, f"id {kind}, part int, content string, v array<double>, own double")


def embed(items: DataFrame, encoder: Encoder, model: str, dim: int, query_prefix: str, passage_prefix: str, max_seq_len: int | None, partitions: int) -> DataFrame:
    """Embedding rows of items (kind, id, text): longest first, kinds apart, unit length, the settings in every row."""
    schema = "kind string, id string, embedding array<float>, model_name string, dim int, query_prefix string, passage_prefix string, max_seq_len int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for kind, rows in part.groupby("kind", sort=False):
                rows = rows.reset_index(drop=True)
                for i, j in batches(rows["text"].str.len().tolist()):
                    v = np.asarray(encoder(rows["text"].iloc[i:j].tolist()), dtype=np.float64)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    out = pd.DataFrame({"kind": kind, "id": rows["id"].iloc[i:j], "embedding": list(v.astype(np.float32)), "model_name": model, "dim": dim, "query_prefix": query_prefix, "passage_prefix": passage_prefix})
                    yield out.assign(max_seq_len=pd.Series([max_seq_len] * len(out), index=out.index, dtype="Int32"))

    dealt = items.repartition(partitions, "kind", F.xxhash64("id") % (2 * partitions)).sortWithinPartitions("kind", F.desc(F.length("text")))
    return dealt.mapInPandas(run, schema)


def score_pairs(pairs: DataFrame, scorer: Callable[[Sequence[str], Sequence[str]], Sequence[float]]) -> DataFrame:
    """pairs (query_text, text, ...) with a score, 16 queries' worth of rows at a time."""

    def score(queries: list[str], texts: list[str]) -> list[np.ndarray]:
        cuts = range(0, len(texts), 16 * 20)
        return [np.concatenate([np.zeros(0), *(np.asarray(scorer(queries[i : i + 320], texts[i : i + 320]), dtype=np.float64) for i in cuts)])]

    return with_made(pairs, "score double", ["query_text", "text"], lambda: score)


def overlap_scorer(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
    """A stand-in for a cross-encoder: the share of the query's words that the text has."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        words = set(q.split())
        out.append(round(len(words & set(t.split())) / max(1, len(words)), 9))
    return out


def count_tokens(rows: DataFrame, factory: Callable[[], Callable[[Sequence[str]], Sequence[int]]], text: str = "content") -> DataFrame:
    """rows with n_tokens of the whole text, by a counter that factory() makes once a task; null counts as empty. For profile.over_limit(..., counted=True)."""

    def start():
        counter = factory()
        return lambda texts: [[int(n) for n in counter([t or "" for t in texts])]]

    return with_made(rows, "n_tokens bigint", [text], start, text)


def word_counter() -> Callable[[Sequence[str]], list[int]]:
    """A stand-in for a tokenizer: runs of anything but white space."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    return lambda texts: [sum(1 for _ in word.finditer(t)) for t in texts]


def rewrite(rows: DataFrame, rewriter: Callable[[str], str], text: str = "content") -> DataFrame:
    """rows with query and error; a failure is kept with its type, not raised."""

    def one(t: str) -> tuple[str | None, str | None]:
        try:
            q = rewriter(t)
        except Exception as e:  # the model's failure is data here
            return None, f"API: {type(e).__name__}"
        return (q, None) if q and q.strip() else (None, "empty")

    def run(texts: list[str | None]) -> tuple[Sequence, ...]:
        done = [one(t or "") for t in texts]
        return [q for q, _ in done], [e for _, e in done]

    return with_made(rows, "query string, error string", [text], lambda: run)


def judge(results: DataFrame, judgement: Callable[[str, str], float]) -> DataFrame:
    """results (query_text, context, ...) with a judgement."""

    def run(queries: list[str], contexts: list[str]) -> list[list[float]]:
        return [[float(judgement(q, c)) for q, c in zip(queries, contexts, strict=True)]]

    return with_made(results, "judgement double", ["query_text", "context"], lambda: run)
