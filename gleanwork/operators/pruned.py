"""BM25 search with pruning: impact-ordered postings in document shards, and a threshold that starts from a first pass.

A shard is what one task has of the documents, up to SHARD of them, and one row of the index: for each term the
postings in falling order of impact (the part of the score that does not depend on the term), and their order by document.
A block of BLOCK postings is bounded by its first one.

A search has two passes over the shards. The first scores the 4 k documents that the first blocks of each query's
best terms put in front, and the k-th best score over all shards is the query's floor. In the second a shard skips, for each term, all blocks
whose bound with the best of the terms after it stays under the floor (a document that has none of the terms before
and such a posting cannot reach it), so the last terms, which are the most common ones, give no new document at
all; and it looks a term up only for documents that still can reach the floor. What reaches the floor leaves the shard, k documents a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gleanwork.functions.staging import staged
from gleanwork.operators.ranking import positioned

SHARD, BLOCK, MOST = 8192, 128, 16_384
#: Postings of the first pass for each place of the answer.
FIRST = 16
#: Scores are compared after rounding to so many digits, and bounds are that much looser.
DIGITS, LOOSE = 9, 1e-8


@dataclass
class Shard:
    """Postings of a shard by term: places of documents and impacts, falling; and the same by place."""

    ids: np.ndarray
    terms: dict[str, int]
    begin: np.ndarray
    places: np.ndarray
    impacts: np.ndarray
    by_place: np.ndarray

    def term(self, t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        at = self.terms.get(t)
        if at is None:
            return None
        own = slice(self.begin[at], self.begin[at + 1])
        return self.places[own], self.impacts[own], self.by_place[own]


def search(shard: Shard, query: list[tuple[str, float]], k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, postings read) of the documents that reach the floor, the k best; query is (term, weight).

    Without a floor: of the 4 k documents that the first blocks of the terms with the highest bounds put in front.
    """
    lists = [(w * p[1][0], w, *p) for t, w in query if (p := shard.term(t)) is not None and w > 0]
    lists.sort(key=lambda x: -x[0])
    left = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0.0)  # the best that the terms from each on can add
    found, scores, read = np.zeros(0, np.int64), np.zeros(0), 0
    least = -np.inf if floor is None else floor - LOOSE
    if floor is None and lists:
        firsts = [places[:BLOCK] for _, _, places, *_ in lists]
        enough = int(np.searchsorted(np.cumsum([len(c) for c in firsts]), FIRST * k)) + 1
        read = sum(len(c) for c in firsts[:enough])
        found, at = np.unique(np.concatenate(firsts[:enough]), return_inverse=True)
        partial = np.bincount(at, np.concatenate([w * impacts[:BLOCK] for _, w, _, impacts, _ in lists[:enough]]))
        found = np.sort(found[np.argsort(-partial, kind="stable")[: 4 * k]])
        scores = np.zeros(len(found))
    for n, (_, w, places, impacts, by_place) in enumerate(lists):
        keep = scores + left[n] >= least
        found, scores, cut = found[keep], scores[keep], 0
        if floor is not None and left[n] >= least:
            # A document that has none of the terms before must make up for it here.
            need = (least - left[n + 1]) / w
            cut = int(np.searchsorted(-impacts, -need, side="right")) if need > 0 else len(impacts)
            cut = min(len(impacts), -(-cut // BLOCK) * BLOCK)
            both = np.union1d(found, places[:cut])
            more = np.zeros(len(both))
            more[np.searchsorted(both, found)] = scores
            found, scores, read = both, more, read + cut
        own = places[by_place]
        at = np.searchsorted(own, found)
        hit = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == found))
        scores[hit] += w * impacts[by_place[at[hit]]]
        read += int((by_place[at[hit]] >= max(cut, BLOCK * (floor is None and n < enough))).sum())
        if floor is not None and len(scores) >= k:
            # Scores only grow, so the k-th best of now is a floor too.
            least = max(least, float(np.partition(scores, -k)[-k]) - LOOSE)
    scores = np.round(scores, DIGITS)
    best = np.lexsort((shard.ids[found], -scores))
    best = best[scores[best] >= least][:k]
    return found[best], scores[best], read


@dataclass
class Statistics:
    """Number of documents, their mean length, and documents of each asked term."""

    n_docs: int
    mean: float
    df: dict[str, int]

    def weights(self, terms: list[str]) -> list[tuple[str, float]]:
        return [(t, float(np.log(1 + (self.n_docs - self.df[t] + 0.5) / (self.df[t] + 0.5)))) for t in terms if t in self.df]


INDEX = "ids array<{id}>, terms array<string>, begin array<int>, places array<int>, impacts array<double>, by_place array<int>"


def index(docs: DataFrame, tokens: Column, asked: set[str] | None, mean: float, k1: float, b: float) -> DataFrame:
    """The shards of docs (id), a row each; with asked, only these terms have postings."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                lists = part.column("tokens")
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                encoded = lists.flatten().dictionary_encode()
                words = encoded.dictionary.to_pylist()
                kept = np.array([w is not None and (shared.value is None or w in shared.value) for w in words], dtype=bool)
                doc, code = np.repeat(np.arange(part.num_rows), size), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc, code = doc[kept[code]], code[kept[code]]
                pair, tf = np.unique(code * part.num_rows + doc, return_counts=True)
                code, doc = pair // part.num_rows, pair % part.num_rows
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / mean))
                order = np.lexsort((doc, -impact, code))
                code, doc, impact = code[order], doc[order], impact[order]
                there, begin = np.unique(code, return_index=True)
                begin = np.append(begin, len(code))
                by_place = np.lexsort((doc, code)) - np.repeat(begin[:-1], np.diff(begin))
                row = [part.column("id").to_pylist(), [words[c] for c in there], begin, doc, impact, by_place]
                kinds = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in zip(row, kinds, strict=True)], names=["ids", "terms", "begin", "places", "impacts", "by_place"])

    return docs.select("id", tokens.alias("tokens")).mapInArrow(run, INDEX.format(id=kind.simpleString()))


def shards(batch: pa.RecordBatch) -> Iterator[Shard]:
    for row in range(batch.num_rows):
        ids, terms, *rest = (batch.column(c)[row].values for c in ("ids", "terms", "begin", "places", "impacts", "by_place"))
        names = np.array(ids.to_pylist()) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)
        yield Shard(names, {t: k for k, t in enumerate(terms.to_pylist())}, *(c.to_numpy(zero_copy_only=False) for c in rest))


def _pass(found: DataFrame, asked: list, kind_of_query: DataType, weights: list, floors: dict, k: int, first: bool) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((asked, weights, floors))
    kind = found.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, floors = shared.value
        for batch in batches:
            for shard in shards(batch):
                qids, ids, scores = [], [], []
                for qid, query in zip(asked, weights, strict=True):
                    places, score, _ = search(shard, query, k, None if first else floors.get(qid, 0.0))
                    qids += [qid] * len(places)
                    ids += shard.ids[places].tolist()
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qids, to_arrow_type(kind_of_query)), pa.array(ids, to_arrow_type(kind)), pa.array(scores, pa.float64())], names=["qid", "id", "score"])

    return found.mapInArrow(run, f"qid {kind_of_query.simpleString()}, id {kind.simpleString()}, score double")


def bm25_pruned(queries: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column, k: int, k1: float, b: float, most: int | None = None) -> DataFrame | None:
    """keyword.bm25() by pruned search, for `most` queries at most; else None. Documents are tokenized and dealt where they lie."""
    most = MOST if most is None else most
    rows = queries.where("qid is not null").select("qid", query_tokens.alias("t")).limit(most + 1).collect()
    if len(rows) > most:
        return None
    terms: dict = {}
    for r in rows:
        terms[r.qid] = sorted({*terms.get(r.qid, []), *(t for t in r.t or [] if t is not None)})
    wanted = set().union(*terms.values()) if terms else set()
    total = docs.select(F.size(doc_tokens).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    found = staged(index(docs, doc_tokens, wanted, total["mean"] or 1.0, k1, b), "keyword-index")
    sizes = F.explode(F.arrays_zip("terms", F.transform(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.get("begin", i + 1) - F.get("begin", i)).alias("n")))
    df = found.where(F.size("terms") > 0).select(sizes.alias("x")).groupBy("x.terms").agg(F.sum("x.n").alias("df")).collect()
    known = Statistics(total["n"], total["mean"] or 1.0, {r[0]: r[1] for r in df})
    asked = list(terms)
    weights, kind = [known.weights(terms[q]) for q in asked], queries.schema["qid"].dataType
    order = [F.desc("score"), F.col("id")]
    first = positioned(_pass(found, asked, kind, weights, {}, k, True), ["qid"], order, k)
    floors = {r.qid: r.floor for r in first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).collect()}
    return positioned(_pass(found, asked, kind, weights, floors, k, False), ["qid"], order, k).select("qid", "id", "score", "pos")
