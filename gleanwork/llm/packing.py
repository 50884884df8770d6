"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Token ids never leave the task that made them: a document is cut at multiples of the
window, and each piece goes on as (doc_id, start, length, crc). Pieces are dealt by hash
to shards of bounded expected size, so a source, document or group of copies of any size
spreads evenly, and every shard is packed in one streaming pass: pieces arrive longest
first and a segment tree over the remaining capacities finds the tightest open window.
Best fit loses at most about one window a shard against packing everything at once.

Edge cases: null and empty texts are one end token; texts over the window fill whole
windows first and their rest is packed like any document; ties go by (doc_id, start);
repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.batches import lists
from gleanwork.llm.common import documents, parts_for, table

WINDOW = 2048
END_ID = 1
#: Documents a shard, on average.
SHARD_DOCS = 2000
#: Encoded words that a worker remembers at most twice over: the latest, and those before them that came again.
MEMO = 250_000
#: Bytes of text that are encoded at once, and new words.
TEXT, JOINED = 1_000_000, 50

_memos: dict = {}


class WordEncoder:
    """Ids of whole texts, remembered word by word.

    The byte-level splitter starts a new unit at a single space or line break between
    two visible characters, so such a text's ids are those of its words in order. A text
    with any other white space goes to the tokenizer whole. When `most` words are
    remembered they become the old ones, and of these only what comes again is kept.
    New words are encoded as texts of JOINED words: in them just the first token of a word
    starts with a space or line break, so the ids fall apart again where such a token is.
    """

    def __init__(self, path: str, most: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo, self.old = Tokenizer.from_file(path), most, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True  # the byte-level letters of both

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words that each begin with a space or line break and have no other."""
        joined = self._encode(["".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        data = b"".join(joined)
        begin = (4 * np.flatnonzero(self.starts[np.frombuffer(data, dtype=np.uint32)])).tolist()
        return [data[i:j] for i, j in zip(begin, [*begin, len(data)][1:], strict=True)]

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The words, the first with \\r in front, those after a line break with it; None if some white space is not one space or line break."""
        gaps, plain = text.count(" ") + text.count("\n"), text.split()
        if gaps != len(plain) - 1 or gaps + sum(map(len, plain)) != len(text):
            return None
        return ("\r" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        need = set().union(*filter(None, split)).difference(memo)
        memo.update([(w, old[w]) for w in need if w in old])
        new = need.difference(old)
        first = [w for w in new if w[0] == "\r"]
        memo.update(zip(first, self._encode([w[1:] for w in first]), strict=True))
        new = list(new.difference(first))
        memo.update(zip(new, self._encode_words([w if w[0] == "\n" else " " + w for w in new]), strict=True))
        whole = iter(self._encode([t for t, s in zip(texts, split, strict=True) if s is None]))
        return [b"".join(map(memo.__getitem__, s)) if s is not None else next(whole) for s in split]


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file."""
    if path not in _memos:
        _memos[path] = WordEncoder(path)
    return _memos[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut at multiples of the window."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer)
        for _, (docs, texts) in lists(batches, ["doc_id", "text"], "text", TEXT):
            rows = []
            for doc, ids in zip(docs, enc.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """Segment tree over remaining capacities 0..window: the smallest capacity that is at least a length and has an open window."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.stacks: list[list] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, item) -> None:
        self.stacks[capacity].append(item)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, least: int) -> tuple[int, object] | None:
        i, n = least + self.size, self.count
        if not n[i]:
            while i > 1 and (i & 1 or not n[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if n[2 * i] else 2 * i + 1
        capacity, item = i - self.size, self.stacks[i - self.size].pop()
        while i:
            n[i] -= 1
            i //= 2
        return capacity, item


def packer(window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        free, local, offset, opened = OpenWindows(window), [], [], 0
        for n in shard["length"].tolist():
            found = free.take(n) if n < window else None
            if found is None:
                room, w, opened = window, opened, opened + 1
            else:
                room, w = found
            local.append(w)
            offset.append(window - room)
            if room > n:
                free.add(room - n, w)
        shards = shard["shards"].iloc[0]
        return shard.assign(sequence_id=shard["shard"].to_numpy() + shards * np.array(local, dtype=np.int64), offset=np.array(offset, dtype=np.int64))

    return pack


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: pieces() with sequence_id (unique over all shards) and offset in that sequence."""
    shards = parts_for(docs.count(), shard_docs)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = pieces(docs, tokenizer, window, end_id).withColumns({"shards": F.lit(shards).cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))})
    return dealt.groupBy("shard").applyInPandas(lambda p: packer(window)(p)[[c.split()[0] for c in schema.split(", ")]], schema)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())
