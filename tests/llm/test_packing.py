import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from gleanwork.llm.packing import OpenWindows, WordEncoder, byte_bpe, pack, packer


def test_pieces_round_trip(docs, docs_rows):
    tok = Tokenizer.from_file(byte_bpe())
    got = pack(docs, byte_bpe(), shard_docs=4).toPandas()
    for doc, text, *_ in docs_rows[:-1]:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        rows = got[got.doc_id == doc].drop_duplicates("start").sort_values("start")
        assert rows.length.sum() == len(ids) and (rows.doc_tokens == len(ids)).all()
        for start, n, crc in zip(rows.start, rows.length, rows.ids_crc32):
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    assert len(got[got.doc_id == 4]) == 2  # a repeated row is packed twice
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048


def test_empty_table(no_docs):
    assert pack(no_docs, byte_bpe()).count() == 0


def test_tightest_window():
    rng, open_, known = np.random.default_rng(3), OpenWindows(64), []
    for step in range(3000):
        n = int(rng.integers(1, 65))
        if rng.random() < 0.5:
            open_.add(n, step)
            known.append(n)
        else:
            best = min((k for k in known if k >= n), default=None)
            got = open_.take(n)
            assert (got and got[0]) == best
            if best is not None:
                known.remove(best)


def test_whole_shard_against_plain_best_fit():
    """The windows of a shard are filled as by a search of all open windows for each piece, the longest first."""
    rng = np.random.default_rng(8)
    for window, n in ((64, 400), (2048, 700), (16, 1)):
        length = rng.integers(1, window + 1, n) if window > 64 else rng.choice([1, 2, 5, window // 2, window], n)
        shard = pd.DataFrame({"doc_id": rng.integers(0, n, n), "start": 0, "length": length, "ids_crc32": rng.integers(0, 1 << 32, n), "doc_tokens": length, "shard": 3, "shards": 7})
        got = packer(window)(shard)
        free = []
        for x in sorted(length.tolist(), reverse=True):
            fits = [k for k, room in enumerate(free) if room >= x]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= x
            else:
                free.append(window - x)
        fill = got.groupby("sequence_id").length.sum()
        assert sorted(fill) == sorted(window - room for room in free) and (got.sequence_id % 7 == 3).all() and len(got) == n
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]


def test_words_as_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc, tok = WordEncoder(byte_bpe()), Tokenizer.from_file(byte_bpe())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab' \n\t.,0é　\x1c<|endoftext|>")), max_size=5))
    def same(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    same()


def test_new_words_are_encoded_together():
    """Not one by one, and their ids fall apart as the library gives them, among them words with special tokens, bytes and line breaks."""
    enc, tok, calls = WordEncoder(byte_bpe()), Tokenizer.from_file(byte_bpe()), []
    encode = enc._encode
    enc._encode = lambda texts: calls.append(len(texts)) or encode(texts)
    texts = [" ".join(f"wörd{i}'s<|endoftext|>{i}\n\u00e9{i * i},x" for i in range(k, k + 500)) for k in (0, 250)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert sum(calls) < 100
