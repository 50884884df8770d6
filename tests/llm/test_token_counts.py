import public_tokenizers
import sentencepiece

from gleanwork.llm.common import stage_path
from gleanwork.llm.token_counts import PieceCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_and_cache(spark, docs, docs_rows):
    sp, cache = sentencepiece.SentencePieceProcessor(model_file=MODEL), stage_path(spark, "cache")
    want = sorted((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in docs_rows)
    assert sorted(map(tuple, token_counts(docs, MODEL, cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in docs_rows})
    assert sorted(map(tuple, token_counts(docs, MODEL, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored  # the second run encodes nothing


def test_empty_table(spark, no_docs):
    assert token_counts(no_docs, MODEL, stage_path(spark, "cache")).count() == 0


def test_words_as_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    counter, sp = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab' \n\t.,0é　\xa0▁<s>")), max_size=5))
    def same(texts):
        assert counter.count(texts) == [len(sp.encode(t)) for t in texts]

    same()
