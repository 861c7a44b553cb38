import pytest
import sentencepiece

from lacunae.llm.queries import vocabulary
from lacunae.llm.token_counts import count_tokens

MODEL = vocabulary("piece_bpe_32k.model")


def expected(df):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy_limit", [0, 50, 1 << 18])
def test_same_as_whole_texts(documents, heavy_limit):
    out = count_tokens(documents, MODEL, heavy_limit=heavy_limit, heavy_share=1e-4).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == expected(documents)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out)


@pytest.mark.parametrize("heavy_limit", [0, 1 << 18])
def test_odd_rows(odd_documents, no_documents, heavy_limit):
    out = count_tokens(odd_documents, MODEL, heavy_limit=heavy_limit).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == expected(odd_documents)
    assert count_tokens(no_documents, MODEL).collect() == []
