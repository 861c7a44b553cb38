import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacunae.llm.packing import (ChunkEncoder, best_fit, complete_bins, lower_bound, pack,
                                 pack_documents, tokenised)
from lacunae.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def histogram(lengths, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for x in lengths:
        counts[x] += 1
    return counts


def fewest(lengths, capacity):
    """Brute force over all assignments."""
    lengths = sorted(lengths, reverse=True)

    def fits(bins, i):
        if i == len(lengths):
            return True
        for b in range(len(bins)):
            if bins[b] >= lengths[i] and bins[b] not in bins[:b]:
                bins[b] -= lengths[i]
                if fits(bins, i + 1):
                    return True
                bins[b] += lengths[i]
        return False

    return next(k for k in itertools.count() if fits([capacity] * k, 0))


def check_plan(plan, lengths, capacity):
    assert Counter(x for p, k in plan for x in p for _ in range(k)) == Counter(lengths)
    assert all(sum(p) <= capacity for p, _ in plan)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11))
def test_fewest_sequences(lengths):
    counts = histogram(lengths, 20)
    plan = complete_bins(counts, 20, width=50)
    check_plan(plan, lengths, 20)
    check_plan(best_fit(counts, 20), lengths, 20)
    assert lower_bound(counts, 20) <= fewest(lengths, 20)
    assert sum(k for _, k in plan) == fewest(lengths, 20)


def test_best_fit_is_that_of_single_items():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted(rng.integers(1, 40, 60).tolist(), reverse=True)
        bins = []
        for x in lengths:
            fit = min((r for r in bins if r >= x), default=None)
            if fit is not None:
                bins.remove(fit)
            bins.append((50 if fit is None else fit) - x)
        plan = best_fit(histogram(lengths, 50), 50)
        check_plan(plan, lengths, 50)
        assert sum(k for _, k in plan) == len(bins)


def test_many_pieces_reach_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 50_000).astype(int) + 1)
    counts = histogram(lengths, 2048)
    plan = complete_bins(counts, 2048)
    check_plan(plan, lengths.tolist(), 2048)
    assert sum(k for _, k in plan) <= 1.0005 * lower_bound(counts, 2048) + 1


def whole(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t  \x1c\x85,'s12世<|>"), max_size=30))
def test_chunks_encode_as_whole_texts(text):
    text += "<|endoftext|>" if len(text) % 3 == 0 else ""
    assert ENCODER([text])[0] + b"\0\0\0\0" == whole([text])[0].tobytes()


ENCODER = ChunkEncoder(PATH)


def test_documents_round_trip(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    ids = dict(zip(texts, whole(texts.values()), strict=True))
    out = pack_documents(documents, PATH).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(rows):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            at += r.length
            assert zlib.crc32(ids[d][r.start:at].tobytes()) == r.ids_crc32
        assert at == len(ids[d])
    for rows in by_seq.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    counts = histogram([r.length for r in out], 2048)
    assert len(by_seq) <= lower_bound(counts, 2048) + 1


def test_ids_on_demand(documents):
    out = tokenised(documents, PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)


def test_odd_rows(odd_documents, no_documents):
    out = pack_documents(odd_documents, PATH).collect()
    assert sum(r.piece == 0 for r in out) == 12
    assert sorted(r.length for r in out if r.doc_id in (2, 3)) == [1, 1]
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert pack_documents(no_documents, PATH).collect() == []


def test_lengths_are_checked(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 9)], "doc_id int, length int"), 8)
