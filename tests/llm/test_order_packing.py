import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lacunae.llm.order_packing import SentenceEncoder, Shift, best_cuts, cut_places, pack_in_order, places_of
from lacunae.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
ENCODER, WHOLE = SentenceEncoder(PATH), SentenceEncoder(PATH, by_chunk=False)
LIBRARY = Tokenizer.from_file(PATH)
PENALTIES = (32, 256)


def ids_of(text):
    found = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 2], "<u4")


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def cheapest(places, penalties, capacity):
    """Every earlier place tried for every place."""
    best = [(0, 0)] + [None] * (len(places) - 1)
    for i in range(1, len(places)):
        best[i] = min((best[j][0] + padding(places[i] - places[j], capacity) + penalties[i], best[j][1] + 1)
                      for j in range(i) if places[i] - places[j] <= capacity)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([0, 0, 3, 9])), min_size=1, max_size=40),
       st.sampled_from([20, 21, 32, 50]))
def test_least_cost(steps, capacity):
    places = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalties = np.array([0, *[p for _, p in steps]])
    cuts = best_cuts(places, penalties, capacity)
    windows = np.diff(places[[0, *cuts]])
    assert cuts[-1] == len(places) - 1 and windows.max() <= capacity
    cost = sum(padding(int(w), capacity) for w in windows) + int(penalties[cuts].sum())
    assert (cost, len(cuts)) == cheapest(places.tolist(), penalties.tolist(), capacity)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.binary(min_size=1, max_size=60))
def test_checksum_of_the_rest(a, b):
    left = np.array([zlib.crc32(a)], np.uint32)
    both = np.array([zlib.crc32(a + b)], np.uint32)
    assert (both ^ Shift()(left, np.array([len(b)])))[0] == zlib.crc32(b)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aB éÉ́\n\t \x1c\x85\xa0　,.!?'s12世。<|>Σς\"ﬁ"), max_size=30))
def test_chunks_encode_as_whole_texts(text):
    text += "<|endoftext|>" if len(text) % 3 == 0 else " it's O.K. it'S 3.14"
    texts = ["One.", text, "", text + " two", "ǅ x² ﬁn İs. İ"]
    found, whole = ENCODER(texts), WHOLE(texts)
    assert ENCODER.by_chunk and not WHOLE.by_chunk
    assert found.ids.tolist() == whole.ids.tolist() == [i for t in texts for i in ids_of(t)[:-1]]
    assert found.tokens.tolist() == whole.tokens.tolist()
    assert (found.end <= found.tokens[found.text]).all() and (np.diff(found.text) >= 0).all()


def test_sentence_ends():
    text = 'One two. Three "four?" Five\nsix... 3.14 seven! eight'
    parts = ["One two.", 'Three "four?"', "Five", "six...", "3.14 seven!"]
    sizes = np.cumsum([len(ids_of(p)) - 1 for p in parts]).tolist()
    for encode in (ENCODER, WHOLE):
        found = encode(["", text])
        assert sorted(set(found.end.tolist())) == sizes and set(found.text.tolist()) == {1}


def test_long_sentences_can_be_cut():
    found = ENCODER(["a " * 25 + "b. c", "", "d " * 10])
    text, place, inside = places_of(found, 10)
    n = found.tokens.tolist()
    assert [*zip(text.tolist(), place.tolist(), inside.tolist())] == [
        (0, 10, 1), (0, 20, 1), (0, n[0] - 1, 0), (0, n[0] + 1, 0), (1, 1, 0), (2, 11, 0)]


def check(out, texts, capacity):
    """Exact round trip. `texts` maps ids to texts; returns windows as lists of pieces."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, rows in by_doc.items():
        ids, at = ids_of(texts[d]), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(ids[r.start:at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_seq


def test_documents_round_trip_in_order(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    windows = check(pack_in_order(documents, PATH).collect(), texts, 4096)
    order = [(r.doc_id, r.start) for k in sorted(windows) for r in windows[k]]
    assert order == sorted(order)
    sizes = [sum(r.length for r in rows) for rows in windows.values()]
    lost = sum(padding(n, 4096) for n in sizes)
    assert lost <= 0.01 * sum(sizes) + 4096


def test_the_plan_is_the_cheapest(documents):
    """The pieces of one run cost what brute force over all places finds."""
    found = cut_places(documents.orderBy("doc_id").limit(25).coalesce(1).sortWithinPartitions("doc_id"), PATH, 2, 64,
                       "doc_id", "text").collect()
    places, penalties, base = [0], [0], 0
    for r in found:
        for end, inside in zip(r.ends, r.inside, strict=True):
            places.append(base + end)
            penalties.append(PENALTIES[inside])
        penalties[-1] = 0
        base += r.doc_tokens
    out = pack_in_order(documents.orderBy("doc_id").limit(25), PATH, 512, longest=64).collect()
    windows = defaultdict(int)
    for r in out:
        windows[r.sequence_id] += r.length
    ends = np.cumsum([windows[k] for k in sorted(windows)]).tolist()
    fee = dict(zip(places, penalties, strict=True))
    cost = sum(padding(n, 512) for n in windows.values()) + sum(fee[e] for e in ends)
    assert cost == cheapest(places, penalties, 512)[0]


def test_blocks_and_runs(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    out = pack_in_order(documents, PATH, 256, longest=100, block_tokens=20_000, run_places=300).collect()
    windows = check(out, texts, 256)
    assert len({k >> 40 for k in windows}) > 3
    order = [(r.doc_id, r.start) for k in sorted(windows) for r in windows[k]]
    assert order == sorted(order)


def test_odd_rows(odd_documents, no_documents):
    out = pack_in_order(odd_documents, PATH, 64, longest=16).collect()
    assert sum(r.start == 0 for r in out) == 12
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    by_doc = defaultdict(int)
    for r in out:
        by_doc[r.doc_id] += r.length
    assert by_doc[2] == by_doc[3] == by_doc[4] == 1
    assert by_doc[5] == len(ids_of("x" * 50_000)) and by_doc[6] == 2 * len(ids_of("é ▁ b  c "))
    assert pack_in_order(no_documents, PATH).collect() == []
    with pytest.raises(ValueError):
        pack_in_order(no_documents, PATH, 64, longest=65)


def test_one_id_fills_the_table(spark):
    """A hot id is cut by the number in the table, so it spans blocks."""
    df = spark.range(4000, numPartitions=4).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("one two three. four five six!").alias("text"))
    out = pack_in_order(df, PATH, 64, longest=32, block_tokens=5000).collect()
    assert sum(r.length for r in out) == 4000 * len(ids_of("one two three. four five six!"))
    assert len({r.sequence_id >> 40 for r in out}) > 4
