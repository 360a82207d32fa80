import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing


def test_encoder_is_the_tokenizer():
    path = packing.default_tokenizer()
    encode, plain = packing.word_encoder(path), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("'stremvld _²½İΣς日é́ \x0b")), max_size=60))
    def same(text):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    same()


def test_round_trip(spark, make_documents, odd_rows):
    plain = Tokenizer.from_file(packing.default_tokenizer())
    parts = packing.pieces(spark, make_documents(odd_rows), capacity=64, keep_ids=True)
    out = packing.pack(spark, parts, capacity=64, group_pieces=100).collect()
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in odd_rows)
    docs, places = defaultdict(list), defaultdict(list)
    for r in sorted(out, key=lambda r: r.piece):
        assert r.length == len(r.ids) <= 64 and r.start == 64 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs[str(r.doc_id)].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    # texts of one doc_id can't be told apart by their pieces: compare all ids of each doc_id
    got = {i: sorted(x for r in rows for x in r.ids) for i, rows in docs.items()}
    flat = defaultdict(list)
    for i, ids in want:
        flat[i] += ids
    assert got == {i: sorted(x) for i, x in flat.items()}
    for i, ids in want:  # documents of their own: the ids in their order
        if sum(str(k) == i for k, _, _ in odd_rows) == 1:
            assert [x for r in docs[i] for x in r.ids] == ids
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64


def test_few_sequences():
    rng = np.random.default_rng(5)
    sizes = np.minimum(4096, rng.lognormal(6.7, 1.0, 20_000).astype(np.int64) + 1)
    where, offset = packing.sum_of_squares(sizes, 4096)
    assert where.max() + 1 <= 1.01 * -(-sizes.sum() // 4096)
    fill = np.bincount(where, sizes)
    assert fill.max() <= 4096 and (offset + sizes).max() <= 4096


def test_sum_of_squares_rule():
    # one open gap of 4 and two of 6: a 4 goes where the sum of squares is least (the two 6s lose one)
    where, _ = packing.sum_of_squares(np.array([6, 4, 4]), 10)
    assert where.tolist() == [0, 0, 1]


def test_empty(spark, make_documents):
    parts = packing.pieces(spark, make_documents([]))
    assert packing.pack(spark, parts).count() == 0
