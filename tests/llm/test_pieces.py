"""Piece ids, counts, spans and decoded texts against the library; normalisation against the library's own maps."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tests.llm.helpers import clashing, table
from touchline.llm import pieces, token_counts
from touchline.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")
RND = random.Random(2)
TEXTS = ["", " ", "  a  b", "▁x", "a▁▁b\n\n\tc", "日本語のテキスト", "😀😀 é́", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaa" * 50, "\x00a", "x" * 5000,
         "abab" * 700, *["".join(RND.choice("abeinrt .\n▁ étion") for _ in range(RND.randint(0, 300))) for _ in range(150)],
         *["".join(chr(RND.choice([RND.randint(32, 126), RND.randint(160, 1500), RND.randint(0x3000, 0x9000), RND.randint(0x1F300, 0x1F6FF)]))
                   for _ in range(RND.randint(0, 100))) for _ in range(100)]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_merges_are_the_librarys(library):
    model, normal = token_counts.merger(PATH), pieces.normaliser(PATH)
    for t in TEXTS:
        parts = model.pretokens(normal.text(t))
        ids = [i for x in model.encode(parts) for i in x.tolist()]
        assert ids == library.encode(t), t
        assert sum(model.count(parts)) == len(ids)


def test_whole_text_as_one_token(library):
    """Merging does not rely on cutting at spaces."""
    model, normal = token_counts.merger(PATH), pieces.normaliser(PATH)
    for t in TEXTS[:60]:
        if t:
            assert model.encode([normal.text(t)])[0].tolist() == library.encode(t)


def test_queries(spark, tmp_path, library):
    texts = [*TEXTS[:40], None, "word " * 3000, (1, " "), (None, "x"), (None, None)]
    docs = clashing(table(spark, texts))
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    plain = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = sorted(((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in plain), key=key)
    got = QUERIES["op9_count_tokens"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=key) == want
    want = []
    for i, t in plain:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = QUERIES["op6_encode_pieces"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=key) == sorted(want, key=key)


def test_spans_cover_the_text(spark, library):
    docs = table(spark, TEXTS[:60])
    for r in pieces.encode(docs, "doc_id", "text", PATH, ends=False).collect():
        data = TEXTS[r.doc_id].encode()
        ids, spans = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.spans, np.uint32).reshape(-1, 2)
        assert len(ids) == len(spans)
        if not len(ids):
            continue
        assert spans[0, 0] == 0 and spans[-1, 1] == len(data)
        assert (spans[1:, 0] == spans[:-1, 1]).all()
        for i, (a, b) in zip(ids.tolist(), spans.tolist(), strict=True):
            piece = library.id_to_piece(i)
            if not library.is_byte(i) and "▁" not in piece:
                assert data[a:b].decode() == piece


def test_both_ways_to_places_agree():
    model, normal, sizes = token_counts.merger(PATH), pieces.normaliser(PATH), pieces._byte_sizes(PATH)
    for t in TEXTS:
        ids = np.array([i for x in model.encode(model.pretokens(normal.text(t))) for i in x], np.int64)
        edges = np.cumsum([0, *sizes[0][ids]])
        assert (pieces._places(normal, sizes, t, ids) == normal.aligned(t)[1][edges]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_with_compiled_maps(rule):
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True,
                                                    escape_whitespaces=True)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.Normaliser(model.normalizer_spec)
    samples = [*TEXTS, "ﬁ ① Ａ　x", " lead", "trail  ", "ｶﾞ ㍿ Å", "é é", "　 　", "Straße ŉ", "㌔㌧ ½"]
    for t in samples:
        if "\0" in t:
            continue
        want, place = library.Normalize(t, with_offsets=True)
        got, source = own.aligned(t)
        assert got == want, (rule, t)
        ends = np.cumsum([0, *[len(c.encode()) for c in got]])
        points = np.cumsum([0, *[len(c.encode()) for c in t]])
        assert [int(np.searchsorted(points, source[e])) for e in ends] == list(place), (rule, t)


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(table(spark, []), "doc_id", "text", PATH), PATH).count() == 0
    assert token_counts.count_tokens(table(spark, []), "doc_id", "text", PATH).count() == 0
