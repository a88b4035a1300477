import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from presswire.llm.pieces import PieceEncoder, decode_pieces, encode_pieces, unpacked
from presswire.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = ["Hello,  don't  stop　 日本語 <|endoftext|> x", "", " ", "   ", "a" * 500, " lead", "▁x", "▁ ▁", " ▁", "é😀 <s> <0x41>",
       "tab\tnl\n\n  x\r\n", "ab\0c", "x ﬁ Å Å ½ ㍿ ｶﾞ", "​­ x 　　 y 　", "ÀÉ ĲǄ ﷺ   ", "각 क़"]


def model(rule: str, squeeze: bool, prefix: bool, suffix: bool, bytes_: bool) -> bytes:
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    if rule != "identity":
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        m.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(made).normalizer_spec.precompiled_charsmap
        m.normalizer_spec.name = rule
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, prefix
    m.trainer_spec.treat_whitespace_as_suffix = suffix
    if not bytes_:
        m.trainer_spec.byte_fallback = False
        for p in m.pieces:
            if p.type == p.BYTE:
                p.type = p.UNUSED
    return m.SerializeToString()


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize(("prefix", "suffix", "bytes_"), [(True, False, True), (False, False, False), (True, True, True)])
def test_ids_and_spans_equal_the_library(rule, squeeze, prefix, suffix, bytes_):
    rng = random.Random(3)
    some = "ab  　　é éﬁ½㍿ｶﾞ​\n\t😀각각ﷺ▁Ǻ̧"
    texts = ODD + ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    tool = PieceEncoder(model=model(rule, squeeze, prefix, suffix, bytes_))
    ids, begins, ends, count = tool.encode(texts)
    edge = np.concatenate([[0], np.cumsum(count)]).tolist()
    for k, text in enumerate(texts):
        own = slice(edge[k], edge[k + 1])
        assert ids[own].tolist() == tool.own.encode(text, add_bos=True, add_eos=True), text
        want = [(p.begin, p.end) for p in tool.own.encode(text, return_type="proto").pieces]
        got = list(zip(begins[own].tolist(), ends[own].tolist(), strict=True))
        assert got == [(0, 0), *want, (len(text.encode()),) * 2], text


def digests(rows):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = []
    for doc_id, text in rows:
        ids = own.encode(text or "", add_bos=True, add_eos=True)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                    hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_the_library(spark, sf, docs):
    from presswire.llm.registry import QUERIES

    got = QUERIES["op12_offset_pieces"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == digests([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows_and_spans_cover_the_text(odd, odd_rows):
    got = decode_pieces(encode_pieces(odd)).collect()
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
                   for r in got), key=str) == digests([r[:2] for r in odd_rows])
    for r in got:
        begins, ends = unpacked(r.begins, "<u8"), unpacked(r.ends, "<u8")
        assert begins[1:] == ends[:-1] and len(begins) == r.n_tokens


def test_null_ids_and_empty_table(spark, empty):
    assert decode_pieces(spark.createDataFrame([(None,)], "ids binary")).first().decoded is None
    assert decode_pieces(encode_pieces(empty)).collect() == []


def test_models_with_user_symbols_are_refused():
    m = pb.ModelProto.FromString(model("identity", False, True, False, True))
    m.pieces[300].type = m.pieces[300].USER_DEFINED
    with pytest.raises(ValueError):
        PieceEncoder(model=m.SerializeToString())
