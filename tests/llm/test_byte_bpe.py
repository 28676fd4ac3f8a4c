import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken

from fleetlens.llm.byte_bpe import decode, encode

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "don't stop, it's 12345 o'clock\n\n\n  now", "x" * 3000, "ab" * 700 + "\n\n" + "é漢字🙂" * 90,
    "words and 'll words've " * 200, " " * 900 + "end", "\t\n " * 300, "one'" * 300 + "re", "<|endoftext|> is text",
    ("The quick brown fox; 1,234.50 jumps!  " * 60) + "z" * 700 + (" tail 'tis" * 40),
]


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (200, 64), (64, 24)])
def test_same_ids_and_round_trip(spark, known, chunk, overlap):
    rows = [(i, t, "ids", 1.5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again", None), (None, TEXTS[7], None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, n_tokens double")
    got = decode(encode(df, PATH, P.PATTERN, chunk=chunk, overlap=overlap, decoded="back"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[7]) or ""
        ids = known.encode_ordinary(text)
        assert struct.unpack(f"<{r.n_tokens}I", r.ids) == tuple(ids), (r.doc_id, text[:40])
        assert bytes(r.decoded) == bytes(r.back) == text.encode()


def test_empty_table_and_the_query(spark, known, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, PATH, P.PATTERN).columns == ["doc_id", "ids", "n_tokens"]
    assert encode(empty, PATH, P.PATTERN).count() == 0
    from fleetlens.llm.byte_bpe import op2_byte_bpe

    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_byte_bpe(spark, str(tmp_path)).collect():
        ids = known.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
