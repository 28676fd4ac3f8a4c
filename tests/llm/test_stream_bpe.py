import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import stream_bpe
from fleetlens.llm.stream_bpe import Decoder, Encoder, Merger, Merges, classes, decode, encode, encode_texts, lookahead, op11_stream_bpe, starts

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "don't stop, it's 12345 o'clock\n\n\n  now", "x" * 3000, "ab" * 700 + "\n\n" + "é漢字🙂" * 90, "words and 'll words've " * 200, " " * 900 + "end", "\t\n " * 300, "one'" * 300 + "re",
    "<|endoftext|> is<|endoftext|><|endoftext|> a <|endof text|>", " 's 's's'S\n's!'s''s 're'r", "a b c\x1cd\x85e ", "Ᲊ\U00010d41 \U00013460", "n" * 5000 + "1" * 500, "in the" * 400, "  x", "x  ", "\n", " \n ",
]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as f:
        return Merges(f.read())


def ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


def test_classes_are_the_librarys(known):
    split, kinds = known.pre_tokenizer.pre_tokenize_str, classes()
    random.seed(1)
    for c in [*range(0x3000), *range(0xA700, 0xA900), *range(0x10D00, 0x10F00), *random.sample(range(0x3000, 0xD800), 2000), *random.sample(range(0x10000, 0x110000), 3000)]:
        joins = [len(split(x + chr(c) + x)) == 1 for x in "!a1"]
        assert joins[:3] == [kinds[c] == k for k in range(3)], hex(c)


def test_splitter(known):
    random.seed(2)
    for _ in range(3000):
        parts = ["".join(random.choices(" \n's'trevlmd1é!x ", k=random.randint(1, 9))) for _ in range(3)]
        edges = np.cumsum([0, *map(len, parts)])
        expected = [int(e + a) for p, e in zip(parts, edges) for _, (a, _) in known.pre_tokenizer.pre_tokenize_str(p)]
        assert starts("".join(parts), edges).tolist() == expected, parts


def test_lookahead_is_enough(merges):
    assert lookahead([(b"a", b"b"), (b"c", b"a"), (b"dd", b"ca"), (b"e", b"f")]) == 4
    random.seed(3)
    words = [merges.tokens[i] for i in range(2000, 40_000, 7)]
    for _ in range(300):
        data = b"".join(random.choices(words, k=random.randint(50, 400))) if _ % 2 else bytes(random.choices(b"abcdest in", k=2500))
        m, got, at = Merger(merges), [], 0
        while at < len(data):
            step = random.randint(1, 700)
            got += m.feed(data[at : at + step])
            assert len(m.held) <= 2 * merges.window
            at += step
        assert got + m.close() == merges.merge(data)


@pytest.mark.parametrize("block", [1, 3, 17, 200])
def test_any_blocks_give_the_librarys_ids(known, merges, monkeypatch, block):
    monkeypatch.setattr(stream_bpe, "BLOCK", 64)
    for text in filter(None, TEXTS):
        e = Encoder(merges)
        out = [e.feed(text[i : i + block]) for i in range(0, len(text), block)]
        assert len(e.text) + len(e.past) < 64 + block + 40 and (e.open is None or len(e.open.held) <= merges.window)
        assert ids(b"".join([*out, e.close()])) == known.encode(text, add_special_tokens=False).ids, text[:40]


def test_groups_of_texts(known, merges):
    texts = [t or "" for t in TEXTS] * 2
    assert [ids(p) for p in encode_texts(merges, texts)] == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoder_on_any_ids(known, merges):
    random.seed(4)
    for _ in range(400):
        some = random.choices([*range(300), 50256, *range(1000, 50_000, 997)], k=30)
        d = Decoder(merges.tokens)
        assert "".join([*[d.feed(some[i : i + 4]) for i in range(0, 30, 4)], d.close()]) == known.decode(some, skip_special_tokens=False)
    assert Decoder(merges.tokens).feed([99_999_999]) == ""


def test_columns_and_the_query(spark, known, tmp_path):
    rows = [(i, t, "mine", 1.5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None), (None, TEXTS[7], "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, back double")
    got = decode(encode(df, PATH, decoded="back"), PATH, out="again").collect()
    assert len(got) == len(rows)
    for r in got:
        expected = known.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == expected and r.n_tokens == len(expected) and r.back == r.again == (r.text or "")
    assert encode(df.limit(0), PATH).columns == ["doc_id", "text", "back", "ids", "n_tokens"] and encode(df.limit(0), PATH).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op11_stream_bpe(spark, str(tmp_path)).collect():
        text = TEXTS[7 if r.doc_id is None else r.doc_id] or ""
        expected = known.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(expected) and r.ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_other_files_are_refused(merges):
    with open(PATH, "rb") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        Merges(json.dumps(spec).encode())
