import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from lakeloom.llm import byte_bpe, queries


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    return byte_bpe.Encoder(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


ODD = [chr(c) for c in (0, 1, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x3000, 0xFEFF)] + list("abcdeXYZ'stll've 0123.,!?é日本ßñ́😀٣४Ⅷ½ªʰ")


def test_short_texts_have_the_ids_of_the_library(both):
    own, library = both
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        assert ids(own, text) == library.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_long_pre_tokens_have_the_ids_of_the_library(both):
    own, library = both
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 777, " " * 3000, "\n" * 700 + "x", "日本語" * 900, "é" * 257, "=" * 255, "=" * 256, "." * 4097]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcde", "etaoinshrdlu", "0123456789", "日本語中文é") for n in (255, 256, 257, 1000, 6000)]
    texts.append("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000)))
    for text in texts:
        assert ids(own, text) == library.encode_ordinary(text)


def test_both_ways_to_encode_agree(both, monkeypatch):
    """Pre-tokens that pass the queue as it is, whatever their length."""
    own, _ = both
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdefghi ülé") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)] + [b"\x00\x00", b"\xff", b"zq", b""]
    short = [own.encode_piece(p) for p in pieces]
    monkeypatch.setattr(byte_bpe, "LARGE", 0)
    assert [own.encode_piece(p) for p in pieces] == short


def test_the_least_rank_is_found_by_its_bits():
    rng, own, have = random.Random(4), byte_bpe.RankSet(50_000), set()
    for _ in range(3000):
        rank = rng.choice([rng.randrange(50_000), rng.randrange(300), 49_999])
        if rng.random() < 0.5:
            own.add(rank)
            have.add(rank)
        else:
            own.discard(rank)
            have.discard(rank)
        assert own.first() == min(have, default=-1)


def test_equal_ranks_go_from_the_left_and_stale_entries_are_skipped(tmp_path):
    """A made vocabulary in which joined pairs may have a lower rank than their parts."""
    rng = random.Random(5)
    for trial in range(30):
        tokens = {bytes([b]): b for b in range(256)}
        free = list(range(256, 400))
        rng.shuffle(free)
        for n in free:
            tokens.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))), n)
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items()))
        own = byte_bpe.Encoder(str(path))
        for _ in range(40):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            want, parts = [], [piece[k : k + 1] for k in range(len(piece))]
            while piece not in tokens:
                ranked = [(tokens[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in tokens]
                if not ranked:
                    break
                k = min(ranked)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            want = [tokens[p] for p in ([piece] if piece in tokens else parts)]
            assert own.encode_piece(piece) == want


def test_texts_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 50)
    monkeypatch.setattr(byte_bpe, "FEW", 3)
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    texts = ["", None, "Hello, world! It's 2024.", "été 日本 " * 30, "a" * 300_000, "x y " * 5000, "same", "same"]
    df = spark.createDataFrame([(k, t, b"old", "z") for k, t in enumerate(texts)], "doc_id long, text string, ids binary, decoded string").repartition(2)
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(df))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(byte_bpe.RANKS), special_tokens={})
    for r in out.collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode_texts(df.limit(0)).count() == 0


def test_every_document_has_the_librarys_digest(spark):
    sf = "/root/testdata/sf0.01"
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(byte_bpe.RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_byte_bpe(spark, sf).collect()}
    want = {}
    for k, t in texts.items():
        own = library.encode_ordinary(t)
        want[k] = (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want
