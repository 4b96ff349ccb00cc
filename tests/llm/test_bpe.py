import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken

from termweave.llm import bpe
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.merges.ranks, special_tokens={})


def test_ids_equal_the_library(spark):
    own = bpe.merge_encoder(PATH, P.PATTERN)
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n", "a" * 3000, "ab" * 2000, "-" * 999, "😀😀 ñ", "it's  fine\x01", "a\x85b\x1cc　d"]
    texts += ["".join(rng.choice("ab'st 1.\n é\tΣ!the") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x370, 0xD7FF)])) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    flat, ends = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        ids = flat[ends[i] : ends[i + 1]]
        assert ids.tolist() == library(own).encode_ordinary(t or ""), repr(t)[:60]
        assert own.merges.decode(ids) == (t or "").encode()


def test_merges_of_lower_rank_go_first(tmp_path):
    """A vocabulary in which a merge opens one of lower rank: the library's order must hold."""
    import base64

    names = [bytes([b]) for b in range(256)] + [b"xab", b"ab", b"abab", b"bx", b"xa"]
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"".join(base64.b64encode(n) + b" %d\n" % i for i, n in enumerate(names)))
    own = bpe.MergeEncoder(str(file), P.PATTERN)
    assert own.merges.alone.any()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abx") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    flat, ends = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == library(own).encode_ordinary(t), t


def test_query_and_edges(spark, docs):
    own = library(bpe.merge_encoder(PATH, P.PATTERN))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    got = bpe.encode_decode(docs([(None, None), (1, "ab"), (1, "ab")]), PATH, P.PATTERN, keep_ids=True).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == [(0, []), (1, own.encode_ordinary("ab")), (1, own.encode_ordinary("ab"))]
    assert bpe.encode_decode(docs([(1, "a")]).limit(0), PATH, P.PATTERN).count() == 0
