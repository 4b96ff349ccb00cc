import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from termweave.llm import packing, token_files, tokens
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "\n", "a", " a", "a ", "a\n", "a\n\nb", "a  b", "it's  fine", "it's\n's x", "<|endoftext|> a", "b<|ENDOFTEXT|>", "x <|startoftext|>y\nz", "<|endoftext|>" * 3, "<|endo ftext|>", "a b   c", "É\x1cb",
    "x\x01y z.", "日本語 テキスト", "a\tb\n\tc", "Σας ΣΑΣ", "a ́b", "x.,y a,.b. c.,", "w" * 40_000,
]


def library(name):
    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_ids_of_whole_texts(name, monkeypatch):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(["<|endoftext|>", "<|", "a", " ", ".", "|>", "é", "\n"]) for _ in range(9)) for _ in range(300)]
    texts += ["".join(rng.choice("ab'st 1.,\n éS\t!\x85　") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    t, own = library(name), tokens.Encoder(P.path(name))
    for bound in (tokens.CACHE_WORDS, 50):
        monkeypatch.setattr(tokens, "CACHE_WORDS", bound)
        flat, ends = own.encode(pa.array(texts))
        for i, x in enumerate(texts):
            assert flat[ends[i] : ends[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:60]


def test_file_round_trip_and_random_access():
    import io

    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 60_000, int(n))) for i, n in enumerate(rng.integers(0, 9000, 40))]
    for wide in (False, True):
        data = token_files.encode_bytes(docs, wide)
        back = list(token_files.TokenReader(io.BytesIO(data), len(data)).documents())
        at = 0
        for (i, ids), (j, start, got) in zip(docs, back, strict=True):
            assert i == j and start == at and (ids == got).all()
            at += len(ids)
        reader = token_files.TokenReader(io.BytesIO(data), len(data))
        asked = []
        frame = reader.frame
        reader.frame = lambda n: asked.append(n) or frame(n)
        some = list(reader.documents({7, 33}))
        assert [x[0] for x in some] == [7, 33] and len(asked) <= 2 < len(reader.entries)
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert raw == np.concatenate([d[1] for d in docs]).astype("<u4" if wide else "<u2").tobytes()
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises(Exception):
        list(token_files.TokenReader(io.BytesIO(bytes(damaged)), len(damaged)).documents())
    empty = token_files.encode_bytes([])
    assert list(token_files.TokenReader(io.BytesIO(empty), len(empty)).documents()) == []


def test_token_file_query(spark):
    t = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, SF).collect()}
    at = 0
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(docs)
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_file_edges(spark, docs):
    df = docs([(3, "b c"), (None, None), (1, ""), (3, "a b"), (3, "b c")])
    manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_files.read_token_files(manifest).collect())
    assert got == [(0, 0, 1), (1, 1, 1), (3, 2, 3), (3, 5, 3), (3, 8, 3)]
    some = token_files.read_token_files(manifest, [1]).collect()
    assert [(r.doc_id, r.start) for r in some] == [(1, 1)]
    none = token_files.write_token_files(df.limit(0), P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(none).count() == 0


def test_differencing_is_a_partition_with_small_spread():
    rng = random.Random(8)
    sizes = [rng.randint(1, 1024) for _ in range(300)]
    parts = packing.differencing(sizes, 40)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 150
    packed = packing.windows(sizes)
    assert sorted(i for p in packed for i in p) == list(range(300))
    assert max(sum(sizes[i] for i in p) for p in packed) <= 4096
    assert packing.windows([4096] * 3) == [[0], [1], [2]] or len(packing.windows([4096] * 3)) == 3
    assert packing.windows([]) == []


def check_pieces(rows, texts):
    t = library("word_bpe_49k.json")
    whole = {}
    for i, text in texts.items():
        whole[i] = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    by_doc, by_window = {}, {}
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in whole.items():
        assert [x for a, n in sorted(by_doc[i]) for x in range(a, a + n)] == list(range(len(ids)))
    for parts in by_window.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    return sum(len(x) for x in whole.values()) / (4096 * len(by_window))


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(QUERIES["op9_packing"](spark, SF).collect(), texts) > 0.95


def test_packing_edges(spark, docs, prose):
    texts = {1: None, 2: "", 3: prose(1, 9000), 4: "x"}
    rows = packing.pack(docs(list(texts.items())), P.path("word_bpe_49k.json")).collect()
    check_pieces(rows, texts)
    twice = packing.pack(docs([(None, "a b"), (None, "a b"), (7, "c")]), P.path("word_bpe_49k.json")).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert packing.pack(docs([(1, "a")]).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_repeated_rows_are_spread_over_groups(spark):
    rows = spark.createDataFrame([(None, None)] * 600, "doc_id long, text string")
    got = packing.pack(rows, P.path("word_bpe_49k.json"), capacity=4, rest=4, group_windows=2).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 20] = groups.get(r.sequence_id >> 20, 0) + 1
    assert sum(groups.values()) == 600 and len(groups) > 30 and max(groups.values()) < 60


def test_one_id_for_many_rows_is_spread_over_files(spark, docs):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same text")] * 300 + [(-(1 << 63), "x"), (8, None)]
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions stay, as large ones do
    before = spark.conf.get(joined)
    spark.conf.set(joined, "false")
    manifest = token_files.write_token_files(docs(rows).repartition(6), P.path("byte_bpe_50k.json"))
    spark.conf.set(joined, before)
    assert manifest.count() > 2 and manifest.agg({"n_docs": "max"}).first()[0] < 400
    back = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert len(back) == len(rows)
    ids = [r.doc_id for r in back]
    assert ids == [None] * 300 + [-(1 << 63)] + [7] * 300 + [8]
    assert [r.start for r in back] == list(np.cumsum([0, *(r.n_tokens for r in back)])[:-1])
