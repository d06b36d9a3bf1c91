import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from krigmesh.llm.packing import BestFit, cut, pack, pack_documents
from krigmesh.llm.token_counts import PairMerger, token_counts
from krigmesh.llm.token_store import NULL_KEY, Shard, perfect_hash, write_store
from krigmesh.llm.tokens import PieceEncoder, tokenizer_path

ODD = [
    "", " ", "  a  b ", " lead", "trail ", "tr  ", "a\n b\n\n c\t d", "don't it's  we'll<|endoftext|> x", "é́ ñ ümlaut, 漢字 １２3 ½", "a b  c", "x" * 3000,
    "!!! ???'s 'll", "A\r\nB", "\x1c x\x1d", "İstanbul ΣΑΣ ς ß ﬁ", "<|startoftext|>hi<|endoftext|>there <|endoftext|>", "KÅ é ", "\0 a\0", "foo," * 500,
]


def rows(spark, texts, keys=None):
    return spark.createDataFrame([(i if keys is None else keys[i], t, "x", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, piece string, start string")


def test_ids_equal_the_library():
    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), cache_pieces=3)
    for _ in range(2):
        for t in ODD:
            assert enc.payload(t) == enc.whole(t), t


def test_counts_equal_the_library(spark, sf):
    lib, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), PairMerger(tokenizer_path("word_bpe_49k.json"), cache_words=5)
    for t in ODD:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)


def test_counts_of_nulls_repeats_and_empty_tables(spark):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(rows(spark, [None, "", "ab", "ab"], [1, 2, 3, 3])).collect())
    assert got[:2] == [(1, 0, 0), (2, 0, 0)] and len(got) == 4 and got[2] == got[3]
    assert token_counts(rows(spark, [])).count() == 0


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 1000):
        keys = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, n)]
        assert sorted(perfect_hash(keys)[1]) == list(range(n))


def test_store_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    store = write_store(spark, docs, shards=5)
    got = {r.doc_id: r for r in store.digests(docs).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count()
    shard = Shard(store.root, 0)
    assert shard.find(-12345) is None and shard.keys == len(shard.table)


def test_store_of_null_and_repeated_keys(spark):
    store = write_store(spark, rows(spark, ["b", None, "a", "a", "c"], [7, None, 7, 7, -3]), shards=3)
    got = [(r.doc_id, r.n_tokens) for r in store.digests(rows(spark, [""] * 4, [7, None, -3, 99])).orderBy("start").collect()]
    assert got == [(None, 1), (-3, 2), (7, 2), (7, 2), (7, 2)]
    assert Shard(store.root, 0).find(NULL_KEY) is not None
    assert write_store(spark, rows(spark, [])).digests(rows(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 2048, 5000])
def test_only_the_first_piece_is_short(n):
    parts = cut(n, 1024)
    assert sum(x for _, x in parts) == n and all(x == 1024 for _, x in parts[1:]) and [s for s, _ in parts] == list(np.cumsum([0, *(x for _, x in parts[:-1])]))


def test_best_fit_against_a_list_of_bins():
    rng = np.random.default_rng(3)
    for most in (1, 3, 50):
        fit, bins, made = BestFit(64, most), {}, 0  # bin -> (free, time of its last piece)
        for now, x in enumerate(rng.integers(1, 64, 400).tolist()):
            fits = {k: v for k, v in bins.items() if v[0] >= x}
            if fits:  # the fullest, of equals the last used
                want = min(fits, key=lambda k: (fits[k][0], -fits[k][1]))
            else:
                if len(bins) >= most:
                    del bins[min(bins, key=lambda k: (bins[k][0], -bins[k][1]))]
                want, made = made, made + 1
                bins[want] = (64, now)
            assert fit.add(x) == (want, 64 - bins[want][0])
            bins[want] = (bins[want][0] - x, now)
            if not bins[want][0]:
                del bins[want]
            assert len(bins) <= most


def test_packing_is_whole_gapless_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(rows(spark, [None, "", "x"], [10**6, 10**6 + 1, 10**6 + 1]).selectExpr("doc_id", "text", "'' lang", "'' source", "0L n_chars"))
    got = pack_documents(spark, docs).toPandas()
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = [len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    assert got["length"].sum() == sum(want) and got["length"].between(1, 1024).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-sum(want) // 1024) + 2
    assert pack_documents(spark, docs.limit(0)).count() == 0


def test_a_bound_that_binds_keeps_packing_tight(spark):
    rng = np.random.default_rng(7)
    lengths = np.minimum(1023, np.maximum(1, rng.lognormal(5.8, 0.9, 6000).astype(int))).tolist()
    pieces = spark.createDataFrame([(i // 2, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    for bound, wave in ((448, 1024), (3, 16)):
        got = pack(spark, pieces, open_bins=bound, wave=wave).toPandas()
        assert len(got) == len(lengths) and sorted(got["ids_crc32"]) == list(range(len(lengths)))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
        if bound > 3:
            assert got["sequence_id"].nunique() <= 1.005 * sum(lengths) / 1024 + 1


def test_pieces_of_very_long_texts_and_repeated_rows(spark):
    long_ = " ".join(f"word{i % 977}" for i in range(120_000))
    docs = rows(spark, [long_, long_, "x", "x", None], [1, 1, 2, 2, None])
    got = pack_documents(spark, docs).toPandas()
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [*lib.encode(long_, add_special_tokens=False).ids, 2]
    own = got[got.doc_id == 1].sort_values(["piece", "sequence_id"])
    assert own["piece"].tolist() == sorted([*range(-(-len(ids) // 1024))] * 2)
    for _, r in own.iterrows():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[int(r["start"]) : int(r["start"] + r["length"])], "<u4").tobytes())
    assert len(got[got.doc_id == 2]) == 2 and got["doc_id"].isna().sum() == 1
