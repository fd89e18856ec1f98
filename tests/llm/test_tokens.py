"""Packing, bit packing and token counts against the library's encoding of whole texts."""

import ctypes
import pathlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import bitpack, bpe, packing, token_counts
from siftline.llm.shared import blocks

from .conftest import SF

PATH = bpe.tokenizer_path("word_bpe_49k.json")
HARD = ["", " ", "\n\n", "á ́b é  x<|endoftext|>y it's DON'T 12 a1b2 d\x0b e\x85f \xa0 ​ ß ΑΣ İ", "x" * 3000,
        "a\x0bb\x0cc d\x1ce", "Foo., bar... O'Neil's 5.,6 é., x́. <|ENDOFTEXT|> ", "<|", "日本語 テキスト\tпривет"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False)


def same(library, encoder, texts):
    ids, offsets = encoder.encode(texts)
    start, end, tokens, chars = encoder.encode_spans(texts)
    for i, text in enumerate(texts.to_pylist()):
        want = whole(library, text)
        assert ids[offsets[i]:offsets[i + 1]].tolist() == want.ids
        own = slice(tokens[i], tokens[i + 1])
        assert list(zip((start[own] - chars[i]).tolist(), (end[own] - chars[i]).tolist())) == [tuple(o) for o in want.offsets]


def test_words_encode_like_whole_texts(library, docs):
    texts = pa.array([r["text"] for r in docs.select("text").collect()])
    encoder = bpe.Encoder(PATH, memory=5000)
    same(library, encoder, texts)
    for text in HARD:
        same(library, encoder, pa.array([text, None]))
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for block in blocks([batch.slice(3)], "text", 50_000):
        same(library, encoder, block.column("text"))


def test_remembered_words_are_bounded(library):
    """A few long words fill what a worker remembers as many short ones do."""
    assert bpe.MEMORY <= 400_000
    encoder = bpe.Encoder(PATH)
    for k in range(40):
        texts = pa.array([f"{k} {'ab' * 150_000}{k} the end"])
        same(library, encoder, texts)
        assert encoder.known[False].words.nbytes + encoder.known[True].words.nbytes <= 3 * bpe.MEMORY_BYTES


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé́.,' \n<|>9ßẞ中\x85"), max_size=30), max_size=4))
def test_any_text_encodes_alike(texts):
    same(Tokenizer.from_file(PATH), bpe.Encoder(PATH), pa.array(texts, pa.string()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_join_over_blanks(docs, name):
    """Their texts are encoded as a whole, with the library's own result."""
    path = bpe.tokenizer_path(name)
    own = Tokenizer.from_file(path)
    encoder = bpe.Encoder(path)
    assert not encoder.by_words and bpe.Encoder(PATH).by_words
    same(own, encoder, pa.array([r["text"][:2000] for r in docs.limit(20).collect()] + ["", None, *HARD[2:]], pa.string()))


@given(st.lists(st.integers(1, 20_000), max_size=20), st.sampled_from([1, 2, 64, 4096]))
@settings(deadline=None)
def test_binary_pieces(sizes, longest):
    document, start, length = packing.binary_pieces(np.array(sizes, np.int64), longest)
    for i, size in enumerate(sizes):
        own = length[document == i]
        assert own.sum() == size and (start[document == i] == np.cumsum(own) - own).all()
        rest = own[own < longest]
        assert ((own & (own - 1)) == 0).all() and len(set(rest.tolist())) == len(rest) and (np.diff(own) <= 0).all()


def check_pieces(library, docs, pieces):
    rows = pieces.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    wanted = sorted((repr(r["doc_id"]), tuple(whole(library, r["text"]).ids + [2])) for r in docs.select("doc_id", "text").collect())
    got, open_ = [], {}
    for r in sorted(rows, key=lambda r: r["sequence_id"]):  # a task numbers its pieces in their order
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 4096 and r["length"] & (r["length"] - 1) == 0
        if r["start"] == 0:
            open_ = []
        open_ += ids
        if len(open_) == r["doc_tokens"]:
            got.append((repr(r["doc_id"]), tuple(open_)))
    assert sorted(got) == wanted


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another allocator")
def test_blocks_give_free_memory_back():
    """A worker does not keep for one task what it needed for the one before."""
    def held() -> int:
        return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * 4096

    many = [np.ones(8000) for _ in range(2500)]  # 160 MB in pieces that the allocator keeps
    full, many = held(), many[::50]
    assert len(list(blocks([pa.RecordBatch.from_pydict({"text": ["a", None, "b c"]})], "text"))) == 1
    assert full - held() > 100 << 20
    assert len(many) == 50


def test_packing(library, docs, edge_docs, no_docs):
    check_pieces(library, docs, packing.pack_documents(docs, PATH))
    check_pieces(library, edge_docs, packing.pack_documents(edge_docs, PATH))
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_packing_query(spark, docs):
    rows = packing.op3_packing(spark, SF).collect()
    ids = {r["doc_id"]: np.array(Tokenizer.from_file(PATH).encode(r["text"], add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


def test_buckets(spark, docs, tmp_path):
    packing.write_buckets(packing.pack_documents(docs.limit(5), PATH), str(tmp_path / "b"))
    assert all(len(r["ids"]) == 4 * r["length"] for r in spark.read.parquet(str(tmp_path / "b")).collect())


@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2 ** 32))
@settings(deadline=None)
def test_bits(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, n) == ids).all() and len(bitpack.pack(ids, bits)) == -(-n * bits // 8)


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 1 << 13, k).astype("<u4") for k in (0, 1, 5000, 0, 77, 4096, 3)]
    path = tmp_path / "s"
    path.write_bytes(bitpack.shard_bytes([x.tobytes() for x in own], 13, block=64, doc_ids=[5, None, 7, -1, 9, 0, 11], part=3, shard=2))
    with path.open("rb") as file:
        shard = bitpack.Shard(file)
        assert shard.doc_ids.to_pylist() == [5, None, 7, -1, 9, 0, 11] and (shard.part, shard.shard) == (3, 2)
        for i in (5, 2, 0, 6, 3, 1, 4):
            assert (shard.document(i) == own[i]).all()
        assert (shard.read(4990, 5100) == np.concatenate(own)[4990:5100]).all()
    with pytest.raises(ValueError):
        bitpack.shard_bytes([np.array([8], "<u4").tobytes()], 3)


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_bit_packing_round_trip(request, spark, library, which, tmp_path):
    docs = request.getfixturevalue(which)
    manifest = bitpack.write_shards(docs, f"file://{tmp_path}/x", PATH, shard_ids=2000)
    # the files alone tell ids and places: a list of their names in any order is enough
    named = spark.createDataFrame([(r["path"],) for r in manifest.select("path").collect()][::-1], "path string")
    rows = sorted(bitpack.read_documents(named).collect(), key=lambda r: r["start"])
    source = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [r[0] for r in source]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in rows) == sorted(
        (repr(i), np.array(whole(library, t).ids + [1], "<u4").tobytes()) for i, t in source)


def test_bit_packing_query(spark, library, docs):
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array(whole(library, r["text"]).ids + [1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, bitpack.op7_bit_packing(spark, SF).collect())) == want


def brute_sections(start, end, sections, rule):
    out = []
    for a, b in zip(start, end):
        shared = [(min(b, e) - max(a, s), k) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s)]
        out.append(-1 if not shared else max(shared, key=lambda x: (x[0], -x[1]))[1] if rule == "largest" else shared[0 if rule == "first" else -1][1])
    return out


@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), max_size=8), st.sampled_from(token_counts.RULES))
@settings(deadline=None)
def test_attribution(tokens, gaps, rule):
    end = np.cumsum(tokens).astype(np.int64)
    start = end - np.array(tokens, np.int64)
    sections, at = [], 0
    for gap, size in gaps:
        sections.append((at + gap, at + gap + size))
        at += gap + size
    got = token_counts.attribute(start, end, np.array(sections, np.int64).reshape(-1, 2), rule)
    assert got.tolist() == brute_sections(start.tolist(), end.tolist(), sections, rule)


def test_line_counts(library, docs, edge_docs, no_docs):
    for source in (docs, edge_docs):
        want = []
        for r in source.select("doc_id", "text").collect():
            offsets, at = whole(library, r["text"]).offsets, 0
            for k, line in enumerate((r["text"] or "").split("\n")):
                size = len(line) + 1
                inside = sum(at <= a < at + size for a, _ in offsets)
                if at < len(r["text"] or ""):
                    want.append((repr(r["doc_id"]), k, at, min(at + size, len(r["text"])), inside, len(offsets)))
                at += size
        got = token_counts.section_token_counts(source, PATH).collect()
        assert sorted((repr(r[0]), *r[1:]) for r in map(tuple, got)) == sorted(want)
    assert token_counts.section_token_counts(no_docs, PATH).count() == 0


@pytest.mark.parametrize("rule, width", [("largest", 7), ("first", 3), ("last", 7), ("largest", 500)])
def test_fields_cut_words(spark, library, docs, edge_docs, rule, width):
    """Fields whose edges lie inside words and tokens; some tokens cross them."""
    for source in (docs.limit(60), edge_docs):
        want, crossing = [], 0
        for r in source.select("doc_id", "text").collect():
            text = r["text"] or ""
            offsets = whole(library, text).offsets
            fields = [(a, min(a + width, len(text))) for a in range(0, len(text), width)]
            crossing += sum(a // width != (b - 1) // width for a, b in offsets)
            at = np.bincount(brute_attribution(offsets, width, rule), minlength=len(fields)) if offsets else np.zeros(len(fields), int)
            want += [(repr(r["doc_id"]), k, a, b, int(at[k]), len(offsets)) for k, (a, b) in enumerate(fields)]
        got = token_counts.section_token_counts(source, PATH, rule, width).collect()
        assert sorted((repr(r[0]), *r[1:]) for r in map(tuple, got)) == sorted(want)
        assert crossing or width == 500


def brute_attribution(offsets, width, rule):
    out = []
    for a, b in offsets:
        shared = {}
        for c in range(a, b):
            shared[c // width] = shared.get(c // width, 0) + 1
        out.append({"first": min(shared), "last": max(shared), "largest": min(shared, key=lambda k: (-shared[k], k))}[rule])
    return out


def test_token_count_query(spark, library, docs):
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts.op8_token_counts(spark, SF).collect()}
    for r in docs.limit(40).collect():
        places = brute_attribution(whole(library, r["text"]).offsets, token_counts.FIELD, "largest")
        for k in range(-(-len(r["text"]) // token_counts.FIELD)):
            assert got[r["doc_id"], k] == places.count(k)


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "one two three", [(0, 3), (5, 9)]), (2, "one", None), (3, None, [(0, 0)])],
                                 "doc_id int, text string, sections array<struct<start: int, end: int>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts.section_token_counts(docs, PATH).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (2, None): 1, (3, 0): 0}
    with pytest.raises(ValueError):
        token_counts.section_token_counts(docs, PATH, rule="none")
