"""Near duplicates, repeated strings, leaked test items: brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import components, decontam, simhash, suffixes

from .conftest import SF


def brute_fingerprint(text, shingle):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_components(rows, shingle, threshold=4):
    prints = [brute_fingerprint(t, shingle) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= threshold]
    place = groups(range(len(rows)), near)
    least = {}
    for i, (doc, _) in enumerate(rows):
        own = [d for d in (least.get(place[i]), doc) if d is not None]
        least[place[i]] = min(own) if own else None
    return sorted((repr(doc), f"{prints[i]:016x}", repr(least[place[i]])) for i, (doc, _) in enumerate(rows))


def found_components(docs, **options):
    rows = simhash.near_duplicates(docs, **options).select("doc_id", "fingerprint", "component_id").collect()
    return sorted((repr(a), b, repr(c)) for a, b, c in rows)


def test_simhash_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((repr(a), b, repr(c)) for a, b, c in simhash.op4_simhash(spark, SF).collect()) == brute_components(rows, 4)


def test_simhash_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert found_components(edge_docs, shingle=5) == brute_components(rows, 5)
    assert found_components(no_docs) == []


@pytest.mark.parametrize("bits,threshold", [*simhash.LAYOUT, (23, 0), (25, 2)])
def test_anchors_cover(bits, threshold):
    """Words within the threshold of a word visit its home; each has one home."""
    rng = np.random.default_rng(bits)
    words = rng.integers(0, 1 << bits, 200, dtype=np.uint64)
    index, anchor, home = simhash.anchors(words, bits, threshold)
    at_home = dict(zip(index[home].tolist(), anchor[home].tolist()))
    assert home.sum() == len(words) == len(at_home)
    for flips in range(threshold + 1):
        moved = words.copy()
        for k in range(len(words)):
            for bit in rng.choice(bits, flips, replace=False):
                moved[k] ^= np.uint64(1 << int(bit))
        visits = set(zip(*(x.tolist() for x in simhash.anchors(moved, bits, threshold)[:2])))
        assert all((k, a) in visits for k, a in at_home.items())


@pytest.mark.parametrize("tile", [2048, 3])
def test_links_connect_like_all_pairs(spark, tile):
    rng = random.Random(tile)
    prints = set()
    for _ in range(12):
        start = rng.getrandbits(64)
        for _ in range(25):
            prints.add(start)
            for bit in rng.sample(range(64), rng.choice([0, 1, 4, 5, 9])):
                start ^= 1 << bit
    center = rng.getrandbits(64)
    prints |= {center ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(0, 40, 2), 2)}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    table = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = [tuple(r) for r in simhash.links(table, tile=tile).collect()]
    assert set(found) <= set(near) and groups(prints, found) == groups(prints, near)
    with pytest.raises(ValueError):
        simhash.links(table, layout=((32, 1), (32, 1)))


def test_components(spark):
    rng = random.Random(1)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [(5, k) for k in range(30)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] * 2):
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = {n for e in edges for n in e if e[0] != e[1]}
        assert got == groups(nodes, [e for e in edges if e[0] != e[1]])


def test_representatives(edge_docs):
    found = simhash.near_duplicates(edge_docs, shingle=5)
    kept = simhash.keep_representatives(edge_docs, found)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    left = {(r["doc_id"], r["text"]) for r in rows}
    assert len(left) == len(rows)
    assert {r["component_id"] for r in found.collect()} == {r["component_id"] for r in simhash.near_duplicates(kept, shingle=5).collect()}


# ---- suffixes

@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 12), st.integers(1, 3))
@settings(deadline=None)
def test_suffix_order(symbols, depth, times):
    text = np.array(symbols * times, np.int64)
    order = suffixes.suffix_order(text, depth)
    prefixes = [tuple(text[i:i + depth].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and prefixes == sorted(prefixes)


def brute_removal(rows, length=50):
    datas = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in datas:
        for p in range(len(b) - length + 1):
            first[b[p:p + length]] = min(first.get(b[p:p + length], d), d)
    out = []
    for (doc, _), (d, b) in zip(rows, datas):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < d:
                mark[p:p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((doc, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest(), kept))
    return out


def report(docs, **options):
    return sorted(repr(tuple(r)) for r in suffixes.removal_report(docs, **options).collect())


def test_suffix_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in suffixes.op9_suffix_dedup(spark, SF).collect()) == sorted(repr(r[:5]) for r in brute_removal(rows))


@pytest.mark.parametrize("hot,crowded", [(5000, 500), (3, 500), (0, 0)])
def test_suffix_hard(spark, monkeypatch, hot, crowded):
    """Runs of one byte, shared passages with other surroundings, ties of ids, null ids and texts."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), "x" * 49
    rows = [(k, text(8) + passage[rng.randrange(40):][:rng.randrange(60, 140)] + text(8)) for k in range(60)]
    rows += [(rng.randrange(60), text(3) + passage + passage) for _ in range(5)] + [(None, passage), (None, passage), (None, None), (70, None), (71, ""), (3, "a" * 500), (4, "a" * 49), (2, "a" * 51 + line)]
    rows += [(80 + k, line + text(5)) for k in range(20)] + [(200, rows[0][1]), (200, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(docs) == sorted(repr(r[:5]) for r in brute_removal(rows))
    assert report(docs, length=20, gram=8) == sorted(repr(r[:5]) for r in brute_removal(rows, 20))


def test_packed_runs_in_one_process(monkeypatch):
    """Runs that are cut because they are long, several rows of a bucket, and a full bitmap."""
    monkeypatch.setattr(suffixes, "_LONGEST_RUN", 70)
    monkeypatch.setattr(suffixes, "HELD", 2000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    rows = [(k, "".join(rng.choice("abcd ") for _ in range(30)) + passage[k:] + "x" * (40 + 20 * k)) for k in range(30)]
    shared = type("Shared", (), {"value": (np.full(1 << 17, 255, np.uint8), np.zeros(0, np.uint64), 8)})
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows], "doc": [d for d, _ in rows], "text_key": [d + 100 for d, _ in rows]})
    packed = pa.Table.from_batches(suffixes._pack_runs(shared, 50, 24, 256)(batch.slice(k, 3) for k in range(0, 30, 3))).sort_by("bucket")
    assert packed.num_rows > 256
    spans = {}
    for part in suffixes._solve_packed(50)(packed.to_batches(max_chunksize=7)):
        for r in part.to_pylist():
            assert r["text_key"] == r["doc"] + 100
            spans.setdefault(r["doc"], []).append(r)
    for d, n_bytes, n_removed, n_spans, *_ in brute_removal(rows):
        runs = suffixes._merged(spans.get(d))
        assert (sum(b - a for a, b in runs), len(runs)) == (n_removed, n_spans)


def test_suffixes_are_sorted_in_portions(monkeypatch):
    """A bucket's slices are not sorted all at once; those of one anchor stay together, and the minima are the same."""
    rng = random.Random(4)
    sizes = [1, 2, 30, 1, 5, 3, 3, 40, 2]
    group = np.repeat(np.arange(len(sizes)), sizes)
    content, least = [], np.array([rng.randrange(100) for _ in group])
    for size in sizes:
        text = bytes(rng.choice(b"ab") for _ in range(70))
        content += [text[rng.randrange(15):] for _ in range(size)]
    n = np.array([len(c) - 49 for c in content])
    minima, sorted_at_once = suffixes.window_minima, []

    def watched(slices, docs, length):
        sorted_at_once.append(len(slices))
        return minima(slices, docs, length)

    def found():
        sorted_at_once.clear()
        return sorted(zip(*(x.tolist() for x in suffixes._slice_minima(np.zeros(0, np.int64), np.arange(len(n)), n, content.__getitem__, least, group, 50))))

    monkeypatch.setattr(suffixes, "window_minima", watched)
    whole = found()
    assert sorted_at_once == [len(n)]
    monkeypatch.setattr(suffixes, "SORTED", 400)
    assert found() == whole and max(sorted_at_once) == 40 and len(sorted_at_once) > 4 and sum(sorted_at_once) == len(n)


@pytest.mark.parametrize("kinds", [1, 5, 3000])
def test_a_task_gives_a_slice_once_while_it_knows_it(monkeypatch, kinds):
    """Whatever is forgotten, the first run of a slice has its content; what is known is bounded."""
    monkeypatch.setattr(suffixes, "SEEN", 1 << 8)
    seen = suffixes._unseen()
    texts = pa.array([f"{k % kinds:050d}" for k in range(6000)])
    shared = (np.full(1 << 17, 255, np.uint8), np.zeros(0, np.uint64), 8)
    given = set()
    for at in range(0, 6000, 500):
        runs = suffixes._runs(texts.slice(at, 500), shared, False, 50, 24, seen)
        fresh = set(runs.identity[runs.new].tolist())
        assert set(runs.identity.tolist()) <= given | fresh and len(runs.content) == 50 * int(runs.new.sum())
        assert kinds > 5 or not fresh & given
        given |= fresh
    assert len(seen) == 1 << 8 and len(given) == kinds


def test_suffix_edges(edge_docs, no_docs):
    small = edge_docs.where("length(coalesce(text, '')) < 1000")
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert report(small) == sorted(repr(r[:5]) for r in brute_removal(rows))
    whole = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.removal_report(edge_docs).collect()}
    assert (6, 660000, 0) in whole and (7, 100, 100) in whole
    assert suffixes.removal_report(no_docs).count() == 0
    kept = suffixes.without_repeats(edge_docs)
    assert kept.columns == edge_docs.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert suffixes.without_repeats(no_docs).count() == 0


def test_without_repeats(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d: k.decode("utf-8", "ignore") for d, _, removed, _, _, k in brute_removal(rows)}
    got = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: t for d, t in want.items() if t or dict(rows)[d] == ""}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# ---- decontamination

def brute_alignment(passage, item):
    best = 0
    rows = [[0] * (len(passage) + 1)]
    for w in item:
        row = [0]
        for k, v in enumerate(passage):
            row.append(max(0, rows[-1][k] + (decontam.MATCH if v == w else decontam.MISMATCH), rows[-1][k + 1] - decontam.GAP, row[-1] - decontam.GAP))
        rows.append(row)
        best = max(best, max(row))
    return best


@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=15), min_size=1, max_size=4), st.lists(st.integers(0, 4), min_size=1, max_size=8))
@settings(deadline=None)
def test_alignment(passages, item):
    width = max(map(len, passages))
    left = np.array([p + [-1] * (width - len(p)) for p in passages], np.int64)
    best, _, _ = decontam.align(left, np.array([item] * len(passages), np.int64))
    assert best.tolist() == [brute_alignment(p, item) for p in passages]


def words_of(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def test_leaks_against_all_pairs(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(25)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs, items).collect()}
    texts = {r["item_id"]: words_of(r["text"]) for r in items.collect()}
    for r in docs.limit(60).collect():
        passage = words_of(r["text"])[:1500]
        for i, item in texts.items():
            if len(item) < 3 or len(words_of(r["text"])) > 1500:
                continue
            score = brute_alignment(passage, item) / (decontam.MATCH * len(item))
            if score < decontam.THRESHOLD and (r["doc_id"], i) in found:  # by a long part alone
                assert score * len(item) >= decontam.RUN_WORDS
                continue
            assert ((r["doc_id"], i) in found) == (score >= decontam.THRESHOLD)
            if score >= decontam.THRESHOLD:
                assert abs(found[r["doc_id"], i] - score) < 1e-9


def test_edited_and_frequent_leaks(spark):
    """Edited copies are found, however often an item was leaked; clean texts are left alone."""
    rng = random.Random(3)
    lexicon = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(k, text(30)) for k in range(10)] + [(10, "two words"), (11, None), (12, ""), (0, "same id " + text(12))]
    rows = [(k, f"{text(50)}. {text(30)}") for k in range(100)]
    leaked = set()
    for k in range(100, 200):
        item = 0 if k % 2 else rng.randrange(10)
        own = items[item][1].upper().split()
        for place in range(rng.randrange(5), 30, 5):
            own[place] = "edited"
        rows.append((k, f"{text(20)}, {'; '.join(own)} {text(20)}"))
        leaked.add((k, item))
    rows += [(None, items[3][1]), (300, None), (301, ""), (302, items[4][1] * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, table).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs == leaked | {(None, 3), (302, 4)}
    by_id = dict((d, t) for d, t in rows)
    for r in found:
        assert 0.5 <= r["score"] <= 1 and 0 <= r["start"] < r["end"] <= len(by_id[r["doc_id"]])
    exact = next(r for r in found if r["doc_id"] is None)
    assert exact["score"] == 1 and (exact["start"], exact["end"]) == (0, len(items[3][1]))
    kept = decontam.without_leaks(docs, table)
    assert {r["doc_id"] for r in kept.collect()} == set(range(100)) | {300, 301} and kept.columns == docs.columns


def test_parts_and_short_items(spark):
    """55 of 120 words, exact or with few edits, and items of one or two words as whole documents; scattered words and
    texts that hold a short item among others are left alone."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = text(120)
    own = long_.split()
    items = spark.createDataFrame([(1, long_), (2, "Two words"), (3, "single")], "item_id long, text string")
    edited = own[40:95]
    edited[10], edited[30] = "other", "another"
    docs = [(1, f"{text(30)} {' '.join(own[20:75])} {text(30)}"), (2, f"{text(9)} {' '.join(edited)} {text(20)}"), (3, "two WORDS!"), (4, "Single."),
            (5, f"{text(5)} two words {text(5)}"), (6, "single words"), (7, " ".join(w for pair in zip(own[::9], words) for w in pair)),
            (8, f"{text(20)} {' '.join(own[:12])} {text(20)}"), (9, f"{text(20)} {' '.join(own[:13])} {text(20)}"), (10, "words two"), (11, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 3), (9, 1)} and found[3, 2] == 1 and abs(found[1, 1] - 55 / 120) < 1e-9
    assert {r["doc_id"] for r in decontam.without_leaks(docs, items).collect()} == {5, 6, 7, 8, 10, 11}


def test_item_blocks_and_edges(spark, monkeypatch, edge_docs, no_docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, decontam.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (400,))
    assert sorted(map(tuple, decontam.find_leaks(docs, items).collect())) == whole and whole
    monkeypatch.undo()
    assert decontam.find_leaks(edge_docs, items).count() == 0 and decontam.without_leaks(edge_docs, items).count() == edge_docs.count()
    assert decontam.find_leaks(no_docs, items).count() == 0 and decontam.find_leaks(docs, items.where("false")).count() == 0
    assert decontam.without_leaks(docs, items.where("false")).count() == docs.count()


def test_empty_blocks():
    assert suffixes.anchor_runs(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].size == 0
    assert decontam.make_items([], []).grams.size == 0
    assert pa.array([]).null_count == 0
