"""String tiling, token files and the mix."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import tiling
from timberline.llm.minmax import deduplicated
from timberline.llm.mixing import mix_plan, mixed
from timberline.llm.tiling import contamination, tile, uncontaminated
from timberline.llm.token_files import pack, read_token_files, token_output, unpack, write_token_files
from timberline.llm.vocab import _IdTable, public_path, vocabulary
from timberline.session import scratch_path


def brute_tiles(item, text, size):
    """Greedy string tiling by definition: scan all unmarked pairs, mark a longest match, repeat."""
    marked_i, marked_t, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while (
                    a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n]
                    and not marked_i[a + n] and not marked_t[b + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < size:
            return tiles
        marked_i[a : a + n] = marked_t[b : b + n] = [True] * n
        tiles.append(n)


def test_tiles_match_the_definition():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randrange(4, 30))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        size = min(3, len(item))
        got = tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert got.tolist()[:1] == brute_tiles(item, text, size)[:1]
        assert sum(got) <= len(item)
    item = np.arange(30, dtype=np.uint64)
    moved = np.concatenate([item[20:], np.arange(100, 110), item[:20]]).astype(np.uint64)
    assert tile(item, moved).tolist() == [20, 10]


def test_contamination(spark, edge_docs, no_docs):
    item = [f"q{i}" for i in range(30)]
    rows = [
        (1, "before " + " ".join(item).upper() + " after"),
        (2, " ".join(item[15:]) + " between " + " ".join(item[:15])),
        (3, " ".join(item[:10])),
        (4, "Short item here"),
        (5, None),
        (None, " ".join(item)),
    ]
    bench = [(7, " ".join(item)), (8, "short item"), (9, None), (7, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {r.doc_id: (r.n_items, r.item_id, round(r.coverage, 3), r.kept) for r in contamination(docs, benchmark).collect()}
    assert got == {
        1: (1, 7, 1.0, False),
        2: (1, 7, 1.0, False),
        3: (0, 7, 0.333, True),
        4: (1, 8, 1.0, False),
        5: (0, None, 0.0, True),
        None: (1, 7, 1.0, False),
    }
    assert sorted(r.doc_id for r in uncontaminated(docs, benchmark).collect()) == [3, 5]
    assert contamination(edge_docs, benchmark.limit(0)).where("kept").count() == edge_docs.count()
    assert contamination(no_docs, benchmark).collect() == []
    assert uncontaminated(edge_docs, benchmark).columns == edge_docs.columns


def test_planted_items_are_found(spark, sf_dir, documents, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in contamination(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    flat = {i: " ".join(t.lower().split()) for i, t in bench.items()}
    holders = {d for d, t in texts.items() for f in flat.values() if f in " ".join((t or "").lower().split())}
    assert holders and all(not got[d].kept for d in holders)
    for d, row in got.items():  # the best coverage is what plain counting of five-word runs allows
        if row.coverage == 0:
            own = (texts[d] or "").lower().split()
            runs = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            assert not any(tuple(f.split()[i : i + 5]) in runs for f in flat.values() for i in range(len(f.split()) - 4))


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        codes = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = pack(codes)
        assert len(control) == -(-n // 4)
        assert (unpack(control, data, n) == codes).all()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path("word_bpe_49k.json"))


def expected_digest(rows, tokenizer):
    out, start = [], 0
    encoded = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    encoded.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].astype("<u2").tobytes()))
    for i, ids in encoded:
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_edge_rows(spark, edge_docs, no_docs, tokenizer):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = token_output(edge_docs).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_digest(rows, tokenizer)
    assert token_output(no_docs).collect() == []


def test_token_files_in_many_shards(spark, documents, texts, tokenizer):
    folder = scratch_path(spark, "many-shards")
    shards = write_token_files(documents, folder, shard_tokens=20_000).collect()
    assert len(shards) > 5 and sum(r.documents for r in shards) == len(texts)
    got = read_token_files(spark, folder).orderBy("shard", "inside").collect()
    assert [r._id for r in got] == sorted(texts)
    want = {i: n for i, _, n, _ in expected_digest(texts.items(), tokenizer)}
    assert {r._id: r.n_tokens for r in got} == want
    assert {r._id: len(r.tokens) // 4 for r in got} == want


def test_token_digest(documents, texts, tokenizer):
    got = token_output(documents).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_digest(texts.items(), tokenizer)


def test_mix_of_edge_rows(edge_docs, no_docs):
    plan = mix_plan(edge_docs).collect()
    assert len(plan) == edge_docs.count()
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in plan)
    assert {r.size for r in plan if r.size == 0} == {0}
    copies = Counter(r.doc_id for r in mixed(edge_docs).collect())
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.copies
    assert copies == Counter({k: v for k, v in want.items() if v})
    assert mixed(edge_docs).columns == edge_docs.columns
    assert mix_plan(no_docs).collect() == [] and mixed(no_docs).collect() == []


def test_mix_comes_near_its_targets(documents):
    rows = mix_plan(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-3 * total
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        largest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * largest


def clashing(spark, rows):
    """Rows with every name that the pipeline's operators use inside, each with values of its own."""
    names = ["_key", "_copies", "_copy", "_found", "_row_key", "_kept_key", "_kept", "key", "row", "copies", "_item", "root", "node", "_own"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.selectExpr("*", *[f"concat('{n} of ', doc_id) AS {n}" for n in names]).selectExpr("*", "doc_id AS `a.b`")


def test_pipeline_stages_keep_the_values_of_columns_with_clashing_names(spark):
    texts = [f"alpha{i} beta{i} gamma delta epsilon{i} " * 3 for i in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    docs = clashing(spark, [*rows, (10, texts[0], "en", "s0", 5), (11, None, None, None, None)])
    benchmark = spark.createDataFrame([(1, texts[5])], "item_id bigint, text string")
    own = {r.doc_id: r for r in docs.collect()}
    kept = deduplicated(docs).collect()
    assert {r.doc_id for r in kept} == {0, 1, 2, 3, 4, 5, 11}
    clean = uncontaminated(docs, benchmark).collect()
    assert {r.doc_id for r in clean} == {0, 1, 2, 3, 4, 10, 11}
    mix = mixed(docs).collect()
    assert mix
    for found in (kept, clean, mix):
        assert all(r == own[r.doc_id] and r.__fields__ == own[r.doc_id].__fields__ for r in found)


@pytest.mark.parametrize("kind, ids", [("string", ["i2", "i1", "i3"]), ("bigint", [2, 1, 3]), ("double", [2.5, 1.5, 3.5])])
def test_the_least_item_is_named_on_a_tie(spark, kind, ids):
    text = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(i, text) for i in ids], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = contamination(docs, items).first()
    assert (found.item_id, found.n_items, found.coverage) == (min(ids), 3, 1.0)


def test_maximal_matches_do_not_depend_on_the_pairs_listed_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(60):
        item, text = (rng.integers(0, 4, rng.integers(1, 60)).astype(np.uint64) for _ in range(2))
        results = []
        for pairs in (1, 7, 1 << 20):
            monkeypatch.setattr(tiling, "_PAIRS", pairs)
            results.append((sorted(tiling._maximal(item, text, 3)), tiling.tile(item, text, 3).tolist()))
        assert results[0] == results[1] == results[2]
        inside = [(i, t) for i in range(len(item)) for t in range(len(text)) if item[i] == text[t]]
        runs = {(i, t) for i, t in inside if (i - 1, t - 1) not in inside}
        assert {(i, t) for i, t, _ in results[0][0]} == runs


def test_tiles_of_equal_words_in_bounded_memory():
    import tracemalloc

    one = np.uint64(12345)
    tracemalloc.start()
    tiles = tiling.tile(np.full(3000, one), np.full(30_000, one))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles.tolist() == [3000] and peak < 200 << 20


WORD_PARTS = st.sampled_from([*"aAbzZéÉßÀÖ×÷ØÞþÿ'!?.,-_01 \t\n\x0b\x85 ‍﻿́İıΣσς漢кЖ😀\x1c", "straße", "ÉCOLE", "...", "don't"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.lists(WORD_PARTS, max_size=12).map("".join), max_size=30), st.sampled_from([3, 1_000_000]))
def test_ids_of_words_by_hash(tokenizer, rows, size):
    vocab = vocabulary(public_path("word_bpe_49k.json"))
    vocab._table = _IdTable(size, vocab.dtype)
    for some in (rows, rows[::-1]):
        ids, first = vocab.ids(pa.array(some, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_token_files_of_equal_ids(spark, tokenizer):
    """Many rows of one id, or of none, with a long common beginning, spread over shards and lie in one order."""
    head = "the same words begin every text of this id " * 5
    rows = [(i, head + f"row {j}") for i in (None, 7) for j in range(300)] + [(7, head + "row 1"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = scratch_path(spark, "equal-ids")
    shards = write_token_files(docs, folder, shard_tokens=2_000).collect()
    assert max(r.documents for r in shards) < 300
    got = read_token_files(spark, folder).orderBy("shard", "inside").collect()
    assert [r._id for r in got] == [7] * 301 + [8] + [None] * 300
    want = sorted(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows)
    assert sorted(bytes(r.tokens) for r in got) == want
