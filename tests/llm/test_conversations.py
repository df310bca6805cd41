"""Prefix tries and structure repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from timberline.llm import list_rank, queries
from timberline.llm import structure_repair as repair
from timberline.llm.prefix_trie import subtree_sums

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CLASHING = ["place", "digest", "chars", "depth", "k1", "n", "parent", "id", "next", "_part", "code", "rank", "audit", "cost", "fault"]


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(1, 60), *range(100, 160), 207, 300, 301, -5, -105, 2**40]:
        for turn in range(rng.randrange(0, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.9 else rng.choice(["system", "tool", "", None, "unknown"])
            text = rng.choice(["yes.", "no?", "more", "", " \t\n", None, "a. ", "b!\n", "été.", f"own {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(100, t, ["user", "assistant"][t % 2], f"shared {t}.") for t in range(3, 7)]
    rows += [(302, t, ["user", "assistant"][t % 2], f"long {t % 3}.") for t in range(1500)]
    rows += [(303, 1, "user", "same."), (303, 1, "user", "same."), (303, 1, "user", "same.")]
    rows += [(None, 0, "user", "of none."), (None, None, None, None), (304, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    rows = spark.createDataFrame(conversations(7), SCHEMA).selectExpr("*", *[f"'clash' AS {c}" for c in CLASHING])
    rows.repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return path


def trie_of(rows):
    turns = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        turns[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = [*turns.get(base, [])[:h], *turns[c][h:]]
    members = defaultdict(list)
    for c, listed in rebuilt.items():
        for d in range(len(listed) + 1):
            members[tuple(listed[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        held, under = members[node], children[node]
        below = [out[c] for c in under]
        ends = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(node))
        out[node] = (
            min(held),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(held),
            len(under),
            sum(b[5] for b in below) if below else 1,
            sum(b[6] for b in below) + (len(held) - 1) * (len(node[-1][1]) if node else 0),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def test_prefix_trie_against_plain_python(spark, folder):
    found = queries.op11_prefix_trie(spark, folder)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_of(conversations(7))


def test_prefix_trie_of_nothing(spark, empty_folder):
    assert queries.op11_prefix_trie(spark, empty_folder).collect() == []


@pytest.mark.parametrize("block, least", [(1 << 15, 1 << 16), (16, 20), (1, 10)])
def test_list_ranks(spark, block, least):
    order = random.Random(block).sample(range(1000), 90)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None])), "id bigint, next bigint")
    ranks = {r.id: r.place for r in list_rank.list_ranks(links, block, least).collect()}
    assert ranks == {node: i for i, node in enumerate(order)}


def test_list_ranks_of_nothing_and_one(spark):
    links = spark.createDataFrame([(4, None)], "id bigint, next bigint")
    assert [tuple(r) for r in list_rank.list_ranks(links).collect()] == [(4, 0)]
    assert list_rank.list_ranks(links.limit(0)).collect() == []


def test_subtree_sums(spark):
    rng = random.Random(5)
    parents = [None, *[rng.randrange(i) for i in range(1, 300)]]
    rows = [(i, p, i * i) for i, p in enumerate(parents)]
    nodes = spark.createDataFrame(rows, "n bigint, parent bigint, v bigint")
    want = [i * i for i in range(300)]
    for i in range(299, 0, -1):
        want[parents[i]] += want[i]
    assert {r.n: r.total for r in subtree_sums(nodes, {"v": "total"}).collect()} == dict(enumerate(want))


def cheapest(codes):
    """(cost, letters) over all edit sequences, the least letters among the cheapest."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(codes) and state in ("", "a") else []
        following = "a" if state == "u" else "u"

        def add(cost, letter, rest):
            out.append((cost + rest[0], letter + rest[1]))

        if i < len(codes):
            initial, fault = codes[i]
            add(4, "D", best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                add(3 + more, "R", best(i + 1, following, 0))
                if initial == following or (initial, state) == ("s", ""):
                    add(more, "K", best(i + 1, initial, 0))
        if inserted < 4:
            add(3, "I", best(i, following, inserted + 1))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def test_cheapest_edits_against_all_edits():
    rng = random.Random(11)
    faults = {repair.FINE: "", repair.GONE: "blank", repair.CUT: "truncated"}
    for _ in range(4000):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(10)))
        assert repair.cheapest_edits(codes) == cheapest(tuple(("suax"[c // 3], faults[c % 3]) for c in codes))


def test_cheapest_edits_of_a_very_long_conversation():
    cost, audit = repair.cheapest_edits(bytes([3 * repair.USER] * 60_001))
    assert (cost, len(audit)) == (3 * 30_001, 60_002)  # every second one is reroled, and one is inserted


def repaired_of(rows):
    damaged, ids = defaultdict(list), set()
    for conv, turn, role, text in sorted(rows, key=lambda r: turn_key((r[0], r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))):
        ids.add(conv)
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        damaged[conv] += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv in ids:
        turns = sorted(damaged[conv], key=turn_key)
        seen, codes, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append((role[:1] if role[:1] in "sua" and role else "x", fault))
            if fault:
                counts[fault] += 1
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = cheapest(tuple(codes)) if len(codes) < 60 else repair.cheapest_edits(
            bytes(3 * "suax".index(k) + {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}[f] for k, f in codes)
        )
        kept, state, left = [], "", iter(turns)
        for letter in audit:
            following = "a" if state == "u" else "u"
            _, _, role, text = (None, None, "", "") if letter == "I" else next(left)
            if letter == "D":
                continue
            role = {"u": "user", "a": "assistant"}[following] if letter in "IR" else role
            state = role[:1]
            kept.append((role, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append(((conv, gaps, *counts.values(), illegal, cost, audit, digest), kept))
    return sorted(out, key=str)


def test_repair_against_plain_python(spark, folder):
    found = queries.op13_structure_repair(spark, folder)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = repaired_of(conversations(7))
    assert sorted((tuple(r) for r in found.collect()), key=str) == [row for row, _ in want]
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    turns = repair.repaired_turns(queries.damaged(rows), rows.select("conv_id").distinct())
    assert turns.columns == ["conv_id", "turn", "role", "text"]
    got = defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        assert r.turn == len(got[r.conv_id])
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {row[0]: kept for row, kept in want if kept}


def test_repair_of_nothing(spark, empty_folder):
    assert queries.op13_structure_repair(spark, empty_folder).collect() == []


def test_repair_against_plain_python_on_all_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_structure_repair(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in found), key=str) == [row for row, _ in repaired_of(rows)]


def test_a_conversation_of_most_rows_is_spread_when_it_is_numbered(spark):
    from timberline.llm.prefix_trie import numbered_turns

    rows = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, 1).otherwise(F.col("id")).cast("bigint").alias("conv_id"),
        (F.col("id") * 7919 % 20_000).alias("turn"),
        F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    numbered = numbered_turns(rows)
    hot = numbered.where("conv_id = 1").withColumn("task", F.spark_partition_id())
    assert hot.select("task").distinct().count() >= 4
    assert sorted(r.place for r in hot.collect()) == list(range(1, 15_001))
