"""Substring, line and near-duplicate operators against plain counting."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm.components import components
from timberline.llm.minmax import _open_groups, deduplicated, near_duplicates
from timberline.llm.substrings import remove_repeats
from timberline.llm.templates import _repeats, drop_templates


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_repeats(rows, window=35):
    split = [(i, words(t)) for i, t in rows]
    met = Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if met[tuple(w[s : s + window])] > 1:
                keep[s : s + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((str(i), len(w), len(w) - sum(keep), kept))
    return sorted(out)


@pytest.mark.parametrize("group_suffixes", [20_000, 1])
def test_repeats_of_edge_rows(edge_docs, no_docs, group_suffixes):
    got = remove_repeats(edge_docs, group_suffixes=group_suffixes)
    want = brute_repeats([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got.collect()) == want
    assert remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("group_suffixes", [20_000, 5])
def test_repeats_of_few_words(spark, group_suffixes):
    """A tiny vocabulary: periods, ties between seeds, repeats inside one text."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(100 + p, " ".join((["x", "y", "z", "w"][:p]) * 40)) for p in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window, seed in ((7, 3), (8, 3), (35, 8)):
        got = remove_repeats(docs, window=window, seed=seed, group_suffixes=group_suffixes).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == brute_repeats(rows, window)


@pytest.mark.parametrize("group_suffixes, hot_seeds", [(20_000, 0), (5, 0), (5, 1_000_000)])
def test_hot_seeds_by_both_ways(spark, group_suffixes, hot_seeds):
    """Hot seeds found in the texts, or joined to them, or none at all: the same words go."""
    rng = random.Random(11)
    passage = " ".join(rng.choices("abcdefgh", k=40))
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)) + ([passage] if i % 3 == 0 else []))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, passage), (7, None)], "doc_id bigint, text string").repartition(4)
    got = remove_repeats(docs, window=9, seed=4, group_suffixes=group_suffixes, hot_seeds=hot_seeds)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 9)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got.collect()) == want



def shingle_set(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)].append(i)
    out = []
    for x, (i, s) in enumerate(sets):
        component = min(least[find(x)], default=None) if s else i
        out.append((str(i), len(s), str(component), i == component))
    return sorted(out)


def test_near_duplicates_of_edge_rows(edge_docs, no_docs):
    got = near_duplicates(edge_docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert near_duplicates(no_docs).collect() == []
    assert deduplicated(edge_docs).columns == edge_docs.columns
    assert [r.doc_id for r in deduplicated(edge_docs).collect()].count(9) == 1


def test_deduplicated_tells_rows_by_id_and_text(spark):
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(30)) for name in "abcd")
    rows = [(1, one), (None, one), (None, one + " end"), (7, two), (7, three), (None, four), (None, four), (8, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text) for r in deduplicated(docs).collect())
    assert got == sorted([("1", one), ("7", two), ("7", three), ("None", four), ("8", ""), ("9", "")])


def test_near_duplicates_in_chains_and_hot_bands(spark):
    """Edited copies of copies: links between members that their common hub does not have."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows, current = [], base
    for i in range(160):
        if i % 8 == 0:
            current = list(base)
        current = list(current)
        current[rng.randrange(100)] = f"new{i}"
        rows.append((i, " ".join(current)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("permutations", [2, 80])
def test_no_link_of_small_sets_is_lost(spark, permutations):
    """Pairs of 3 and 4, 6 and 8, 48 and 64 shingles at exactly 75 %; a single band finds few of them."""
    rows = []
    for k in range(300):
        for size, (few, many) in enumerate(((7, 8), (10, 12), (52, 68))):
            names = [f"w{k}x{size}x{i}" for i in range(many)]
            rows += [(len(rows), " ".join(names[:few])), (len(rows) + 1, " ".join(names))]
            rows += [(len(rows), " ".join([*names[: few * 7 // 10], "other"]))]  # below 75 % of both
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), permutations=permutations).collect()
    want = {i: i - 1 if i % 3 == 1 else i for i, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == want


def test_shared_text_alone_opens_no_group(spark):
    """Documents with a common header of a third of their shingles: no set is compared with others for it."""
    sets = [(i, i, 0, [*range(30), *range(1000 * (i + 1), 1000 * (i + 1) + 70)]) for i in range(500)]
    near = [(900 + i, 900 + i, 0, [*range(30), *range(950_000, 950_069), 960_000 + i]) for i in range(2)]
    for rows, open_nodes in ((sets, set()), (sets + near, {900, 901})):
        found, _ = _open_groups(spark.createDataFrame(rows, "node bigint, root bigint, circle bigint, set array<bigint>"), 75)
        assert {r.node for r in found.collect()} == open_nodes


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 201), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_templates_of_any_size(spark):
    """Fields are fields whether their values recur or not."""

    def letters(n):
        return "".join("abcdefghij"[int(d)] for d in str(n))

    for n, kinds in ((40, 40), (1000, 20), (4000, 1000)):
        # names and cities meet in as many pairs as can be, so hardly a line recurs
        rows = [(i, f"Report filed today by N{letters(i % kinds)} from C{letters((i * 7 + i // kinds) % kinds)} office") for i in range(n)]
        rows.append((n, "Report filed and never read by anyone in any office"))
        got = drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.doc_id: r.n_dropped for r in got} == {i: int(i < n) for i in range(n + 1)}


def test_templates_count_documents_and_not_lines(spark):
    # "k" is met there in four lines of one document: a field, as in the three other documents
    rows = [(0, "\n".join(f"a b c d {x} k" for x in "pqrs"))] + [(i, f"a b c d {x} {y}") for i, (x, y) in enumerate(["tu", "vw", "xy"], 1)]
    rows += [(i, "a b c d e f g h\na b c d e x y z") for i in range(10, 13)] + [(13, "a b c m n o p q")]
    got = {r.doc_id: r.n_dropped for r in drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 4, 1: 1, 2: 1, 3: 1, 10: 0, 11: 0, 12: 0, 13: 0}
    # six lines of one document in a leaf of four: none of their own tokens recurs in other documents
    rows = [(0, "\n".join(f"a b c d e {x} w z" for x in "pqrstu"))] + [(i, f"a b c {x} {x}{x} {x}y y{x} {x}z") for i, x in enumerate("ghi", 1)]
    got = {r.doc_id: r.n_dropped for r in drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 0 for i in range(4)}


def test_repeats_in_a_text():
    text, leaf, count = np.array([0, 0, 0, 1, 1]), np.array([5, 5, 9, 5, 5], np.uint64), np.array([2, 2, 1, 2, 2])
    tokens = np.array([1, 2, 1, 3, 1, 1, 2, 1, 2], np.uint64)
    got = sorted(zip(*(x.tolist() for x in _repeats(text, leaf, count, tokens))))
    assert got == [(5, 0, 1, 2), (5, 1, 2, 1)]


def test_templates(spark, edge_docs, no_docs):
    rows = [(i, f"Unique text of number {'abcdefgh'[i]}\nServer node-{i} answered in {i * 7} ms today\n\nEnd{i}") for i in range(6)]
    rows += [(6, "Server node-1 was never heard of again today"), (7, None)]
    got = {r.doc_id: r for r in drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].text == "" and got[0].n_dropped == 3  # all three recur in six documents
    assert got[6].text == rows[6][1] and got[6].n_dropped == 0
    assert (got[7].text, got[7].n_lines) == ("", 0)
    assert drop_templates(edge_docs).count() == edge_docs.count()
    assert drop_templates(no_docs).collect() == []
