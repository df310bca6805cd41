"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two sketch values, the least and
the greatest, so ``permutations`` passes give ``2 * permutations`` unbiased
values. Four of them (both values of two permutations) make a band. Documents
of similarity 0.75 share one of the 40 default bands but for a chance of
(1 - 0.75**4)**40 < 3e-7, if their sets are large. Least and greatest value of a small set depend on
each other (with 3 of 4 shingles shared the chance is (1 - 0.25)**40 = 1.0e-5), so sets of at most
64 shingles take the exact path below as well, and no link between two of them is lost.

Equal shingle sets are one node of the graph, so exact copies cost one row.
The members of a band meet at its hub (the least node), not in all pairs, and a pair is a link
only if the full sets confirm it. A member that is then in another component than others of its
band could still be linked with one that was no hub. The bands where that is so are joined into
circles, and their members go the exact path within them, small sets with all small sets too: in one
order of all shingles, rare ones first, two linked sets share one of the first n - ceil(0.75 n) + 1
of each, so text that many documents share brings none together that differ otherwise. The groups of
such a shingle in a circle that hold more than one component are
joined into families, and a family is settled exactly: its members are dealt to blocks of
bounded size, and each pair of blocks is a task that multiplies the blocks' shingle matrices and
returns the links that join components, never the pairs. No pair is left out for the size of
its band or group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.components import components, joined_roots
from timberline.llm.rows import carried, unpacked
from timberline.llm.words import hashed_words, mix, pieces, run_hashes, signed
from timberline.session import checkpointed, removed, written

SHINGLE = 5
PERMUTATIONS = 80
PERCENT = 75
BLOCK_SETS = 1000  # members of a block, about
BLOCK_SHINGLES = 1_000_000  # shingles of a block, about
SMALL_SET = 64  # shingles of a set that takes the exact path whatever its bands
COUNT_PLACES = 1 << 18  # counts of shingles sent to the tasks, by the low bits of their hashes
_PER_BAND = 2  # permutations in a band
_COLUMNS = 2048  # shingles multiplied at a time


def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919)
    draw = rng.integers(0, 2**64, (2, permutations), dtype=np.uint64, endpoint=False)
    return draw[0] | np.uint64(1), draw[1]


def _shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and their offsets."""
    words = hashed_words(texts, lower=True)
    grams = run_hashes(words.hashes, size)
    sets = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= size:
            sets.append(np.unique(grams[begin : end - size + 1]))
        else:
            sets.append(run_hashes(words.hashes[begin:end], end - begin) if end > begin else grams[:0])
    offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
    return (np.concatenate(sets) if sets else grams[:0]), offsets


def _nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every non-empty set."""
    if not len(offsets):
        return np.empty(0, np.uint64)
    one = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets)
    two = np.add.reduceat(mix(hashes), offsets)
    return mix(one ^ mix(two))


def _sketches(size: int, permutations: int):
    factor, shift = _factors(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, offsets = _shingle_sets(piece.column("text"), size)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            heads = offsets[full]
            bands = []
            for start in range(0, permutations, _PER_BAND):
                band = np.full(len(full), start, np.uint64)
                for p in range(start, start + _PER_BAND if len(full) else start):
                    values = hashes * factor[p] + shift[p]
                    band = mix(band ^ np.minimum.reduceat(values, heads))
                    band = mix(band ^ np.maximum.reduceat(values, heads))
                bands.append(band)
            node = np.zeros(piece.num_rows, np.uint64)
            node[full] = _nodes(hashes, heads)
            lengths = np.zeros(piece.num_rows, np.int64)
            lengths[full] = len(bands)
            yield pa.record_batch(
                {
                    "_id": piece.column("_id"),
                    "_key": piece.column("_key"),
                    "n": pa.array(count, pa.int64()),
                    "node": pa.array(signed(node), pa.int64(), mask=count == 0),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
                        pa.array(signed(np.ascontiguousarray(np.stack(bands, 1)).reshape(-1))),
                    ),
                }
            )

    return run


def _sets(size: int):
    """The shingle set of every text whose set is the node asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, offsets = _shingle_sets(piece.column("text"), size)
            full = np.flatnonzero(np.diff(offsets))
            node = np.zeros(piece.num_rows, np.uint64)
            node[full] = _nodes(hashes, offsets[full])
            wanted = piece.column("node").to_numpy(zero_copy_only=False)
            batch = pa.record_batch(
                {
                    "node": piece.column("node"),
                    "set": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(hashes))),
                }
            )
            yield batch.filter(pa.array(signed(node) == wanted))

    return run


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether two arrays of distinct values have Jaccard similarity of at least ``percent`` %."""
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= percent * (F.size(a) + F.size(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("a_set"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("b_set"))
    return pairs.join(one, "a").join(two, "b").where(similar(F.col("a_set"), F.col("b_set"), percent)).select("a", "b")


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes that their set sizes do not rule out."""
    low, high = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    return (
        pairs.where((F.col("x") != F.col("y")) & (100 * low >= percent * high))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )


def _common(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another."""
    sizes = [len(x) for x in own + other]
    row = np.repeat(np.arange(len(sizes)), sizes)
    values, place, met = np.unique(np.concatenate([*own, *other]), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(met > 1)  # a shingle of one set adds nothing
    at = np.full(len(values), -1)
    at[kept] = np.arange(len(kept))
    place = at[place]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(own), len(other)), np.float32)
    for start in range(0, len(kept), _COLUMNS):
        low, high = np.searchsorted(place, (start, start + _COLUMNS))
        matrix = np.zeros((len(sizes), _COLUMNS), np.float32)
        matrix[row[low:high], place[low:high] - start] = 1
        total += matrix[: len(own)] @ matrix[len(own) :].T
    return total


def _joining(block: list, other: list, percent: int) -> list[tuple[int, int]]:
    """Links between members (node, root, set) of two blocks that join different roots."""
    common = _common([m[2] for m in block], [m[2] for m in other])
    union = np.array([len(m[2]) for m in block])[:, None] + np.array([len(m[2]) for m in other]) - common
    rows, columns = np.nonzero(100 * common >= percent * union)
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    links = []
    for i, j in zip(rows.tolist(), columns.tolist()):
        a, b = top(block[i][1]), top(other[j][1])
        if a != b:
            above[a] = b
            links.append((block[i][0], other[j][0]))
    return links


def _settle(percent: int):
    """Links of every (family, i, j); the rows come sorted by it."""

    def links_of(members: list, i: int, j: int) -> list[tuple[int, int]]:
        block = [m[1:] for m in members if m[0] == i]
        other = block if i == j else [m[1:] for m in members if m[0] == j]
        return _joining(block, other, percent) if block and other else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            sets, at = batch.column("set"), batch.column("set").offsets.to_numpy()
            flat = sets.values.to_numpy()
            names = ("family", "i", "j", "block", "node", "root")
            found: list[tuple[int, int]] = []
            for k, (family, i, j, block, node, root) in enumerate(zip(*[batch.column(n).to_pylist() for n in names])):
                if (family, i, j) != key:
                    if members:
                        found += links_of(members, key[1], key[2])
                    key, members = (family, i, j), []
                members.append((block, node, root, flat[at[k] : at[k + 1]].copy()))
            yield _pairs(found)
        if members:
            yield _pairs(links_of(members, key[1], key[2]))

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _rarity(population: DataFrame) -> np.ndarray:
    """How many shingles of all sets there are at each of ``COUNT_PLACES`` places."""
    place = F.col("shingle").bitwiseAND(F.lit(COUNT_PLACES - 1))
    met = population.select(F.explode("set").alias("shingle")).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("met")).toArrow()
    counts = np.zeros(COUNT_PLACES, np.int64)
    counts[met.column("place").to_numpy()] = met.column("met").to_numpy()
    return counts


def _prefixes(percent: int, counts: np.ndarray):
    """The shingles of a set of which a linked set has at least one among its own: the first ones by
    count of their place, then hash. Those that no other set has are left out. A key is told from a
    shingle and its circle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("set").offsets.to_numpy().astype(np.int64)
            values = batch.column("set").values.to_numpy()[at[0] : at[-1]]
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            met = counts[values & (COUNT_PLACES - 1)]
            order = np.lexsort((values, met, row))
            rank = np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)
            first = order[rank < np.repeat(size - (percent * size + 99) // 100 + 1, size)]
            first = first[met[first] > 1]
            holder = pa.array(row[first])
            circle = mix(batch.column("circle").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch(
                {
                    "key": pa.array(signed(mix(values[first].view(np.uint64) ^ circle[row[first]])), pa.int64()),
                    "node": batch.column("node").take(holder),
                    "root": batch.column("root").take(holder),
                    "n": pa.array(size[row[first]], pa.int64()),
                }
            )

    return run


def _unsettled(shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, str]:
    """(``node``, ``root``, ``circle``) of the members of bands that hold several components, by what such
    bands join, and of all small sets, which are one circle more."""
    spark = shared.sparkSession
    root = F.coalesce("root", "node").alias("root")
    placed, one = written(shared.select("band", "node").join(roots, "node", "left").select("band", "node", root), "placed")
    ends = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("hub"))
    # Written before it is joined, so that Spark can split a large band.
    split, two = written(ends.where("low <> high").select("band", "hub"), "split")
    members, three = written(placed.join(split, "band").select("node", "root", "hub").distinct(), "members")
    circles = components(members.select("node", "hub")).withColumnRenamed("root", "circle")
    met = members.select("node", "root").distinct().join(circles, "node")
    small = nodes.where(F.col("n").between(2, SMALL_SET)).select("node").join(roots, "node", "left")
    found = written(met.union(small.select("node", root, F.lit(0).cast("bigint"))), "unsettled")
    removed(spark, one, two, three)
    return found


def _open_groups(population: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """(``node``, ``root``, ``n``, ``hub``) of the sets (``node``, ``root``, ``circle``, ``set``) that share a
    first shingle with a set of their circle and another component; ``hub`` is the least node of those that share it."""
    prefixes, one = written(
        population.select("node", "root", "circle", "set").mapInArrow(
            _prefixes(percent, _rarity(population)), "key bigint, node bigint, root bigint, n bigint"
        ),
        "prefixes",
    )
    ends = prefixes.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("hub"))
    groups, two = written(ends.where("low <> high").select("key", "hub"), "groups")
    found = written(prefixes.join(groups, "key").select("node", "root", "n", "hub").distinct(), "open")
    removed(population.sparkSession, one, two)
    return found


def _family_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between members of different components that share a group."""
    families = components(open_.select("node", "hub")).withColumnRenamed("root", "family")
    members = open_.select("node", "n", "root").distinct().join(families, "node")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    tasks = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "family", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    whole = tasks.join(sets, "node").select("family", "i", "j", "block", "node", "root", "set")
    return whole.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_settle(percent), "a bigint, b bigint")


def _row_key(id_col: str, text_col: str) -> Column:
    """What rows equal in id and text have in common."""
    name = F.col(f"`{id_col}`")
    return F.xxhash64(name, F.col(f"`{text_col}`").cast("string"), name.isNull())


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, permutations: int, percent: int) -> DataFrame:
    """(``_id``, ``_key``, ``n``, ``node``, ``root``) of every row: its set, and its component's root."""
    if permutations <= 0 or permutations % _PER_BAND:
        raise ValueError(f"permutations must be a multiple of {_PER_BAND}")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _row_key(id_col, text_col).alias("_key")
    )
    id_type = rows.schema["_id"].dataType.simpleString()
    sketches = checkpointed(
        rows.mapInArrow(_sketches(shingle, permutations), f"_id {id_type}, _key bigint, n bigint, node bigint, bands array<bigint>")
    )
    met = sketches.where("node is not null")
    nodes = met.groupBy("node").agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    members = nodes.select("node", "n", F.explode("bands").alias("band"))
    hubs = (
        members.groupBy("band")
        .agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most"))
        .where("hub.node <> most")
        .select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    shared = checkpointed(members.join(hubs, "band"))

    pairs = checkpointed(
        _ordered(shared.select(F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("hub").alias("y"), F.col("hub_n").alias("y_n")), percent)
    )
    small = nodes.where(F.col("n").between(2, SMALL_SET)).select("node")
    asked = shared.select("node").union(small).distinct()
    holders = nodes.join(asked, "node").select("node", "_key")
    sets = checkpointed(
        rows.join(holders, "_key")
        .select("node", "text")
        .mapInArrow(_sets(shingle), "node bigint, set array<bigint>")
        .dropDuplicates(["node"])
    )
    links = checkpointed(_confirmed(pairs, sets, percent))
    roots = written(components(links), "roots")[0]
    unsettled, one = _unsettled(shared, nodes, roots)
    open_, two = _open_groups(unsettled.join(sets, "node"), percent)
    if not open_.isEmpty():
        more = checkpointed(_family_links(open_, sets, percent))
        if not more.isEmpty():
            roots = joined_roots(roots, more)
    removed(docs.sparkSession, one, two)

    return sketches.select("_id", "_key", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    permutations: int = PERMUTATIONS,
    percent: int = PERCENT,
) -> DataFrame:
    """Group documents linked by a similarity of ``percent`` % or more.

    A document's set holds its distinct runs of ``shingle`` words, A-Z folded; a
    shorter text is one shingle, a null text or one without words has an empty
    set and no links. Returns (``id_col``, ``n_shingles``, ``component_id``,
    ``kept``), one row per input row: ``component_id`` is the least id of the
    component, ``kept`` says that the row holds that id. Other columns are
    not read. Rows with a null id link like others, but give a component no id;
    a component of such rows alone has a null id and all are kept. Rows
    that repeat an id are rows of their own and are kept or dropped alike. An
    empty table gives an empty table.
    """
    placed = _placed(docs, id_col, text_col, shingle, permutations, percent)
    least = placed.where("root is not null").groupBy("root").agg(F.min("_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("least"))
    return placed.join(least, "root", "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    permutations: int = PERMUTATIONS,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs``, all columns, of one document per component: the one of the least id, then
    of the least hash of id and text. Null ids come last.

    Rows equal in id and text are one document and one of them stays, with a null id or an empty text
    too; rows that share an id alone are told apart by their texts."""
    placed = _placed(docs, id_col, text_col, shingle, permutations, percent)
    own = F.when(F.col("root").isNull(), F.col("_key")).alias("_own")
    first = F.min(F.struct(F.col("_id").isNull().alias("late"), F.col("_id"), F.col("_key")))
    ids = placed.groupBy("root", own).agg(first.alias("first")).select(F.col("first._key").alias("_kept"))
    rows = carried(docs, _row_key(id_col, text_col)).join(ids, F.col("key") == F.col("_kept"), "left_semi")
    return unpacked(rows.dropDuplicates(["key"]), docs)
