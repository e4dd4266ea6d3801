"""MinHash near-dedup by a chosen-path set similarity join (operator 6).

A document's set holds its distinct word shingles. Documents with equal sets are one class from
the start. A class is embedded as `COORDS` minwise tokens (one pass over the set: the least hash
in each of `COORDS` ranges, empty ranges borrow from others). A tree starts with all classes in
one node. The path to a node chooses coordinates, ``1 / threshold`` of them on average, and for
each of them the node's classes go on to one child per minwise token. A node of at most `limit`
classes, or at the greatest depth, is compared exhaustively. A pair at the threshold stays
together with about constant probability, and independent trees repeat that to the target recall.

A node to compare is cut into blocks of `block` classes; one task compares one pair of blocks, so
neither a node nor its pairs meet in one task, and only links that join two parts leave it (at
most one per class of the blocks). Sketches tell which classes can have a partner; only their
texts are moved, and every link is confirmed on the full sets. After the first tree, nodes whose
classes are connected already are not compared any more.

Cases: null and empty texts, and texts without words, have the empty set and are linked with
nothing; fewer words than a shingle make one shingle; rows that repeat an id are rows of their own;
null ids are allowed and never become the name of a component that has another id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow_groups import runs
from strata.llm.components import roots
from strata.llm.shingles import WordHashes, mixed, shingle_set, words_of
from strata.llm.tables import bound_batches, column, free_names, growing, remove, sized, written

COORDS = 64
SHINGLE = 5
TREES = (1, 9)
LIMIT = 2048
BLOCK = 256
MAX_DEPTH = 8

_SET_FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("sketch", T.ArrayType(T.IntegerType())),
]


# --- sets and minwise tokens, inside tasks ------------------------------------


def probes(coords: int) -> np.ndarray:
    """For each coordinate, the order in which it borrows from the others."""
    grid = mixed(np.arange(coords * coords, dtype=np.uint64).reshape(coords, coords))
    order = np.argsort(grid, axis=1)
    return order


def minwise(values: np.ndarray, coords: int, order: np.ndarray) -> np.ndarray:
    """Least hash in each of `coords` equal ranges of a sorted non-empty set."""
    edges = np.arange(coords, dtype=np.uint64) * np.uint64(2**64 // coords)
    first = np.searchsorted(values, edges)
    last = np.append(first[1:], len(values))
    tokens = values[np.minimum(first, len(values) - 1)]
    empty = first == last
    if empty.any():
        donors = ~empty[order[empty]]
        tokens[empty] = tokens[order[empty, donors.argmax(axis=1)]]
    return (mixed(tokens) & np.uint64(0x7FFFFFFF)).astype(np.int32)


def with_sets(docs: DataFrame, text_col: str, width: int, coords: int) -> DataFrame:
    """Adds set size, set key and minwise tokens; the text itself is left out."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, *_SET_FIELDS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, order = WordHashes(), probes(coords)
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for text in batch.column(text_col).to_pylist():
                values = shingle_set(memo.of(words_of(text)), width)
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                sketches.append(minwise(values, coords, order) if len(values) else None)
            columns = [batch.column(f.name) for f in kept]
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], [f.name for f in schema.fields])

    return docs.mapInArrow(add, schema)


# --- trees ---------------------------------------------------------------------


def _children(path: Column, sketch: Column, coords: int, threshold: float) -> Column:
    """Child paths of a class in a node: 1 / threshold coordinates on average, by the path alone."""
    whole, part = divmod(1.0 / threshold, 1.0)
    more = F.pmod(F.xxhash64(path, F.lit("more")), F.lit(1_000_000)) < int(part * 1_000_000)
    chosen = [F.pmod(F.xxhash64(path, F.lit(i)), F.lit(coords)).cast("int") for i in range(int(whole) + 1)]
    paths = [F.xxhash64(path, c, F.element_at(sketch, c + 1)) for c in chosen]
    return F.when(more, F.array_distinct(F.array(*paths))).otherwise(F.array(*paths[:-1]))


def _nodes(
    classes: DataFrame, rows: int, trees: range, threshold: float, limit: int, max_depth: int, coords: int
) -> DataFrame:
    """(``path``, ``cls``, ``n``) of the nodes to compare: those that hold several components.
    `rows` is the number of classes."""
    rows = math.ceil(rows * len(trees) / threshold)
    seeds = F.array(*[F.lit(i).cast("long") for i in trees])
    tokens = classes.select("cls", "comp", "sketch")
    members = tokens.withColumn("path", F.explode(F.transform(seeds, lambda i: F.xxhash64(F.lit("tree"), i))))
    leaves = None
    for depth in range(1, max_depth + 1):
        down = members.select("cls", "comp", F.explode(_children(F.col("path"), F.col("sketch"), coords, threshold)).alias("path"))
        sizes = down.groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        sizes = written(sized(sizes.filter("low < high").select("path", "n"), rows), "nodes")
        met = written(sized(down.select("cls", "path").join(growing(sizes), "path"), rows), "node-members")
        large = F.col("n") > limit
        ready = met if depth == max_depth else met.filter(~large)
        leaves = ready if leaves is None else leaves.unionByName(ready)
        if depth == max_depth or not met.filter(large).limit(1).count():
            break
        members = met.filter(large).drop("n").join(growing(tokens), "cls")
    return leaves


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """A row per member and pair of blocks (``bi`` <= ``bj``) that its own block belongs to."""
    count = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("cls", "path"), F.col("blocks")).cast("int")
    cut = members.withColumn("blocks", count).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = cut.withColumn("other", other)
    return paired.select(
        *[c for c in members.columns if c != "n"],
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
        "own",
    )


_GROUP = ["path", "bi", "bj"]


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a pair of blocks together, one pair after the other."""
    return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _possible(estimate: np.ndarray, sizes: np.ndarray, threshold: float, coords: int) -> np.ndarray:
    """Whether an estimated similarity may belong to a true one of the threshold (four deviations)."""
    slack = 4 * np.sqrt(threshold * (1 - threshold) / np.minimum(sizes, coords))
    return estimate >= threshold - slack


def _active(members: DataFrame, threshold: float, coords: int) -> DataFrame:
    """Members that have, by the sketches, a possible partner of another component."""
    schema = "path long, bi int, bj int, own int, cls long, comp long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, _GROUP):
            if part.num_rows < 2:
                continue
            comp, own = part.column("comp").to_numpy(), part.column("own").to_numpy()
            sizes = part.column("n_shingles").to_numpy()
            bi, bj = part.column("bi")[0].as_py(), part.column("bj")[0].as_py()
            tokens = np.asarray(part.column("sketch").combine_chunks().flatten()).reshape(-1, coords)
            left = np.flatnonzero(own == bi)
            right = left if bi == bj else np.flatnonzero(own == bj)
            found = np.zeros(part.num_rows, bool)
            for i in left.tolist():
                others = right[right > i] if bi == bj else right
                others = others[comp[others] != comp[i]]
                if not len(others):
                    continue
                small = np.minimum(sizes[others], sizes[i])
                others, small = (x[small >= threshold * np.maximum(sizes[others], sizes[i])] for x in (others, small))
                estimate = (tokens[others] == tokens[i]).mean(axis=1) if len(others) else np.zeros(0)
                hits = others[_possible(estimate, small, threshold, coords)]
                found[hits] = True
                found[i] |= bool(len(hits))
            if found.any():
                rows = part.select(["path", "bi", "bj", "own", "cls", "comp"]).filter(pa.array(found))
                yield from rows.combine_chunks().to_batches()

    return _spread(members).mapInArrow(search, schema)


def _confirmed(active: DataFrame, percent: int, width: int) -> DataFrame:
    """Links ``a``, ``b`` of classes, confirmed on full sets: in each pair of blocks the links that
    join two components, so at most one per class."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in runs(batches, _GROUP):
            links = _links(part, percent, width, memo)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
                )

    return _spread(active).mapInArrow(compare, "a long, b long")


def _links(part: pa.Table, percent: int, width: int, memo: WordHashes) -> list[tuple[int, int]]:
    members: dict[int, tuple] = {}
    for cls, comp, own, key, text in zip(*(part.column(c).to_pylist() for c in ("cls", "comp", "own", "set_key", "text"))):
        if cls not in members:
            values = shingle_set(memo.of(words_of(text)), width)
            if xxhash.xxh3_128_digest(values.tobytes()) == key:  # an id of several rows has several texts
                members[cls] = (comp, own, values)
    if len(members) < 2:
        return []
    names, rows = list(members), list(members.values())
    own = np.array([r[1] for r in rows])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(r[2]) for r in rows], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)[1]
    flags = np.zeros(len(tokens) + 1, np.int32)
    bi, bj = part.column("bi")[0].as_py(), part.column("bj")[0].as_py()
    left = np.flatnonzero(own == bi)
    right = left if bi == bj else np.flatnonzero(own == bj)
    by_size = right[np.argsort(sizes[right], kind="stable")]
    links = []
    for i in left.tolist():
        low, high = np.searchsorted(sizes[by_size], [-(-percent * sizes[i] // 100), sizes[i] * 100 // percent + 1])
        mine = find(rows[i][0])
        others = [j for j in by_size[low:high].tolist() if (bi != bj or j > i) and find(rows[j][0]) != mine]
        if not others:
            continue
        own_tokens = tokens[starts[i] : starts[i + 1]]
        flags[own_tokens] = 1
        gathered = flags[np.concatenate([tokens[starts[j] : starts[j + 1]] for j in others])]
        common = np.add.reduceat(gathered, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        flags[own_tokens] = 0
        union = sizes[i] + sizes[others] - common
        for j in np.asarray(others)[100 * common >= percent * union].tolist():
            a, b = find(rows[i][0]), find(rows[j][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((names[i], names[j]))
    return links


# --- the join --------------------------------------------------------------------


def near_groups(
    docs: DataFrame,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    trees: tuple[int, ...] = TREES,
    limit: int = LIMIT,
    block: int = BLOCK,
    max_depth: int = MAX_DEPTH,
    coords: int = COORDS,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links of
    at least `percent` similarity reach), ``kept`` (whether that is its own id)."""
    bound_batches(docs.sparkSession)
    text = column(docs, text_col).cast("string")
    source = docs.select(column(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = written(with_sets(source, "text", width, coords), "near-rows")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    classes = (
        rows.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .select("set_key", "n_shingles", "sketch", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    classes = written(classes, "near-classes")
    number_of_classes = classes.count()
    labels, start = None, 0
    for number in trees:
        labelled = classes if labels is None else classes.join(growing(labels), classes["cls"] == labels["node"], "left")
        comp = F.col("cls") if labels is None else F.coalesce("root", "cls")
        labelled = written(sized(labelled.withColumn("comp", comp).drop("node", "root"), number_of_classes), "near-labelled")
        members = _nodes(labelled, number_of_classes, range(start, start + number), percent / 100, limit, max_depth, coords)
        start += number
        sketched = members.join(growing(labelled.select("cls", "comp", "n_shingles", "sketch")), "cls")
        active = written(_active(_blocks(sketched, block), percent / 100, coords), "near-active")
        wanted = written(sized(active.select("cls").distinct(), number_of_classes), "near-wanted")
        chosen = classes.join(growing(wanted), "cls", "left_semi").select("cls", "set_key", "rep_id", "rep_hash")
        chosen = written(sized(chosen, number_of_classes), "near-chosen")
        same = (source["text_hash"] == chosen["rep_hash"]) & source["doc_id"].eqNullSafe(chosen["rep_id"])
        texts = source.join(growing(chosen), same).select("cls", "set_key", "text")
        found = written(_confirmed(active.join(growing(texts), "cls"), percent, width), "near-links")
        if labels is not None:  # the components so far are stars
            found = found.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = written(roots(found, found.count()), "near-labels")
        remove(labelled, active, wanted, chosen)

    named = classes.join(growing(labels), classes["cls"] == labels["node"], "left").select(
        "set_key", "rep_id", F.coalesce("root", "cls").alias("comp"), F.col("root").isNotNull().alias("linked")
    )
    named = written(sized(named, number_of_classes), "near-named")
    lowest = named.filter("linked").groupBy("comp").agg(F.min("rep_id").alias("lowest"))
    lowest = written(sized(lowest, number_of_classes), "near-lowest")
    final = named.join(growing(lowest), "comp", "left").select("set_key", F.coalesce("lowest", "rep_id").alias("component_id"))
    final = written(sized(final, number_of_classes), "near-final")
    out = rows.drop("sketch").join(growing(final), "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of the smallest id, all columns kept.

    Rows are told apart by id and text, so near copies that repeat an id leave one row as well, and of rows
    with the same id and text one stays. Rows without words are linked with nothing: all of them stay.
    """
    code = F.xxhash64(column(docs, text_col).cast("string"))
    name = F.struct(column(docs, id_col).isNull().alias("none"), column(docs, id_col).alias("id"), code.alias("hash"))
    keyed = docs.select(name.alias("key"), column(docs, text_col).cast("string").alias("text"))
    kept = near_groups(keyed, percent, "key", "text", **options).filter("kept").groupBy("doc_id")
    kept = kept.agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    kept = written(kept.select(F.col("doc_id.id").alias("id"), F.col("doc_id.hash").alias("hash"), "n", "n_shingles"), "near-kept")

    def rows_of(groups: DataFrame) -> DataFrame:
        return docs.join(growing(groups), column(docs, id_col).eqNullSafe(groups["id"]) & (code == groups["hash"]), "left_semi")

    repeated = (F.col("n") > 1) & (F.col("n_shingles") > 0)
    if not kept.filter(repeated).limit(1).count():
        return rows_of(kept)
    (hashed,) = free_names(docs, "hash")
    one = rows_of(kept.filter(repeated)).withColumn(hashed, code).dropDuplicates([id_col, hashed]).drop(hashed)
    return rows_of(kept.filter(~repeated)).unionByName(one)
