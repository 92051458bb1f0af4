"""Near-duplicate groups by MinHash with tensored banding.

Each document's shingle set gets two small collections of half keys, A and B,
of ``HALVES`` half keys each, and a half key joins ``ROWS`` minhashes.  The
key of table (i, j) joins A[i] and B[j]: HALVES squared tables come from
2 * HALVES * ROWS minhashes, where tables with hashes of their own would take
HALVES times as many.  A pair of similarity s shares a table with probability
(1 - (1 - s^ROWS)^HALVES)^2: 0.99993 at 0.8, more above.

Then every pair of different sets that can share a table is decided on the
full sets, without ever making a table of pairs:

* equal sets are one *class*, so copies cost one row each;
* classes that share a table are joined to the table's smallest class, and the
  components of that graph are *candidate groups*;
* a candidate group of bounded size is verified in one task, by an inverted
  index over its sets;
* a larger one is cut into blocks.  All blocks first meet the group's pivots,
  its best-connected classes, which links most of a family of near copies;
  what stays outside the largest linked part then meets every block, pair of
  blocks by pair of blocks, so that no link is lost.

Documents with no words, or a null id, are linked with nothing.  Sets are
64-bit hashes of their shingles, and classes 64-bit hashes of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, slices, stored
from .graphs import components
from .shingles import mix, shingle_hashes

HALVES, ROWS = 10, 2
PERCENT = 80
#: Most classes and shingles of a group verified in one task; a larger one is cut into blocks of about that size.
GROUP_CLASSES, GROUP_SHINGLES = 1000, 2_000_000
PIVOTS = 8
#: Most marks, of a few bytes each, by which texts that no group needs are kept out of a join.
MARKS = 1 << 18

_SEEDS = np.random.default_rng(20_240_229).integers(1, 2**63, (2 * HALVES * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * HALVES half keys for each of some non-empty sets: the first HALVES are A, the others B."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for h, (times, plus) in enumerate(_SEEDS):
        x = joined * times + plus
        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
        keys[:, h // ROWS] = mix(keys[:, h // ROWS] * _FOLD ^ least)
    return keys


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, n_shingles, class and half keys of every row (no class or keys for a text without words).  One scan."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches):
        for part in slices(batches):
            sets = [shingle_hashes(t, k) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(half_keys(full).view(np.int64).tolist() if full else [])
            yield batch_of(schema, part.column(0), [len(s) for s in sets], [class_of(s) if len(s) else None for s in sets],
                           [next(keys) if len(s) else None for s in sets])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, class long, keys array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b, degree of b) that join every class to the smallest class of each table bucket it shares."""
    n = HALVES
    tables = F.array(*[F.xxhash64(F.lit(i * n + j), F.get("keys", F.lit(i)), F.get("keys", F.lit(n + j)))
                       for i in range(n) for j in range(n)])
    entries = classes.select("class", F.explode(tables).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("bucket", "a")
    return (entries.join(shared, "bucket").groupBy("a", F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("degree")))


def similar(ids: list[int], sets: list[np.ndarray], labels: list[int], side: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets with 100 * intersection >= percent * union, as
    far as their labels don't say that they are joined.  With ``side``, only
    pairs from side 0 and side 1 are looked at.  Exact: intersections come
    from an inverted index over the shingles that two sets at least hold."""
    n = len(ids)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    kept = counts[inverse] > 1
    inverse, owner = inverse[kept], owner[kept]
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    of = np.searchsorted(owner, np.arange(n + 1))
    links = []
    for x in range(n):
        if side is not None and side[x] == 1:
            continue
        mine = inverse[of[x]:of[x + 1]]
        first, length = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(posting[at], minlength=n)
        near = np.nonzero(100 * both >= percent * (sizes[x] + sizes - both))[0]
        for y in near:
            if (y > x if side is None else side[y] == 1):
                a, b = find(labels[x]), find(labels[y])
                if a != b:
                    parent[b] = a
                    links.append((ids[x], ids[y]))
    return links


def _verify(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
        side = group["side"].to_pylist()
        links = similar(group["class"].to_pylist(), sets, group["label"].to_pylist(), side if side[0] is not None else None, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return verify


def _links(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links found in each group of rows (by, class, label, side, set)."""
    return rows.select(*by, "class", "label", "side", "set").groupBy(*by).applyInArrow(_verify(percent), "a long, b long")


def possibly_in(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` without most of those whose id isn't among ``ids``: the ids
    leave marks, and at most ``MARKS`` marks are broadcast whatever their number."""
    def mark(df):
        return F.pmod(F.xxhash64(df[id_col]), F.lit(MARKS))

    marks = ids.select(mark(ids).alias("mark")).distinct()
    return rows.join(F.broadcast(marks), mark(rows) == F.col("mark"), "left_semi")


def class_sets(df: DataFrame, firsts: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(group, class, set) for ``firsts`` (group, class, doc_id): one document of each class gives the set."""
    schema = pa.schema([("group", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def build(batches):
        for part in slices(batches):
            out = []
            for group, cls, text in zip(*(c.to_pylist() for c in part.columns)):
                s = shingle_hashes(text, k)
                if len(s) and class_of(s) == cls:  # another row may have the same id
                    out.append((group, cls, len(s), s.tobytes()))
            if out:
                yield batch_of(schema, *zip(*out))

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")
    # only texts that may be wanted go to the join
    rows = possibly_in(rows, firsts, "doc_id").join(firsts, "doc_id")
    return rows.select("group", "class", "text").mapInArrow(build, "group long, class long, n long, set binary").dropDuplicates(["class"])


def _large_links(large: DataFrame, sizes: DataFrame, degrees: DataFrame, percent: int) -> DataFrame:
    """All links of candidate groups too large for one task.  ``large``: (group, class, n, set)."""
    at = F.xxhash64("class", F.lit(7))
    rows = large.join(sizes.select("group", "blocks"), "group").withColumn("block", F.pmod(at, F.col("blocks")))
    by_degree = Window.partitionBy("group").orderBy(F.desc("degree"), "class")
    pivots = (rows.join(degrees, "class", "left").select("group", "class", "blocks", F.coalesce("degree", F.lit(0)).alias("degree"))
              .withColumn("rank", F.row_number().over(by_degree)).where(F.col("rank") <= PIVOTS)
              .select("group", "class", "blocks").join(large.select("class", "set"), "class"))
    beside = pivots.select("group", "class", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rounds = (rows.select("group", "block", "class", "set", F.lit(0).alias("side"))
              .unionByName(beside.select("group", "block", "class", "set", F.lit(1).alias("side"))))
    first = stored(_links(rounds.withColumn("label", F.when(F.col("side") == 0, F.col("class"))
                                            .otherwise(F.xxhash64("class", F.lit(1)))), ["group", "block"], percent))
    labels = components(first)
    labelled = (rows.select("group", "class", "set").join(labels, F.col("class") == F.col("node"), "left")
                .select("group", "class", "set", F.coalesce("label", "class").alias("label")))
    parts = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("members"))
    main = parts.groupBy("group").agg(F.max(F.struct("members", "label")).alias("top"), F.sum("members").alias("all"))
    per = F.lit(float(GROUP_CLASSES))
    main = main.select("group", F.col("top.label").alias("top"), F.ceil(F.col("top.members") / per).cast("long").alias("tops"),
                       F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.members")) / per)).cast("long").alias("rests"))
    placed = labelled.join(main, "group")
    rest = placed.where("label <> top").withColumn("own", F.pmod(at, F.col("rests")))
    block = F.col("own")
    inside = rest.select("group", "class", "label", "set", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("other"))
    inside = inside.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "class", "label", "set",
                           F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int")).alias("side"))
    across = rest.select("group", "class", "label", "set", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("tops") - 1)).alias("y"))
    across = across.select("group", "x", (-1 - F.col("y")).alias("y"), "class", "label", "set", F.lit(0).alias("side"))
    tops = placed.where("label = top").withColumn("own", F.pmod(at, F.col("tops")))
    tops = tops.select("group", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("x"), (-1 - F.col("own")).alias("y"),
                       "class", "label", "set", F.lit(1).alias("side"))
    second = _links(inside.unionByName(across).unionByName(tops), ["group", "x", "y"], percent)
    return first.unionByName(second)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links,
    its own included) and kept (it is that id) of every row."""
    signed = stored(signatures(df, id_col, text_col, k))
    linkable = signed.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = linkable.groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"))
    keyed = linkable.join(classes, "class").where("doc_id = first").select("class", "keys").dropDuplicates(["class"])
    edges = stored(candidate_edges(keyed))
    groups = components(edges.select("a", "b"))
    member = groups.select(F.col("label").alias("group"), F.col("node").alias("class")).unionByName(
        groups.select(F.col("label").alias("group"), F.col("label").alias("class")).distinct())
    firsts = stored(member.join(classes, "class").select("group", "class", F.col("first").alias("doc_id")))
    sets = stored(class_sets(df, firsts, id_col, text_col, k))
    sizes = sets.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_CLASSES), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("blocks"))
    whole = sets.join(sizes.where("blocks = 1"), "group", "left_semi").withColumn("label", F.col("class"))
    links = _links(whole.withColumn("side", F.lit(None).cast("int")), ["group"], percent)
    large = stored(sizes.where("blocks > 1"))
    if large.limit(1).count():
        degrees = edges.groupBy(F.col("b").alias("class")).agg(F.sum("degree").alias("degree"))
        links = links.unionByName(_large_links(sets.join(large.select("group"), "group", "left_semi"), large, degrees, percent))
    joined = components(links)
    label = F.coalesce("label", "class")
    labelled = classes.join(joined, F.col("class") == F.col("node"), "left").select("class", "first", label.alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    final = labelled.join(least, "label").select("class", "component_id")
    return (signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
            .join(final, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each group; of rows equal in id and text one stays, rows without id all stay."""
    kept = near_duplicates(df, id_col, text_col, k, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    own = F.col(f"`{id_col}`")
    chosen = df.where(own.isNotNull()).join(kept, own.cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col, text_col])
    return chosen.unionByName(df.where(own.isNull()))
