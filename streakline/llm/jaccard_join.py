"""N-gram Jaccard join over count-vector R-trees.

A document's set is its distinct word shingles.  Equal sets are one class.  The
shingles are hashed into groups; a class's counts by group are a point in an
R-tree, where the overlap of two sets is at most the sum of the coordinate minima,
and of a set with a node at most that with the node's upper corner.  Pairs that
survive this bound are verified on the sets themselves.

Trees stay small because classes meet in one tree only when their sketches can:
a sketch is the ``SKETCH`` least hashes of a set, and of two sets with a
similarity of 0.8 the sketches share at least ``SHARED`` entries, but for a chance
under 1e-11 that is of the order of hash collisions.  So some entry is shared
among the len - SHARED + 1 rarest of each (prefix filter by corpus frequency).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c
from . import _hashing as hs
from ._components import UnionFind, connected_components

WORDS = 5
GROUPS = 64
SKETCH, SHARED = 48, 17
#: Members of a tree; larger connected sets of candidates are dealt to trees over pairs of units of one or neighbouring sizes.
TREE_ROWS = 1500
#: Documents with candidates whose ids (8 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words than ``n``, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hs.word_hashes(words)
    with np.errstate(over="ignore"):
        if len(words) < n:
            return hs.mix(hs.roll(h, len(words)) + np.uint64(len(words)))
        return np.unique(hs.window_hashes(h, n))


def shared_at_least(n: int) -> int:
    """Least number of sketch entries that a set of ``n`` shares with a similar one."""
    return SHARED if n > 0.8 * SKETCH else math.ceil(0.8 * n)


def class_hash(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def similar(a: int, b: int, both: int, percent: int = 80) -> bool:
    return 100 * both >= percent * (a + b - both)


class CountRTree:
    """R-tree over count vectors, packed by size; nodes hold their upper corner and least size."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], sizes)) if len(sizes) else np.empty(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: upper corners, least and largest size
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > self.FAN:
            cuts = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, percent: int = 80) -> np.ndarray:
        """Entries whose bound on the overlap with (point, size) lets them be similar."""

        def alive(top, low, high, at):
            bound = np.minimum(top[at], point).sum(1)
            # 100 I >= p (a + b - I); a set of b has I <= min(a, b)
            fits = (100 + percent) * np.minimum(bound, np.minimum(high[at], size)) >= percent * (low[at] + size)
            return at[fits & (100 * high[at] >= percent * size) & (percent * low[at] <= 100 * size)]

        at = None
        for top, low, high in reversed(self.levels):
            at = np.arange(len(top)) if at is None else self._children(at, len(top))
            at = alive(top, low, high, at)
        at = np.arange(len(self.points)) if at is None else self._children(at, len(self.points))
        return self.order[alive(self.points, self.sizes, self.sizes, at)] if len(at) else at

    def _children(self, at: np.ndarray, n: int) -> np.ndarray:
        found = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        return found[found < n]


def join_members(ids: np.ndarray, sets: list[np.ndarray], units: np.ndarray | None = None, percent: int = 80) -> list[tuple[int, int]]:
    """Links that connect all members with similar sets; with ``units``, only pairs across units are compared.

    Members that are connected already need no further verified link: components do not change by it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.zeros((len(sets), GROUPS), np.int64)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    tree, uf, links = CountRTree(points, sizes), UnionFind(), []
    for i in range(len(sets)):
        for j in tree.search(points[i], int(sizes[i]), percent).tolist():
            if j <= i or (units is not None and units[i] == units[j]):
                continue
            a, b = int(ids[i]), int(ids[j])
            if uf.find(a) == uf.find(b):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if similar(int(sizes[i]), int(sizes[j]), both, percent):
                uf.union(a, b)
                links.append((a, b))
    return links


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, cls, sketch): set size, class hash, and the least hashes, once per class and slice (else null)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n, cls, sketch, seen = [], [], [], set()
        for text in part.column(1).to_pylist():
            s = shingle_set(text)
            k = class_hash(s)
            n.append(len(s))
            cls.append(k)
            sketch.append(None if k in seen or not len(s) else s[:SKETCH].view(np.int64))
            seen.add(k)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["_id", "n", "cls", "sketch"])

    src = docs.select(F.col(id_col).cast("long").alias("_id"), c.utf8(text_col).alias("_text"))
    return c.map_arrow(src, run, "_id long, n long, cls long, sketch array<long>")


def _candidates(classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): links of reps whose sketches share an entry of both prefixes; a star for each entry."""
    entries = sketches.select("n", "cls", F.explode("sketch").alias("sig")).distinct()
    frequency = entries.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    shared = entries.join(frequency, "sig")
    kept = F.least(F.col("n"), F.lit(SKETCH))
    need = F.when(F.col("n") > 0.8 * SKETCH, F.lit(SHARED)).otherwise(F.ceil(F.col("n") * 4 / 5))
    per_class = Window.partitionBy("cls", "n")
    # entries of one class only stand before these in the order, and so use up the prefix
    alone = kept - F.count("*").over(per_class)
    place = F.row_number().over(per_class.orderBy("df", "sig"))
    prefix = shared.withColumn("place", place + alone).filter(F.col("place") <= kept - need + 1)
    members = prefix.join(classes.select("cls", "n", "rep"), ["cls", "n"]).select("sig", "rep")
    centre = members.groupBy("sig").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).filter("centre < other").select("sig", "centre")
    return members.join(centre, "sig").filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"))


def _texts_of(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, broadcast_ids: int) -> DataFrame:
    """(rep, comp, n, _text) of the members: their ids go to the texts where they are few enough, else both are shuffled."""
    few = members.count() <= broadcast_ids
    src = docs.select(F.col(id_col).cast("long").alias("rep"), c.utf8(text_col).alias("_text"))
    return src.join(F.broadcast(members) if few else members, "rep")


def _verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int, tree_rows: int, broadcast_ids: int) -> DataFrame:
    """(a, b): verified links among members (rep, comp, n) of each connected set of candidates."""
    spark = docs.sparkSession
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.25))).cast("long")
    members = members.withColumn("band", band)
    sizes = members.groupBy("comp").agg(F.count("*").alias("n_comp"))
    units = members.groupBy("comp", "band").agg(F.count("*").alias("n_band")).join(sizes.filter(F.col("n_comp") > tree_rows), "comp").select("comp", "band", F.ceil(F.col("n_band") / F.lit(tree_rows)).cast("long").alias("chunks"))
    placed = members.join(units, ["comp", "band"], "left").withColumn("chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("chunks"))))
    small = placed.filter("chunks IS NULL").select("rep", "comp", F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    million = 1_000_000
    near = placed.filter("chunks IS NOT NULL").select("rep", "comp", (F.col("band") * million + F.col("chunk")).alias("unit"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    others = near.join(units, ["comp", "band"]).select("rep", "comp", "unit", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.col("band") * million + x)).alias("other"))
    dealt = small.unionByName(others.select("rep", "comp", "unit", F.least("unit", "other").alias("lo"), F.greatest("unit", "other").alias("hi")))

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index
        made = pa.array([shingle_set(t).tobytes() for t in part.column(at("_text")).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([part.column(at("rep")), made], names=["rep", "shingles"])

    texts = _texts_of(docs, members.select("rep"), id_col, text_col, broadcast_ids)
    whole = c.map_arrow(texts, sets, "rep long, shingles binary")
    rows = whole.join(dealt, "rep").repartition(c.shuffle_partitions(spark), "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "rep")

    def search(batches):
        key, ids, found, units = None, [], [], []

        def flush():
            if len(ids) < 2:
                return []
            return join_members(np.array(ids), found, np.array(units) if key[1] != key[2] else None, percent)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("comp", "lo", "hi", "rep", "unit", "shingles")]
            links = []
            for comp, lo, hi, rep, unit, raw in zip(*cols, strict=True):
                if (comp, lo, hi) != key:
                    links += flush()
                    key, ids, found, units = (comp, lo, hi), [], [], []
                if ids and ids[-1] == rep:
                    continue  # a repeated row
                ids.append(rep)
                found.append(np.frombuffer(raw, np.uint64))
                units.append(unit)
            yield _links(links)
        yield _links(flush())

    return rows.mapInArrow(search, "a long, b long")


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, tree_rows: int = TREE_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``.

    Two documents link when 100 * |A and B| >= percent * |A or B|, for a percent of 80 or more.  Null texts and texts
    without words have no shingle and link with nothing; rows with a null id link with nothing and have a null component.
    Rows that repeat an id count as that document, whose texts all link.  Other columns are not read."""
    if percent < 80:
        raise ValueError("the sketches are made for a similarity of 0.8 or more")
    features = c.stored(_features(docs, id_col, text_col), "shingle-features")
    linked = features.filter("_id IS NOT NULL AND n > 0")
    classes = linked.groupBy("cls", "n").agg(F.min("_id").alias("rep"))
    classes = c.checkpoint(classes)
    sketches = features.filter("sketch IS NOT NULL").select("n", "cls", "sketch")
    edges = c.checkpoint(_candidates(classes, sketches).distinct())
    comps = connected_components(edges)
    members = comps.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    members = members.unionByName(members.select(F.col("comp").alias("rep"), "comp").distinct())
    sized = c.checkpoint(members.join(classes.groupBy("rep").agg(F.max("n").alias("n")), "rep"))
    links = c.stored(_verified(docs, sized, id_col, text_col, percent, tree_rows, broadcast_ids), "jaccard-links")
    final = connected_components(links)
    by_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("cls", "n", F.coalesce("component", "rep").alias("comp"))
    out = features.select("_id", "n", "cls").join(by_class, ["cls", "n"], "left")
    comp = F.when(F.col("_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), comp.cast("long").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(c.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT *, least(len(w), 5) AS m FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.c)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
