"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is padded to a power of two, turned by three rounds of random signs and
Walsh-Hadamard transforms, and hashed to the nearest signed axis; ``n_hashes``
such hashes make a bucket code in each of ``n_tables`` tables.  A vector stands in
its own bucket and in ``n_probes`` next-best ones.  Pairs that share a bucket, of
at least one's own, are verified by the cosine in double precision.  Hashes are as
many as make chance meetings rare, and tables as many as keep the recall, so that
codes alone tell which vectors have to meet and only those are fetched.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from ._components import connected_components

#: Rows of a bucket that one task compares at once; larger buckets are dealt to blocks of pairs of chunks.
BLOCK_ROWS = 2048
#: Vectors that a bucket of the largest label holds by chance.
TARGET_BUCKET = 0.125
#: Recall for pairs at the threshold that the number of tables is chosen for, on so many simulated pairs.
RECALL, PAIRS = 0.985, 300


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotation_signs(seed: int, table: int, k: int, width: int) -> np.ndarray:
    return np.random.default_rng((seed, table, k, width)).choice((-1.0, 1.0), (3, width))


def codes(x: np.ndarray, n_tables: int, n_hashes: int, n_probes: int, seed: int, first: int = 0) -> np.ndarray:
    """(rows, tables, 1 + probes) int64 bucket codes: one's own first, then the next best by the loss in the rotated coordinates."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    out = np.empty((n, n_tables, 1 + n_probes), np.int64)
    for t in range(n_tables):
        own = np.zeros(n, np.int64)
        losses, swaps = [], []
        for k in range(n_hashes):
            y = padded
            for signs in rotation_signs(seed, first + t, k, width):
                y = hadamard(y * signs)
            size = np.abs(y)
            top = np.argpartition(-size, min(n_probes, width - 1), axis=1)[:, : n_probes + 1]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            axis = top + width * (np.take_along_axis(y, top, 1) < 0)
            scale = np.int64(pow(2 * width, k, 1 << 63))
            own += axis[:, 0] * scale
            best = np.take_along_axis(size, top, 1)
            for j in range(1, top.shape[1]):
                losses.append(best[:, 0] - best[:, j])
                swaps.append((axis[:, j] - axis[:, 0]) * scale)
        out[:, t, 0] = own
        if n_probes:
            order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, :n_probes]
            out[:, t, 1:] = own[:, None] + np.take_along_axis(np.stack(swaps, 1), order, 1)
    return out


def tables_for(width: int, n_hashes: int, n_probes: int, threshold: float, seed: int, least: int = 5, most: int = 40) -> int:
    """Tables in which random pairs of vectors at the threshold's cosine meet with the recall that is asked for."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, PAIRS, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= a * np.einsum("ij,ij->i", a, b)[:, None]
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    met = np.zeros(PAIRS, bool)
    for t in range(most):
        x, y = (codes(v, 1, n_hashes, n_probes, seed, t)[:, 0] for v in (a, b))
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
        if t + 1 >= least and met.mean() >= RECALL:
            return t + 1
    return most


def packed(x: np.ndarray) -> bytes:
    """A vector as bytes: single precision where that says the same, else double; the first byte tells which."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return b"s" + single.tobytes() if np.array_equal(single.astype(np.float64), x) else b"d" + x.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"s" else np.float64, offset=1).astype(np.float64)


def linked(x: np.ndarray, ids: np.ndarray, code: np.ndarray, own: np.ndarray, part: np.ndarray, split: bool, table: int, bucket: int, threshold: float):
    """Index pairs (i, j) of a block's rows with cosine >= threshold that this bucket is the first to hold.

    ``own``: whether this is a row's own bucket; ``part``: the chunk of a row in a split block, whose pairs go across chunks."""
    n = len(ids)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norm[:, None]
    step = 512
    out_i, out_j = [], []
    for a in range(0, n, step):
        s = unit[a : a + step] @ unit[a:].T
        i, j = np.nonzero(s >= threshold - 1e-9)
        near = s[i, j]
        i, j = i + a, j + a
        keep = (i < j) & (own[i] | own[j]) & (ids[i] != ids[j])
        if split:
            keep &= part[i] != part[j]
        i, j, near = i[keep], j[keep], near[keep]
        doubt = np.abs(near - threshold) < 1e-9
        if doubt.any():
            di, dj = i[doubt], j[doubt]
            near[doubt] = np.einsum("ij,ij->i", x[di], x[dj]) / (norm[di] * norm[dj])
        i, j = i[near >= threshold], j[near >= threshold]
        if len(i):
            first = _first_bucket(code[i], code[j], table, bucket)
            out_i.append(i[first])
            out_j.append(j[first])
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _first_bucket(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether (table, bucket) is the least that the rows of ``a`` and ``b`` share, of at least one's own."""
    big = np.iinfo(np.int64).max
    in_b = (a[:, :, :1] == b).any(2)  # a's own bucket is one of b's
    in_a = (b[:, :, :1] == a).any(2)
    least = np.minimum(np.where(in_b, a[:, :, 0], big), np.where(in_a, b[:, :, 0], big))
    earlier = (least[:, :table] != big).any(1)
    return ~earlier & (least[:, table] == bucket)


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(_id, _label, digest, vec): digest and vec are null where a row links with nothing."""

    def run(batches):
        for batch in batches:
            digests, held = [], []
            for v, label, key in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                raw = None
                if v is not None and label is not None and key is not None and len(v) and None not in v:
                    x = np.asarray(v, np.float64)
                    if np.isfinite(x).all():
                        top = np.abs(x).max()
                        if top > 0:
                            raw = packed(x if 1e-100 < top < 1e100 else x / top)
                held.append(raw)
                digests.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(held, pa.binary())], names=["_id", "_label", "digest", "vec"])

    src = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vec_col).alias("_vec"))
    return src.mapInArrow(run, "_id long, _label string, digest binary, vec binary")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    n_tables: int | None = None,
    n_hashes: int | None = None,
    n_probes: int = 1,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows with a null id or label, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; so do vectors of different length.  Copies of a vector
    are one class with a count, linked with each other.  Rows that repeat an id are vectors of
    their own.  Other columns are not read; an empty table gives an empty result.  ``n_hashes`` follows the number and width of
    the vectors (chance meetings are rare), and ``n_tables`` the recall (``RECALL`` at the threshold), unless given."""
    spark = vectors.sparkSession
    rows = _classes(vectors, id_col, vec_col, label_col)
    keyed = rows.filter("digest IS NOT NULL")
    unique = keyed.groupBy("_label", "digest").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec"))
    classes = c.stored(unique.withColumn("width", F.floor((F.octet_length("vec") - 1) / F.when(F.expr("substring(vec, 1, 1) = X'73'"), 4).otherwise(8)).cast("int")), "vector-classes")
    # the largest label and the widest vector set how fine buckets have to be, and how many tables
    top, width = classes.groupBy("_label").agg(F.count("*").alias("n"), F.max("width").alias("w")).agg(F.max("n"), F.max("w")).first()
    if n_hashes is None:
        axes = 2 * max(2, 1 << ((width or 1) - 1).bit_length())
        n_hashes = max(1, min(6, math.ceil(math.log(max(1.0, (top or 1) / TARGET_BUCKET)) / math.log(axes))))
    if n_tables is None:
        n_tables = tables_for(width or 1, n_hashes, n_probes, threshold, seed)
    each = 1 + n_probes

    def hash_rows(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            raw = col["vec"].to_pylist()
            sizes = np.asarray(col["width"])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.stack([unpacked(raw[i]) for i in at])
                made = codes(x / np.abs(x).max(1, keepdims=True), n_tables, n_hashes, n_probes, seed)
                pick = pa.array(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (n_tables * each)), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(col[k].take(pick) for k in ("_label", "digest", "width")), lists], names=["_label", "digest", "width", "codes"])
        c.tidy()

    key = ["_label", "width", "tab", "bucket"]
    coded = classes.select("_label", "digest", "width", "vec").mapInArrow(hash_rows, "_label string, digest binary, width int, codes array<long>")
    coded = c.stored(coded, "vector-codes")
    at = F.posexplode("codes").alias("at", "bucket")
    placed = coded.select("_label", "width", "digest", at).select("_label", "width", F.floor(F.col("at") / each).cast("int").alias("tab"), "bucket", (F.col("at") % each == 0).alias("own"), "digest")
    # sizes of buckets; those of one row have no pair, those over a block are dealt to blocks of pairs of chunks
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).filter("n > 1 AND n_own > 0")
    sizes = sizes.select(*key, F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("digest", F.lit(11)), F.col("chunks").cast("long")).cast("int")
    meet = placed.join(sizes, key).withColumn("part", chunk)
    # only vectors that meet others are fetched, with their codes
    whole = classes.select("_label", "digest", "rep", "copies", "vec").join(coded.select("_label", "digest", "codes"), ["_label", "digest"])
    dealt = meet.join(whole, ["_label", "digest"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).select(*key, "lo", "hi", "part", "own", "rep", "copies", "vec", "codes")
    n_parts = c.shuffle_partitions(spark)
    blocks = dealt.repartition(n_parts, *key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi")

    def compare(batches):
        pending: list[pa.RecordBatch] = []
        current = None

        def block_key(b: pa.RecordBatch, i: int):
            return tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in (*key, "lo", "hi"))

        def flush():
            if not pending or sum(b.num_rows for b in pending) < 2:
                return None
            t = pa.Table.from_batches(pending).combine_chunks()
            get = lambda n: t.column(n).to_numpy(zero_copy_only=False)
            x = np.stack([unpacked(v) for v in t.column("vec").to_pylist()])
            code = np.array(t.column("codes").to_pylist(), np.int64).reshape(t.num_rows, n_tables, -1)
            ids, copies = get("rep"), get("copies")
            i, j = linked(x, ids, code, get("own").astype(bool), get("part"), current[4] != current[5], current[2], current[3], threshold)
            if not len(i):
                return None
            links = np.bincount(i, copies[j], t.num_rows) + np.bincount(j, copies[i], t.num_rows)
            root = ids.copy()
            while True:  # the least id over links, to rest
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                if (low == root).all():
                    break
                root = low
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], names=["rep", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in (*key, "lo", "hi")]
            change = np.zeros(batch.num_rows, bool)
            for col in cols:
                v = col.to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                k = block_key(batch, a)
                if k != current:
                    if (out := flush()) is not None:
                        yield out
                    pending, current = [], k
                pending.append(batch.slice(a, b - a))
        if (out := flush()) is not None:
            yield out

    found = c.stored(blocks.mapInArrow(compare, "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select("rep", "root"))
    per_class = (
        classes.select("_label", "digest", "rep", "copies")
        .join(links, "rep", "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("_label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("_id", "_label", "digest").join(per_class, ["_label", "digest"], "left")
    comp = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("_id"), F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.c),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""
