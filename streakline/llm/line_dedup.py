"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Runs are Parquet tables of (line_hash, n_docs, fresh), sorted by hash.  Each batch
of documents is counted, merge-anti-joined with the runs that exist, and added as
a run of level 0; when a level holds ``fanout`` runs they are compacted into one
run of the next level.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

HASH_BYTES = 16
#: Hot keys up to this number (16 bytes each) are broadcast to the executors; above, a join marks them.
BROADCAST_KEYS = 500_000


def line_key(line: bytes) -> bytes:
    return line.strip(c.WS_BYTES).lower()  # bytes.lower() changes A-Z alone


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=HASH_BYTES).digest()


def _n_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def document_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 1, n_batches: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(batch, line_hash, n_docs): keys with the number of rows that hold them, added up per task and slice.

    A key counts once in a row however often it stands there.  Rows are the
    documents: repeated rows count each.  Null and empty texts have one empty line,
    whose key has no code point and so never counts."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[int, bytes], int] = {}
        for batch, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            keys = {line_key(x) for x in text.split(b"\n")}
            for k in keys:
                if k and (min_chars <= 1 or _n_points(k) >= min_chars):
                    h = (batch, key_hash(k))
                    found[h] = found.get(h, 0) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in found], pa.int32()), pa.array([h for _, h in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
            names=["batch", "line_hash", "n_docs"],
        )

    batch = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(n_batches)).cast("int")
    return c.map_arrow(docs.select(batch.alias("batch"), c.utf8(text_col).alias("_text")), count, "batch int, line_hash binary, n_docs long")


class LineRuns:
    """Levelled sorted runs in ``path``; the manifest of levels is kept by the driver (paths only)."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.path = path or c.scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self._made = 0

    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        to = f"{self.path}/L{level}-{self._made}"
        self._made += 1
        df.sortWithinPartitions("line_hash").write.option("compression", "zstd").parquet(to)
        self.levels[level].append(to)

    def rows(self) -> DataFrame | None:
        """All runs' rows; a hash may stand in several runs."""
        paths = self._paths()
        return self.spark.read.parquet(*paths) if paths else None

    def unseen(self, counts: DataFrame) -> DataFrame:
        """The batch's keys that no run holds: the merge anti-join."""
        old = self.rows()
        return counts if old is None else counts.join(old.select("line_hash"), "line_hash", "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (line_hash, n_docs), one row per hash, as a run of level 0."""
        old = self.rows()
        if old is None:
            marked = counts.withColumn("fresh", F.lit(True))
        else:
            known = old.filter("fresh").select("line_hash")  # each hash is fresh in exactly one run
            marked = counts.join(known, "line_hash", "left_anti").withColumn("fresh", F.lit(True)).unionByName(
                counts.join(known, "line_hash", "left_semi").withColumn("fresh", F.lit(False))
            )
        self._write(marked.select("line_hash", "n_docs", "fresh"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        paths = self.levels[level]
        merged = self.spark.read.parquet(*paths).groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs"), F.bool_or("fresh").alias("fresh"))
        self._write(merged, level + 1)
        self.levels[level] = []
        for p in paths:
            c.remove_path(self.spark, p)

    def counts(self, min_docs: int = 1) -> DataFrame:
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], "line_hash binary, n_docs long")
        return rows.groupBy("line_hash").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def fill_runs(docs: DataFrame, runs: LineRuns, text_col: str = "text", min_chars: int = 1, n_batches: int = 4, id_col: str = "doc_id") -> LineRuns:
    """Feed the documents to the runs in ``n_batches`` arrivals; the texts are read once."""
    lines = document_lines(docs, text_col, min_chars, n_batches, id_col).groupBy("batch", "line_hash").agg(F.sum("n_docs").alias("n_docs"))
    path = c.scratch_path(docs.sparkSession, "line-batches")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    spark = docs.sparkSession
    stored = spark.read.schema("line_hash binary, n_docs long, batch int").parquet(path)
    for b in range(n_batches):
        runs.add(stored.filter(F.col("batch") == b).select("line_hash", "n_docs"))
    c.remove_path(spark, path)
    return runs


OUT = [("n_lines", "long"), ("n_dropped", "long")]


def _drop(texts: list[bytes | None], hot_of) -> dict[str, pa.Array]:
    n_lines, n_dropped, kept = [], [], []
    for i, text in enumerate(texts):
        lines = (text or b"").split(b"\n")
        hot = hot_of(i)
        stay = [x for x in lines if not hot or not (k := line_key(x)) or key_hash(k) not in hot]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        kept.append(text if len(stay) == len(lines) else b"\n".join(stay))
    return {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": kept}


def drop_common_lines(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_docs: int = 10,
    min_chars: int = 1,
    n_batches: int = 4,
    broadcast_keys: int = BROADCAST_KEYS,
    runs: LineRuns | None = None,
) -> DataFrame:
    """All columns of ``docs`` with the text rid of lines whose key stands in ``min_docs`` documents or more, plus n_lines and n_dropped.

    Null texts stay null (one empty line); empty texts stay empty; every row counts
    as a document, repeated ids included; columns named n_lines or n_dropped are
    replaced; other extra columns pass through.  Lines are dropped in every row,
    whatever its size.  ``runs`` may hold earlier corpora: their counts then add to
    these."""
    spark = docs.sparkSession
    runs = fill_runs(docs, runs or LineRuns(spark), text_col, min_chars, n_batches, id_col)
    hot = c.checkpoint(runs.counts(min_docs).select("line_hash"))
    order = docs.columns
    n_hot = hot.count()
    if n_hot <= broadcast_keys:
        keys = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in hot.toLocalIterator()))

        def apply(texts: list[bytes | None]) -> dict[str, pa.Array]:
            made = _drop(texts, lambda _: keys.value)
            return made | {text_col: pa.array(made["kept"], pa.binary()).cast(pa.string())}

        out = c.with_columns_arrow(docs, text_col, apply, [*OUT, (text_col, "string")])
    else:
        out = _drop_by_join(docs, hot, text_col)
    return out.select(*[F.col(f"`{x}`") for x in order if x not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _drop_by_join(docs: DataFrame, hot: DataFrame, text_col: str) -> DataFrame:
    """For hot keys too many to broadcast: (text digest, line hash) rows meet the hot keys, and the list of a text's own hot lines meets the rows."""

    def explode(part: pa.RecordBatch) -> pa.RecordBatch:
        digests, hashes = [], []
        for text in part.column(0).to_pylist():
            d = key_hash(text)
            for k in {line_key(x) for x in text.split(b"\n")} - {b""}:
                digests.append(d)
                hashes.append(key_hash(k))
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())], names=["_digest", "line_hash"])

    lines = c.map_arrow(docs.select(c.utf8(text_col).alias("_text")), explode, "_digest binary, line_hash binary").distinct()
    lists = lines.join(hot, "line_hash", "left_semi").groupBy("_digest").agg(F.collect_list("line_hash").alias("_hot"))

    def digest(texts: list[bytes | None]) -> dict[str, pa.Array]:
        return {"_digest": pa.array([key_hash(x or b"") for x in texts], pa.binary())}

    keyed = c.with_columns_arrow(docs, text_col, digest, [("_digest", "binary")]).join(lists, "_digest", "left").drop("_digest")
    names = [x for x in docs.columns if x not in ("n_lines", "n_dropped", text_col)]
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    src = keyed.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{text_col}`").cast("binary").alias("_src_text"), "_hot")

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "_src_text"):
                n = len(names)
                hots = [frozenset(x or ()) for x in part.column(n + 1).to_pylist()]
                made = _drop(part.column(n).to_pylist(), hots.__getitem__)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(made["kept"], pa.binary()).cast(pa.string()), made["n_lines"], made["n_dropped"]], names=[*names, text_col, "n_lines", "n_dropped"])

    return src.mapInArrow(run, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(c.utf8("text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE hot.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key
GROUP BY doc_id
"""
