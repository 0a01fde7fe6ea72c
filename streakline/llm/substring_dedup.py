"""Substring dedup over a compacted De Bruijn graph of words.

The edges are the 50-word windows of the corpus (k-mers of words).  Consecutive
edges that share a minimizer make a nonbranching path; paths with the same content
compact into one through Spark aggregations and joins, which carry the smallest
doc_id that holds the path.  Where several paths share an anchor the graph may
branch inside them; there the single edges are joined.  Source coordinates
(document, first word, number of windows) turn repeated paths and edges into spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import _hashing as hs
from . import _superwindows as sw

WINDOW = 50
ANCHOR = 10


def word_symbols(text: bytes) -> np.ndarray:
    return hs.word_hashes(text.split())


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """((_key, from, to) spans in words that stand in a document with a smaller id, (_key, _id, _text) rows)."""
    rows = sw.keyed(docs, id_col, text_col)
    paths = sw.run_rows(rows.filter("_id IS NOT NULL"), word_symbols, window, anchor)
    compact = paths.groupBy("anchor", "content").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
    groups = compact.groupBy("anchor").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("n_paths")).filter("least < most")
    branch = (F.col("n_paths") > 1).alias("branch")
    # a path matters if a later document repeats it, or if its anchor has several paths
    wanted = c.checkpoint(compact.join(groups, "anchor").filter("first < last OR n_paths > 1").select("anchor", "content", "first", branch))
    hits = c.stored(paths.join(wanted, ["anchor", "content"]).filter("_id > first OR branch").select("_key", "_id", "anchor", "start", "n_windows", (F.col("_id") > F.col("first")).alias("whole")), "path-hits")
    whole = hits.filter("whole").select("_key", F.col("start").alias("from"), (F.col("start") + F.col("n_windows") + (window - 1)).alias("to"))
    # the first copy of a path in a branching group: its edges one by one
    open_paths = hits.filter("NOT whole").select("_key", "anchor", "start", "n_windows").distinct()
    lists = open_paths.groupBy("_key").agg(F.collect_list(F.struct("anchor", "start", "n_windows")).alias("paths"))
    keys = c.checkpoint(open_paths.select("_key").distinct())

    def edges(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index
        own, anchors, hashes, starts = [], [], [], []
        for i, (text, found) in enumerate(zip(part.column(at("_text")).to_pylist(), part.column(at("paths")).to_pylist(), strict=True)):
            h = word_symbols(text)
            for p in found:
                a, n = p["start"], p["n_windows"]
                w = hs.window_hashes(h[a : a + n + window - 1], window)
                own.append(np.full(n, i))
                anchors.append(np.full(n, p["anchor"], np.int64))
                hashes.append(w.view(np.int64))
                starts.append(np.arange(a, a + n, dtype=np.int32))
        if not own:
            return None
        owner = pa.array(np.concatenate(own))
        return pa.RecordBatch.from_arrays([part.column(at("_key")).take(owner), part.column(at("_id")).take(owner), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(starts))], names=["_key", "_id", "anchor", "edge", "start"])

    picked = sw.pick_texts(rows.filter("_id IS NOT NULL"), lists, keys, keys.count())
    single = c.stored(c.map_arrow(picked, edges, f"_key binary, _id {sw.id_kind(rows)}, anchor long, edge long, start int"), "branch-edges")
    least = single.groupBy("anchor", "edge").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).filter("least < most")
    again = single.join(least, ["anchor", "edge"]).filter("_id > least").select("_key", F.col("start").alias("from"), (F.col("start") + window).alias("to"))
    return whole.unionByName(again), rows


FIELDS = "_id {}, n_words long, n_removed long, n_spans long, kept binary"


def _cut(with_spans: bool, digest: bool):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index
        texts = part.column(at("_text")).to_pylist()
        lists = part.column(at("spans")).to_pylist() if with_spans else [()] * len(texts)
        words, removed, n_spans, kept = [], [], [], []
        for text, spans in zip(texts, lists, strict=True):
            w = text.split()
            merged = sw.merge_spans([(s["from"], s["to"]) for s in spans or ()])
            parts, a = [], 0
            for b, e in merged:
                parts += w[a:b]
                a = e
            parts += w[a:]
            out = b" ".join(parts)
            words.append(len(w))
            removed.append(len(w) - len(parts))
            n_spans.append(len(merged))
            kept.append(hashlib.sha256(out).hexdigest().encode() if digest else out)
        return pa.RecordBatch.from_arrays([part.column(at("_id")), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "n_words", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, n_spans, kept): one row per row of ``docs``; kept is the text of the words that stay, joined by one space, or its SHA-256 in hex.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.  Windows are judged on
    the input.  Null and empty texts have no words; rows with a null id keep all and remove from none; rows with equal ids do not
    remove from each other.  Other columns are not read."""
    spans, rows = repeated_spans(docs, id_col, text_col, window, anchor)
    lists = c.stored(sw.span_lists(spans), "repeated-spans")
    keys = c.checkpoint(lists.select("_key"))
    n = keys.count()
    cut = c.map_arrow(sw.pick_texts(rows, lists, keys, n), _cut(True, digest), FIELDS.format(sw.id_kind(rows)))
    rest = c.map_arrow(sw.others(rows, keys, n), _cut(False, digest), FIELDS.format(sw.id_kind(rows)))
    out = cut.unionByName(rest)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))


def op2_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_spans(docs, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, p + o AS q FROM (SELECT win.doc_id, win.p FROM win JOIN least USING (g) WHERE win.doc_id > least.m), range(0, 50) r(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) FILTER (WHERE hit.q IS NULL) AS t, count(hit.q) AS n
  FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.q = words.q GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
