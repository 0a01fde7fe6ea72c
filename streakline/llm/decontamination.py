"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton holds the words of a block of items; each document's words are
streamed through it while the longest match that ends at each word is tracked.
A match of ``window`` words (or a whole item that is shorter) marks its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WINDOW = 10
#: Item words in one automaton (some 100 bytes each on an executor), and automata that one pass over the documents uses.
BLOCK_WORDS = 400_000
BLOCKS_PER_PASS = 4

#: Bytes of words: 0-9, a-z and all of multi-byte characters; A-Z are lower-cased; the rest separates.
_FOLD = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for key, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            sequences.append((key, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        n = len(self.next)
        self.items: list[list[str]] = [[] for _ in range(n)]
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        mark = [-1] * n
        lengths = set()
        for number, (key, ids) in enumerate(sequences):
            if not ids:
                continue
            lengths.add(min(window, len(ids)))
            state = 0
            for w in ids:
                state = self.next[state][w]
                v = state
                while v > 0 and mark[v] != number:
                    mark[v] = number
                    if key is not None and self.length[v] >= window:
                        self.items[v].append(key)
                    v = self.link[v]
            if len(ids) < window:
                self.short[state].append((len(ids), key))
        self.least = min(lengths, default=0)
        self.up = [-1] * n  # the nearest state on the way of suffix links that ends a short item
        for v in sorted(range(1, n), key=self.length.__getitem__):
            p = self.link[v]
            self.up[v] = p if p > 0 and self.short[p] else self.up[p] if p > 0 else -1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, nxt: dict[int, int], link: int = 0) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Set ``hit`` for words inside occurrences of windows; add the items of those windows to ``found``.

        A word that no item has resets the automaton, so only runs of known words of the least window's length are walked."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if self.least and end - start >= self.least:
                self._walk(ids[start:end].tolist(), start, hit, found)

    def _walk(self, ids: list[int], base: int, hit: np.ndarray, found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state, matched = 0, 0
        for i, w in enumerate(ids):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                v = state
                while length[link[v]] >= window:
                    v = link[v]
                hit[base + i + 1 - window : base + i + 1] = True
                found.update(self.items[v])
            v = state
            while v > 0:
                for m, key in self.short[v]:
                    if m <= matched:
                        hit[base + i + 1 - m : base + i + 1] = True
                        if key is not None:
                            found.add(key)
                v = self.up[v]


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Automata of the items in blocks of at most ``block_words`` words (one longer item makes its own block)."""
    block, total = [], 0
    for key, text in benchmark.select(F.col(item_col).cast("string"), c.utf8(text_col)).toLocalIterator():
        words = words_of(bytes(text))
        if block and total + len(words) > block_words:
            yield SuffixAutomaton(block, window)
            block, total = [], 0
        if words:
            block.append((key, words))
            total += len(words)
    if block:
        yield SuffixAutomaton(block, window)


_BYTE_WORD = None


def cut_spans(text: bytes, hit: np.ndarray, min_span: int) -> bytes:
    """The text without its runs of ``min_span`` hit words or more, from a run's first byte to its last."""
    import re

    global _BYTE_WORD
    _BYTE_WORD = _BYTE_WORD or re.compile(rb"[^\x20]+")
    spans = [m.span() for m in _BYTE_WORD.finditer(text.translate(_FOLD))]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    parts, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= min_span:
            parts.append(text[at : spans[a][0]])
            at = spans[b - 1][1]
    return b"".join([*parts, text[at:]])


FIELDS = [("n_words", "long"), ("n_hit", "long"), ("item_ids", "array<string>"), ("_hit", "binary")]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    cut: bool = False,
    min_span: int = 1,
) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, item_ids (sorted strings).

    With ``cut`` the text column holds the text without hit runs of ``min_span`` words or more (a null text stays null).
    Null or empty texts have no words; items without words have no window; an item
    whose id is null marks words but is not listed; repeated rows are rows of their
    own; input columns with the names of outputs are replaced.  An empty benchmark
    marks nothing.  The benchmark is the stated query set: it comes to the driver
    block by block, and each pass over the documents holds at most
    ``BLOCKS_PER_PASS`` automata."""
    spark = docs.sparkSession
    out, first, blocks = docs, True, []

    def one_pass(df: DataFrame, shared: list, first: bool, cut: bool = False) -> DataFrame:
        src = df if first else df.withColumn("_before_hit", F.col("_hit")).withColumn("_before_ids", F.col("item_ids"))
        names = {n for n, _ in FIELDS}
        keep = [x for x in src.columns if x not in names and not x.startswith("_before_")]
        sel = [F.col(f"`{x}`") for x in keep]
        before = [] if first else [F.col("_before_hit"), F.col("_before_ids")]
        base = src.select(*sel, F.col(f"`{text_col}`").cast("string").cast("binary").alias("_src_text"), *before)
        from pyspark.sql import types as T

        schema = T.StructType([f for f in base.schema.fields if f.name in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in FIELDS])
        n_keep = len(keep)

        def run(batches):
            c.kept("decontamination")
            for batch in batches:
                for part in c.slices(batch, "_src_text"):
                    texts = part.column(n_keep).to_pylist()
                    counts, hits, ids, masks, new = [], [], [], [], []
                    for i, text in enumerate(texts):
                        words = words_of(text)
                        hit, found = np.zeros(len(words), bool), set()
                        if not first:
                            hit |= np.unpackbits(np.frombuffer(part.column(n_keep + 1)[i].as_py(), np.uint8), count=len(words)).astype(bool)
                            found.update(part.column(n_keep + 2)[i].as_py())
                        for b in shared:
                            b.value.scan(words, hit, found)
                        counts.append(len(words))
                        hits.append(int(hit.sum()))
                        ids.append(sorted(found))
                        masks.append(np.packbits(hit).tobytes())
                        if cut:
                            new.append(cut_spans(text, hit, min_span) if hit.any() else text)
                    made = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(masks, pa.binary())]
                    kept = [part.column(i) for i in range(n_keep)]
                    if cut:
                        kept[keep.index(text_col)] = pa.array(new, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *names_in_order])
            batch = part = texts = hits = masks = new = made = kept = None
            c.tidy()

        names_in_order = [n for n, _ in FIELDS]
        return base.mapInArrow(run, schema)

    for automaton in automata(benchmark, item_col, item_text_col, window, block_words):
        blocks.append(spark.sparkContext.broadcast(automaton))
        if len(blocks) == BLOCKS_PER_PASS:
            out, first, blocks = c.checkpoint(one_pass(out, blocks, first)), False, []
    if blocks or first or cut:  # the cut belongs to the last pass: a step of its own would hold a second Python worker for each task
        out = one_pass(out, blocks, first, cut)
    return out.drop("_hit")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, **kwargs) -> DataFrame:
    """Documents without benchmark passages: runs of ``min_span`` hit words or more are cut out of the text, and documents
    of which more than ``max_coverage`` of the words are hit go altogether.  Columns as in ``docs``; clean rows are unchanged."""
    marked = mark_contamination(docs, benchmark, text_col, window=window, cut=True, min_span=min_span, **kwargs)
    return marked.filter(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")).select(*[F.col(f"`{x}`") for x in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, c.table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS key
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM items),
dw AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT dw.doc_id, dw.p, dw.m, items.item_id FROM dw JOIN items USING (m, key)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
