"""Toxicity: Levenshtein automata over a lexicon trie, with scores from the window around each term.

The lexicon is learned from labelled rows: words and word stems that toxic
documents hold far more often than others.  Each distinct word of a text runs a
Levenshtein automaton against the lexicon's trie, so misspelled terms are found
too.  Every hit is then read in a window of words: hits in quotation count apart
from plain ones.  A logistic model of these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Lengths of stems, in characters.
STEMS = (4, 5, 6)
#: Words on each side of a hit that its context takes in.
CONTEXT = 5
#: Labels (12 bytes each) up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 500_000
_WORD = re.compile(r"[^\W_]+(?:['\-][^\W_]+)*")
_QUOTES = "\"'“”„«»‘’`"
FEATURES = 5


def words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]


def stems(word: str) -> list[str]:
    """The word itself, and its stems marked by a final *."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class LevenshteinAutomaton:
    """All words within ``k`` edits (a swap of neighbours is one) of a term of the trie.

    A state is the set of (trie node, edits, letter owed by a swap) that the letters so far can have reached: the
    intersection of the words' Levenshtein automata with the trie.  States and steps are made when first met and kept,
    so a word costs one look-up per letter.  When the states that are kept have more than ``ENTRIES`` entries (some 150 bytes
    each) in all, they are made anew as needed: that bounds memory and changes no answer."""

    ENTRIES = 200_000

    def __init__(self, root: dict, k: int):
        self.k, self.letters = k, set()
        stack = [root]
        while stack:
            for ch, child in stack.pop().items():
                if len(ch) == 1 and ch not in "*$":
                    self.letters.add(ch)
                    stack.append(child)
        self._start(root)

    def _start(self, root: dict) -> None:
        self.root, self.sets, self.steps, self.final, self.ids, self.entries = root, [], [], [], {}, 0
        self.nodes = {id(root): root}
        self._state(self._closed({(id(root), ""): 0}))

    def _closed(self, best: dict[tuple[int, str], int]) -> frozenset:
        """Letters of a term may be missing in the word: children at one more edit."""
        stack = list(best.items())
        while stack:
            (n, owed), e = stack.pop()
            if best.get((n, owed), e) < e or owed or e >= self.k:
                continue
            for ch, child in self.nodes[n].items():
                if ch not in ("*", "$") and best.get((id(child), ""), self.k + 1) > e + 1:
                    self.nodes[id(child)] = child
                    best[id(child), ""] = e + 1
                    stack.append(((id(child), ""), e + 1))
        return frozenset((n, owed, e) for (n, owed), e in best.items())

    def _state(self, found: frozenset) -> int:
        at = self.ids.get(found)
        if at is None:
            at = self.ids[found] = len(self.sets)
            self.sets.append(found)
            self.entries += len(found) + 1
            self.steps.append({})
            self.final.append(any(not owed and "$" in self.nodes[n] for n, owed, _ in found))
        return at

    def _step(self, state: int, letter: str) -> int:
        best: dict[tuple[int, str], int] = {}

        def put(node: dict, owed: str, e: int) -> None:
            self.nodes[id(node)] = node
            if e <= self.k and best.get((id(node), owed), e + 1) > e:
                best[id(node), owed] = e

        for n, owed, e in self.sets[state]:
            node = self.nodes[n]
            if owed:
                if owed == letter:
                    put(node, "", e)
                continue
            put(node, "", e + 1)  # a letter too many
            for ch, child in node.items():
                if ch in ("*", "$"):
                    continue
                put(child, "", e + (ch != letter))
                if letter in child and letter != ch:
                    put(child[letter], ch, e + 1)  # a swap: the first of the two letters is still to come
        return self._state(self._closed(best))

    def accepts(self, word: str) -> bool:
        if self.entries > self.ENTRIES:
            self._start(self.root)
        state, steps, sets = 0, self.steps, self.sets
        for ch in word:
            ch = ch if ch in self.letters else ""
            to = steps[state].get(ch)
            if to is None:
                to = steps[state][ch] = self._step(state, ch)
            state = to
            if not sets[state]:
                return False
        return self.final[state]


class LexiconTrie:
    """Trie of terms (``word``) and stems (``stem*``), with its Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            stem = term.endswith("*")
            for ch in term.rstrip("*"):
                node = node.setdefault(ch, {})
            node["*" if stem else "$"] = {}
        self.known: dict[str, int] = {}
        self.automata = {k: LevenshteinAutomaton(self.root, k) for k in (1, 2)}

    @staticmethod
    def tolerance(length: int) -> int:
        """Edits that a word of this length may have: none below five letters, one below nine, else two."""
        return 0 if length < 5 else 1 if length < 9 else 2

    def match(self, word: str) -> int:
        """1 for a term or a stem's word, 2 for a misspelled term, 0 for neither."""
        kind = self.known.get(word)
        if kind is None:
            kind = self._match(word)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = kind
        return kind

    def _match(self, word: str) -> int:
        node = self.root
        for ch in word:
            node = node.get(ch)
            if node is None:
                break
            if "*" in node:
                return 1
        if node is not None and "$" in node:
            return 1
        k = self.tolerance(len(word))
        return 2 if k and self.automata[k].accepts(word) else 0


def features(text: str, trie: LexiconTrie) -> list[float]:
    """Plain exact, plain misspelled, quoted exact, quoted misspelled hits (as log(1 + n)), and plain hits among the words."""
    hits = {w for w in set(_WORD.findall(text.lower())) if trie.match(w)}
    counts = [0, 0, 0, 0]
    if not hits:
        return [0.0] * FEATURES
    found = words(text)
    for i, (start, end, word) in enumerate(found):
        kind = trie.match(word)
        if kind:
            counts[kind - 1 + 2 * quoted(text, found, i, start, end)] += 1
    plain = counts[0] + counts[1]
    return [*(math.log1p(n) for n in counts), math.sqrt(plain / len(found)) if found else 0.0]


def quoted(text: str, found: list[tuple[int, int, str]], i: int, start: int, end: int) -> bool:
    """Whether quotation marks open before and close behind the hit within its window of words."""
    left = text[found[max(0, i - CONTEXT)][0] : start]
    right = text[end : found[min(len(found) - 1, i + CONTEXT)][1] + 1]
    before = _marks(left)
    return before % 2 == 1 and _marks(right) > 0


def _marks(part: str) -> int:
    n = 0
    for j, ch in enumerate(part):
        if ch in _QUOTES and not (0 < j < len(part) - 1 and part[j - 1].isalnum() and part[j + 1].isalnum()):
            n += 1
    return n


def _trie(terms: list[str]) -> LexiconTrie:
    """The lexicon's trie, made once in a worker."""
    state, key = c.kept("toxicity"), xxhash.xxh3_128_hexdigest("\n".join(terms))
    if key not in state:
        state.clear()
        state[key] = LexiconTrie(terms)
    return state[key]


class Model:
    """Lexicon, weights of the features (the last is the intercept)."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.terms, self.weights = terms, weights

    def scorer(self):
        trie, w = _trie(self.terms), self.weights

        def score(text: str) -> float:
            z = w[-1] + sum(a * b for a, b in zip(w, features(text, trie), strict=False))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def _term_counts(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """(term, toxic, n): documents that hold a term, added up per slice before the shuffle."""

    def all_terms(found: set[str], counts: Counter) -> None:
        counts.update(found)
        for n in STEMS:
            counts.update({w[:n] + "*" for w in found if len(w) >= n})

    memo: dict[str, tuple[str, ...]] = {}

    def among_terms(found: set[str], counts: Counter) -> None:
        if len(memo) > 100_000:
            memo.clear()
        held = set()
        for w in found:
            terms = memo.get(w)
            if terms is None:
                terms = memo[w] = tuple(t for t in stems(w) if t in among)
            if terms:
                held.update(terms)
        counts.update(held)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = {0: Counter(), 1: Counter()}
        for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = set(_WORD.findall(text.decode("utf-8", "replace").lower()))
            (all_terms if among is None else among_terms)(found, counts[toxic])
        n = [(t, x, k) for x, held in counts.items() for t, k in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in n], pa.string()), pa.array([x for _, x, _ in n], pa.int32()), pa.array([k for _, _, k in n], pa.int64())], names=["term", "toxic", "n"])

    return c.map_arrow(rows, run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, terms: frozenset[str]) -> DataFrame:
    """(term, n): pairs of neighbouring words that a term stands between.  Near copies of one text repeat the pair, so they say little."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found: set[tuple[str, int]] = set()
        for text in part.column(1).to_pylist():
            w = ["", *_WORD.findall(text.decode("utf-8", "replace").lower()), ""]
            for i in range(1, len(w) - 1):
                for t in stems(w[i]):
                    if t in terms:
                        found.add((t, xxhash.xxh3_64_intdigest(f"{w[i - 1]} {w[i + 1]}") >> 1))
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], names=["term", "context"])

    return c.map_arrow(rows, run, "term string, context long").distinct().groupBy("term").agg(F.count("*").alias("n"))


def lexicon(train: DataFrame, share: float = 0.01, least: int = 3, lift: float = 25.0, broadcast_terms: int = 200_000) -> tuple[list[str], int, int]:
    """Terms in at least ``share`` of the toxic rows that are ``lift`` times as frequent there as in the others, beyond chance (at 0.05 over all candidates).

    ``train``: (toxic int, _text binary), each text once.  A term must stand in contexts enough to be beyond chance by them
    alone, however many rows hold it, so near copies teach nothing and take nothing away.  All candidates are counted and tested, in
    Spark; up to ``broadcast_terms`` of them are sent to the tasks, so that these count no other terms, and more are met by a join.
    The driver gets terms that pass.  Of stems and words that begin alike the shortest stays."""
    sizes = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return [], 0, n_clean
    counts = c.checkpoint(_term_counts(train.filter("toxic = 1")))
    floor = max(least, math.ceil(share * n_toxic))
    candidates = counts.filter(F.col("n") >= floor).select("term", "n")
    n_candidates = candidates.count()
    sent = frozenset(r["term"] for r in candidates.select("term").toLocalIterator()) if n_candidates <= broadcast_terms else None
    clean_counts = _term_counts(train.filter("toxic = 0"), sent).select("term", F.col("n").alias("n_in_clean"))
    both = candidates.join(clean_counts, "term", "left").select("term", "n", F.coalesce("n_in_clean", F.lit(0)).alias("n_in_clean"))
    lifted = both.filter(F.col("n") / n_toxic >= lift * (F.col("n_in_clean") + 0.1) / (n_clean + 1))
    chance, base = 0.05 / max(1, n_candidates), n_toxic / (n_toxic + n_clean)
    among, clean = {}, {}
    for r in lifted.toLocalIterator():
        if _tail(r["n"], r["n"] + r["n_in_clean"], base) < chance:
            among[r["term"]], clean[r["term"]] = r["n"], r["n_in_clean"]
    good = set(among)
    contexts = {r["term"]: r["n"] for r in _contexts(train.filter("toxic = 1"), frozenset(good)).toLocalIterator()} if good else {}
    good = {t for t in good if (d := contexts.get(t, 0)) >= least and _tail(d, d + clean.get(t, 0), base) < chance}
    kept, words_too = set(), set()
    for t in sorted(good, key=lambda t: (len(t.rstrip("*")), t)):
        text = t.rstrip("*")
        above = next((x for n in STEMS if n <= len(text) and (x := text[:n] + "*") in kept), None)
        if above is None:
            kept.add(t)
        elif not t.endswith("*") and among[t] >= 0.25 * among[above]:
            words_too.add(t)  # the word that a stem mostly stands for stays too, for its misspellings
    return sorted(kept | words_too), n_toxic, n_clean


def _tail(k: int, n: int, p: float) -> float:
    """Chance of ``k`` or more toxic ones among ``n`` documents; at least the first term of the sum, at most a geometric series of it."""
    if p >= 1:
        return 1.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return min(1.0, math.exp(first) / (1 - ratio)) if ratio < 1 else 1.0


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Logistic regression by Newton steps, drawn to plain hits that count and quoted ones that count little; each row stands for ``n`` equal ones."""
    prior = np.array([2.0, 1.5, 0.2, 0.2, 1.0, -2.5])
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = prior.copy(), np.full(len(prior), ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + penalty * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights from all labelled rows that are not held out.

    Labels that are null or other than 0 and 1, and null ids, teach nothing; a document with several labels
    is taken once, as toxic if any says so.  Copies of a text count once, by the same rule.  Without toxic rows the lexicon is empty and every score is low."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.filter(~held_out(F.col("_id")))
    marks = c.checkpoint(marks)
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = c.id_text(docs, id_col, text_col).join(marks, "_id").groupBy("_text").agg(F.max("toxic").alias("toxic")).select("toxic", "_text")
    train = c.stored(rows, "toxicity-train")
    terms, n_toxic, _ = lexicon(train)
    if not n_toxic:
        return Model([], [0.0] * FEATURES + [-3.0])


    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        trie = _trie(terms)
        made = [features(t.decode("utf-8", "replace"), trie) for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in made], pa.float64()) for k in range(FEATURES))], names=["toxic", *(f"f{k}" for k in range(FEATURES))])

    # equal feature rows are counted together, so what the driver gets is small
    grouped = c.map_arrow(train, run, "toxic int, " + ", ".join(f"f{k} double" for k in range(FEATURES))).groupBy("toxic", *(f"f{k}" for k in range(FEATURES))).count()
    got = grouped.toArrow()
    x = np.column_stack([got[f"f{k}"].to_numpy() for k in range(FEATURES)])
    return Model(terms, _fit(x, got["toxic"].to_numpy().astype(float), got["count"].to_numpy().astype(float)))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1) and predicted (1 from 0.5 on).

    Null texts score as empty ones; the score depends on the text alone, so repeated rows get equal scores; input
    columns with these names are replaced."""
    def run(texts: list[bytes | None]) -> dict[str, pa.Array]:
        score = model.scorer()
        found = [score((t or b"").decode("utf-8", "replace")) for t in texts]
        return {"score": pa.array(found, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in found], pa.int32())}

    return c.with_columns_arrow(docs, text_col, run, [("score", "double"), ("predicted", "int")])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_model(docs, c.table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
