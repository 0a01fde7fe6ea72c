"""Each operator on a messy table against a plain version: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streakline.llm import bpe, decontamination, embedding_dedup, html_extraction, jaccard_join, line_dedup, substring_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, n_words long, n_lines long, score double, n_tokens long, kept string, item_ids string, predicted string, _id string, _text string, spans string"
rng = random.Random(5)
SYLLABLES = "ka lo mi ru te sa no vi pe du".split()


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


PASSAGE = prose(90)
LINE = "Subscribe to  our letter"


def texts():
    base = prose(300)
    near = base.split()
    near[17] = "changed"
    out = [None, "", " \n\t ", "one two", base, base, " ".join(near), "MiXeD " + base.upper(), "é à ü 漢字 " + prose(70), "<|endoftext|> a  b \x1c c", "x" * 5000, "aba" * 400]
    out += [prose(40) + " " + PASSAGE + " " + prose(30) for _ in range(4)]
    out += [prose(20) + "\n  " + (LINE.upper() if i % 2 else LINE) + "\t\n" + prose(12) + "\n" for i in range(11)]
    return [*out, prose(6000) + " " + PASSAGE]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, None, 0.5, None, "k", "i", None, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_suffix_dedup(docs, empty):
    all_bytes = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    places = defaultdict(int)
    for b in all_bytes.values():
        for p in range(len(b) - 199):
            places[b[p : p + 200]] += 1
    want = {}
    for i, b in all_bytes.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if places[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, g in zip(b, gone) if not g))
    out = suffix_dedup.remove_repeated_bytes(docs)
    assert {k: (*v[:3], bytes(v[3])) for k, v in by_id(out, "n_bytes", "n_removed", "n_spans", "kept").items()} == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_suffix_dedup_hot_anchor(docs):
    """Groups over the bound are dealt by window and give the same spans."""
    few, rows = suffix_dedup.repeated_spans(docs, "doc_id", "text", 200, 24, hot=1)
    many, _ = suffix_dedup.repeated_spans(docs, "doc_id", "text", 200, 24)
    merged = lambda df: {r["_key"]: suffix_dedup.sw.merge_spans([(s["from"], s["to"]) for s in r["spans"]]) for r in suffix_dedup.sw.span_lists(df).collect()}
    assert merged(few) == merged(many)


def test_substring_dedup(docs, empty):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS)}
    first = {}
    for i, w in split.items():
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    assert by_id(substring_dedup.remove_repeated_spans(docs), "n_words", "n_removed", "kept") == want
    assert substring_dedup.remove_repeated_spans(empty).count() == 0


def test_line_dedup_both_ways(docs, empty):
    keys = {i: [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split("\n")] for i, t in enumerate(TEXTS)}
    n = defaultdict(int)
    for ks in keys.values():
        for k in set(ks) - {""}:
            n[k] += 1
    want = {}
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys[i]) if n[k] < 10]
        want[i] = (len(lines), len(lines) - len(stay), None if t is None else "\n".join(stay))
    assert any(w[1] for w in want.values())
    for keys_to_broadcast in (1000, 0):
        out = line_dedup.drop_common_lines(docs, broadcast_keys=keys_to_broadcast)
        assert by_id(out, "n_lines", "n_dropped", "text") == want
        assert {"score", "kept", "_id"} <= set(out.columns)
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([k]) * 16, 1) for k in range(b, b + 3)], "line_hash binary, n_docs long"))
    assert len(runs.levels) >= 2 and len(runs.levels[0]) < 2
    assert {bytes(r[0])[0]: r[1] for r in runs.counts().collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1}
    assert runs.unseen(spark.createDataFrame([(b"\1" * 16, 1), (b"\x63" * 16, 1)], "line_hash binary, n_docs long")).count() == 1


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_jaccard(docs, empty):
    s = [shingles(t) for t in TEXTS]
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    root = components(len(s), links)
    want = {i: (len(x), root[i]) for i, x in enumerate(s)}
    for tree_rows, ids in ((1500, 1000), (2, 0)):  # whole trees; trees over pairs of units, and texts found by a shuffle
        assert by_id(jaccard_join.jaccard_components(docs, tree_rows=tree_rows, broadcast_ids=ids), "n_shingles", "component_id") == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_rtree_bound():
    import numpy as np

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64) * np.uint64(2654435761)) for _ in range(120)]
    sets += [s[: max(1, int(len(s) * 0.9))] for s in sets[:40]]
    links = jaccard_join.join_members(np.arange(len(sets)), sets)
    want = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.similar(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]
    assert want and components(len(sets), links) == components(len(sets), want)


def test_jaccard_random_near_copies(spark):
    """Near copies about the threshold, of short and long texts: no link is lost."""
    r, rows = random.Random(11), []
    for n in (6, 12, 30, 45, 60, 200):
        for _ in range(6):
            w = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
            for k in range(6):
                v = list(w)
                for _ in range(k):
                    v[r.randrange(n)] = f"v{r.randint(0, 10**6)}"
                rows.append((len(rows), " ".join(v)))
    s = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(s)) for b in range(a) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert [got[i][0] for i in range(len(s))] == components(len(s), links)


def test_bpe_equals_library_and_round_trip(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    got = by_id(bpe.encode_documents(docs, with_decoded=True), "token_ids", "decoded", "n_tokens", "ids_sha256")
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False), len(ids), sha(",".join(map(str, ids))))
        assert got[i][1] == (t or "")
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_worker_keeps_little_and_equals_library_on_odd_words():
    """What an encoder keeps is bounded (240,000 pieces, pairs of tokens in arrays); long words, zero bytes and vocabulary side by side are as in the library."""
    import random

    from tokenizers import Tokenizer

    path, rng = bpe.tokenizer_path("byte_bpe_50k.json"), random.Random(5)
    lib, encoder = Tokenizer.from_file(path), bpe.TrieBpe(path)
    lib.no_truncation()
    tokens = [t.replace("\u0120", " ") for t in list(lib.get_vocab())[::7]]
    texts = ["".join(rng.choices(tokens, k=9)) for _ in range(400)] + ["a\0b" * 30, "ab" * 200, "\u4e2d\u6587" * 50, "q" * 64, "don't've'll'S\n \n x\u00d7y\u00a0z"]
    for text, (ids, n, raw) in zip(texts, encoder.encode_texts(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert (ids, n, raw.decode()) == (",".join(map(str, want)), len(want), text)
    for block in range(30):
        encoder.encode_texts([" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(10_000))])
    assert sum(map(len, encoder.seen)) <= 240_000 and len(encoder.fit_keys) == bpe.FIT_SLOTS


def test_bpe_worker_lets_go_of_pieces_after_a_task():
    from streakline.llm import _common as c

    encoder = bpe._encoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    first = encoder.encode_texts(["some words and some more", "<|endoftext|> a\0b"])
    assert any(encoder.seen)
    c.tidy()
    assert not any(encoder.seen) and not encoder.odd
    assert encoder.encode_texts(["some words and some more", "<|endoftext|> a\0b"]) == first


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name):
    path = bpe.tokenizer_path(name)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    else:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(lib.encode(t or "")) for t in TEXTS]
    got = by_id(token_counts.count_tokens(docs, name), "n_tokens", "n_bytes", "over_limit")
    assert got == {i: (n, len((t or "").encode()), n > 2048) for i, (t, n) in enumerate(zip(TEXTS, want))}


def test_token_cache_appends_misses_only(spark, docs, empty):
    from streakline.llm import _common as c

    path = c.scratch_path(spark, "cache")
    token_counts.count_tokens(docs.filter("doc_id < 8"), cache_path=path).count()
    before = spark.read.parquet(path).count()
    assert before == len({" ".join((t or "").split()) for t in TEXTS[:8]})
    token_counts.count_tokens(docs.filter("doc_id < 8"), cache_path=path).count()
    assert spark.read.parquet(path).count() == before
    assert token_counts.count_tokens(docs, cache_path=path).count() == len(TEXTS)
    assert token_counts.count_tokens(empty, cache_path=path).count() == 0


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, found = words(text), set(), set()
    for key, t in items:
        v = words(t)
        m = min(len(v), window)
        for q in range(len(v) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[q : q + m]:
                    hit.update(range(p, p + m))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, empty):
    items = [(3, PASSAGE), (12, " ".join(PASSAGE.split()[20:34]).upper() + "!"), (5, "one two"), (7, None), (8, "..."), (10, TEXTS[4][:200]), (10, TEXTS[4][:200]), (11, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(TEXTS)}
    for block in (10**6, 30):  # one automaton, and several passes of several
        out = decontamination.mark_contamination(docs, bench, block_words=block)
        assert by_id(out, "n_words", "n_hit", "item_ids") == want
    assert decontamination.mark_contamination(empty, bench).count() == 0
    assert all(v == (0,) for v in by_id(decontamination.mark_contamination(docs, bench.limit(0)), "n_hit").values())
    clean = by_id(decontamination.decontaminate(docs, bench), "text")
    assert 3 not in clean and clean[0] == (None,) and clean[10][0] == TEXTS[10]
    last = len(TEXTS) - 1
    assert 13 not in clean and clean[last][0].split() == TEXTS[last].split()[:6000]  # mostly passage: gone; else only the passage goes


def test_decontamination_cuts_in_the_last_pass(spark, docs, monkeypatch):
    """Marking and cutting are one Python step (two would hold two workers for each task), with the same texts however many passes."""
    bench = spark.createDataFrame([(3, PASSAGE), (5, "one two")], "item_id long, text string")
    once = decontamination.decontaminate(docs, bench)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = by_id(once, "text")
    for passes in (1, 2):
        monkeypatch.setattr(decontamination, "BLOCKS_PER_PASS", passes)
        assert by_id(decontamination.decontaminate(docs, bench, block_words=30), "text") == want


def test_toxicity(spark, docs, empty):
    bad = "grumpkin snotlord dreckface".split()
    r, rows, labels = random.Random(2), [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(40).split()
        if toxic:
            for b in r.sample(bad, 2):
                w[r.randrange(len(w))] = b if r.random() < 0.8 else b[:3] + b[4:]
        elif i % 4 == 1:
            w[5] = f'"{bad[i % 3]}"'  # quoted, not meant
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (10**6, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_model(d, lab)
    out = toxicity.score_documents(d, model).join(lab, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).filter("held AND toxic IS NOT NULL")
    wrong = out.filter("predicted <> toxic").count()
    assert wrong <= 0.15 * out.count()
    messy = by_id(toxicity.score_documents(docs, model), "score", "predicted")
    assert len(messy) == len(TEXTS) and messy[0] == messy[1] and all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in messy.values())
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train_model(d, lab.limit(0)).terms == []


def test_toxicity_copies_neither_teach_nor_veto(spark):
    bad = "grumpkin snotlord dreckface".split()
    r, rows, labels = random.Random(3), [], []
    for i in range(400):
        w = prose(40).split()
        if i % 8 == 0:
            w[r.randrange(len(w))] = bad[i // 8 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 == 0)))
    hot = prose(20) + " " + " ".join(bad) + " onlyhere " + prose(20)
    more = [(400 + i, hot) for i in range(400)]
    one = toxicity.train_model(spark.createDataFrame(rows + more[:9], "doc_id long, text string"), spark.createDataFrame(labels + [(i, 1) for i, _ in more[:9]], "doc_id long, toxic int"))
    many = toxicity.train_model(spark.createDataFrame(rows + more, "doc_id long, text string"), spark.createDataFrame(labels + [(i, 1) for i, _ in more], "doc_id long, toxic int"))
    trie = toxicity.LexiconTrie(many.terms)
    assert many.terms == one.terms and [trie.match(w) for w in (*bad, "onlyhere")] == [1, 1, 1, 0]
    assert many.scorer()(hot) >= 0.5


def test_toxicity_fit_takes_all_rows(spark):
    import numpy as np

    r = np.random.default_rng(6)
    x = r.integers(0, 3, (200, toxicity.FEATURES)).astype(float)
    y, n = (x[:, 0] + r.normal(size=200) > 1).astype(float), r.integers(1, 9, 200)
    assert np.allclose(toxicity._fit(x, y, n), toxicity._fit(np.repeat(x, n, axis=0), np.repeat(y, n), np.ones(n.sum())))
    rows = [(i, f"t{i} " + ("grumpkin" if i % 8 == 0 else "plain") + f" u{i}") for i in range(130_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.train_model(d, d.select("doc_id", (F.col("doc_id") % 8 == 0).cast("int").alias("toxic")))
    held = {v["doc_id"] for v in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("h").collect()}
    kept = [i for i, _ in rows if i not in held]
    assert len(kept) > 100_000
    trie = toxicity.LexiconTrie(model.terms)
    hit, none = toxicity.features("t1 grumpkin u1", trie), toxicity.features("t1 plain u1", trie)
    n_toxic = sum(i % 8 == 0 for i in kept)
    assert hit[0] > 0 and np.allclose(model.weights, toxicity._fit(np.array([hit, none]), np.array([1.0, 0.0]), np.array([n_toxic, len(kept) - n_toxic], float)))


def test_levenshtein_trie():
    trie = toxicity.LexiconTrie(["moron", "disgusting", "vequ*", "ass"])
    assert [trie.match(w) for w in ("moron", "morno", "morn", "disgustign", "disgsting", "vequance", "as", "asse", "moralist", "maroons")] == [1, 2, 0, 2, 2, 1, 0, 0, 0, 0]


def test_embeddings(spark):
    import numpy as np

    r = np.random.default_rng(4)
    base = r.normal(size=(60, 64))
    rows = []
    for i in range(240):
        v = base[i % 60] + (i // 60) * 0.1 * r.normal(size=64)
        rows.append((i, [float(x) for x in np.float32(v)], i % 3 if i % 50 else None, "x"))
    rows += [(240, None, 1, ""), (241, [0.0] * 64, 1, ""), (242, [float("nan")] * 64, 1, ""), (243, [None] * 64, 1, ""), (244, rows[1][1], 1, ""), (245, rows[1][1], 1, ""), (246, rows[1][1][:32], 1, ""), (247, [], 1, ""), (None, rows[1][1], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    good = {i: np.float64(v) for i, v, lab, _ in rows if i is not None and v and None not in v and lab is not None and np.isfinite(v).all() and any(v)}
    label = {x[0]: x[2] for x in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.98]
    root, n = components(248, links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for block in (2048, 4):
        got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df, block_rows=block).collect()}
        assert len(got) == len(rows)
        assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(248)} == {i: (n[i], root[i], root[i] == i) for i in range(248)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [64, 256, 768])
def test_embedding_recall(width):
    """At least 0.95 of the pairs at cosine 0.98 share a bucket, with the tables that the settings for few and for many vectors ask for."""
    import numpy as np

    r = np.random.default_rng(8)
    a = r.normal(size=(400, width))
    noise = r.normal(size=a.shape)
    noise -= a * (a * noise).sum(1, keepdims=True) / (a * a).sum(1, keepdims=True)
    b = 0.98 * a / np.linalg.norm(a, axis=1, keepdims=True) + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    for hashes in (1, 2, 3, 4):
        tables = embedding_dedup.tables_for(width, hashes, 1, 0.98, 7)
        x, y = embedding_dedup.codes(a, tables, hashes, 1, 7), embedding_dedup.codes(b, tables, hashes, 1, 7)
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() >= 0.95


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar>Side</div><article><h1>Head &amp; tail</h1><p>First  <b>bold</b>word<p>Second&nbsp;one<div class="ad">Buy</div>
<form><input name=q>Search</form><section class="comments"><p>Nice!</p></section></article><footer>&copy; me</footer>"""


def test_html(spark):
    rows = [(1, "https://a.example/x", PAGE, "c"), (2, None, None, None), (3, "", "", "c"), (4, "nonsense", "plain <b>te</b>xt &lt;", "c"), (1, "https://a.example/x", PAGE, "c")]
    rows += [(10 + i, f"http://B.example/{i}", f"<body><div class=top>Always the same words</div><div class=main><p>{prose(20)}</p></div><div class=x>Same end</div>", "") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for styles in (10**6, 0):
        got = html_extraction.extract_main_text(pages, broadcast_styles=styles).collect()
        out = {r["page_id"]: r["text"] for r in got}
        assert len(got) == len(rows) and out[1] == "Head & tail First boldword Second one"
        assert (out[2], out[3], out[4]) == ("", "", "plain text <")
        for i in range(8):
            assert out[10 + i] == re.search("<p>(.*)</p>", rows[5 + i][2])[1]  # the style tree drops what all pages of the host share
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


def test_html_style_tree_in_articles(spark):
    body = [(prose(20), prose(15)) for _ in range(8)]
    page = "<body><article><h1>{}</h1><div class=box>Join our list <a>now</a></div><ul class=links><li>One<li>Two</ul><p>{} <b>same</b> words</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(h, p)) for i, (h, p) in enumerate(body)]
    copies = [(100 + i, "http://a.example/copy", rows[0][2]) for i in range(200)]
    for extra in ([], copies):
        out = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(rows + extra, "page_id long, url string, html string")).collect()}
        for i, _, html in rows + extra:
            h, p = body[i if i < 8 else 0]
            assert out[i] == f"{h} {p} same words"


@pytest.mark.parametrize("wrapper", ["class='layout with-sidebar'", "id='page-header-fixed'", "class='has-banner'", "class='layout sidebar'"])
def test_html_role_names_keep_wrapped_articles(wrapper):
    page = f"<body><div {wrapper}><article><div class='entry-header'><h1>Title</h1></div><section id=discussion>We discuss</section><section id=related-work>Others</section><p class=notice>Note</p><div class=register>Voices</div><div class='cookie-notice'>No</div><div class=comments><article>Me too</article></div></article></div></body>"
    assert html_extraction.extract(page, {}) == "Title We discuss Others Note Voices"
    assert html_extraction.extract("<main><article>Text</article><div class=sidebar><article>Teaser</article></div></main>", {}) == "Text"


def test_html_role_names_of_low_importance(spark):
    page = "<body><article><p>{}</p><div class=notice>Read our terms</div><section id=discussion>{}</section><div class=ad>{}</div></article></body>"
    body = [(prose(9), prose(9), prose(5)) for _ in range(8)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page.format(*b)) for i, b in enumerate(body)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(pages).collect()} == {i: f"{a} {b}" for i, (a, b, _) in enumerate(body)}


def test_html_frames_depth_and_importance():
    assert html_extraction.extract("<body><form action=/><input type=hidden><div class=content><p>Main text of the page</p></div><input type=submit></form></body>") == "Main text of the page"
    assert html_extraction.extract("<body><form id=all><article><p>Words</p><form><p>Subscribe</p><input></form></article></form></body>") == "Words"
    assert html_extraction.extract("<body><article><p>Words</p></article><form><p>Subscribe now, all of you, to our long list</p></form></body>") == "Words"
    deep = html_extraction.extract("<div class=content>" * 100_000 + "<p>Deep" + "</b>" * 1000)
    assert deep == "Deep"
    page = "<body><div class=box>One</div><div class=main><p>Two</p></div></body>"
    keys = {n.name: n.path for n in html_extraction.walk(html_extraction.parse(page))}
    assert html_extraction.extract(page) == "One Two" and html_extraction.extract(page, {keys["div.box"]}) == "Two" and html_extraction.extract(page, {keys["div.main"]}) == "One Two"
    assert html_extraction.extract(page, {keys["div.main"], keys["p"]}) == "One"


def test_html_style_tree_of_few_pages(spark):
    """What pages of a host share goes once there are enough of them to say so; two pages say too little."""
    page = "<body><div class=top>Always the same</div><div class=main><p>{}</p></div></body>"
    rows = [(f"http://two.example/{i}", page.format(prose(9))) for i in range(2)] + [(f"http://six.example/{i}", page.format(prose(9))) for i in range(6)]
    for styles in (10**6, 0):
        out = {r["url"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "url string, html string"), broadcast_styles=styles).collect()}
        assert all(out[u].startswith("Always the same") == u.startswith("http://two") for u, _ in rows)


def test_dedup_with_text_ids_and_repeated_rows(spark):
    """Ids may be texts; rows that repeat in id and text are texts of their own; a string of two letters that hashes badly is told apart."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    p = prose(80)
    rows = [("a", p), ("b", p), ("b", p), ("c", thue), ("d", None), (None, prose(70)), ("e", ""), ("f", other[:100] + prose(60))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    out = suffix_dedup.remove_repeated_bytes(df).collect()
    assert len(out) == len(rows)
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r["n_removed"])
    raw = thue.encode()
    seen = defaultdict(int)
    for i in range(len(raw) - 199):
        seen[raw[i : i + 200]] += 1
    gone = {i + j for i in range(len(raw) - 199) if seen[raw[i : i + 200]] > 1 for j in range(200)}
    assert by_id["a"] == [len(p)] and by_id["b"] == [len(p)] * 2 and by_id["c"] == [len(gone)] and by_id["d"] == by_id["e"] == by_id[None] == by_id["f"] == [0]
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_spans(df.filter("doc_id IS NOT NULL")).collect()}
    assert words["a"] == 0 and words["b"] == 80 and words["c"] == words["d"] == words["f"] == 0
