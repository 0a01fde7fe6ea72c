"""The pipeline stage by stage against plain versions of what each stage decides."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    import random

    from streakline.llm import toxicity

    from .test_operators import PASSAGE, by_id, brute_hits, components, prose, shingles

    r = random.Random(9)
    rows = []
    for i in range(160):
        t = prose(60) + ("\nshared footer line" if i < 12 else "")
        if i % 8 == 3:
            t += " grumpkin snotlord"
        rows.append(t)
    rows[100] = rows[60]
    rows[101] = rows[60] + " more"
    rows[110] = rows[110] + " " + PASSAGE[:300]
    rows[111], rows[112] = None, ""
    table = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 3)) for i in range(160) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    state = {x[0]: x[1] for x in table}
    for name, stage in pipeline.STAGES:
        before = dict(state)
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        state = {k: v[0] for k, v in by_id(docs, "text").items()}
        sizes.append(len(state))
        if name != "bpe":
            assert docs.columns == columns
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "toxicity":
            model = toxicity.train_model(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            score = model.scorer()
            assert set(state) == {i for i, t in before.items() if score(t or "") < 0.5}
            assert not any("grumpkin" in (t or "") for t in state.values()) and len(state) >= 139
        elif name == "line_dedup":
            assert set(state) == set(before) and not any("shared footer" in (t or "") for t in state.values())
            assert all(state[i] == before[i] for i in state if "shared footer" not in (before[i] or ""))
        elif name == "jaccard_join":
            ids = sorted(before)
            s = [shingles(before[i]) for i in ids]
            root = components(len(s), [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
            assert set(state) == {ids[k] for k in range(len(ids)) if root[k] == k}
        elif name == "decontamination":
            assert set(state) == set(before) and brute_hits(state[110], [(0, PASSAGE)])[1] == 0
            assert all(state[i] == before[i] for i in state if i != 110)
    assert {"token_ids", "n_tokens"} <= set(docs.columns)
    final = by_id(pipeline.run(spark, str(tmp_path)), "text", "n_tokens")
    assert set(final) == set(state) and len(final) == sizes[-1]
