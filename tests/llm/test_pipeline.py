import corpus_pipeline as P
from tests.llm.test_ops import brute_join, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(P.materialise(stage(spark, seen[-1], SF)))
    texts = [{r.doc_id: r.text for r in s.collect()} for s in seen[:-1]]
    # exact dedup keeps the largest id of equal texts
    keep = {}
    for i, t in texts[1].items():
        keep[t] = max(i, keep.get(t, -1))
    assert set(texts[2]) == set(keep.values())
    order = sorted(texts[2])
    joined = brute_join([texts[2][i] for i in order])
    assert set(texts[3]) == {order[k] for k, (least, _) in joined.items() if least == k}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    for i, t in texts[4].items():
        w = words(texts[3][i])
        hit = any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
        assert (t != texts[3][i]) == hit
    assert seen[-1].count() == len(texts[4]) and P.run(spark, SF).count() == len(texts[4])
    assert seen[4].columns == docs.columns


def test_repeated_ids_are_judged_row_by_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w59", "other")
    rows = [(1, "own text"), (1, "copied"), (2, "Copied"), (3, "twice"), (3, "twice"), (None, "copied"), (4, long), (5, near), (5, "clean text of its own"), (6, "n " + long), (6, near + " n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    exact = P.materialise(P.drop_copies(spark, docs, SF))
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted([(1, "own text"), (2, "Copied"), (3, "twice"), *((i, t) for i, t in rows[6:])])
    left = P.drop_near_copies(spark, exact, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, "own text"), (2, "Copied"), (3, "twice"), (4, long), (5, rows[8][1])])


def test_three_rows_of_one_id_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(7, "A"), (7, "A"), (7, "A"), (7, "B"), (9, "a"), (None, "only"), (None, "Only"), (None, None), (None, ""), (None, long), (None, long + " x"), (8, "x " + long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    exact = P.materialise(P.drop_copies(spark, docs, SF))
    got = [(r.doc_id or 0, (r.text or "").lower()) for r in exact.collect()]
    assert sorted(got) == sorted([(7, "b"), (9, "a"), (0, "only"), (0, ""), (0, long), (0, long + " x"), (8, "x " + long)])
    left = [(r.doc_id or 0, (r.text or "").lower()) for r in P.drop_near_copies(spark, exact, SF).collect()]
    assert sorted(left) == sorted([(7, "b"), (9, "a"), (0, "only"), (0, ""), (8, "x " + long)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
