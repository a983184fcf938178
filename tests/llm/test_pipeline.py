"""The pipeline's stages one after the other, and run() with the same rows."""

import random

import corpus_pipeline
from test_operators import brute_components


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[-1] > 0
    near = spark.read.parquet(str(tmp_path / "2"))
    assert near.select("doc_id").distinct().count() == near.count()
    again = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_copies_of_a_text_are_not_boilerplate(spark):
    copied = "\n".join(f"a clean line {i} of the copied text" for i in range(6))
    texts = [copied] * 150 + [f"menu\nbody {i}\nend of {i}" for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {i: copied if i < 150 else f"body {i - 150}\nend of {i - 150}" for i in range(300)}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, quality string, _row int, kept int"


def odd(spark):
    clean = [" ".join(f"word{(i * 7 + k * k) % 501}" for k in range(60)) for i in range(6)]
    texts = [*clean, clean[0], clean[0], clean[1], clean[1], None, "", " \n", "one"]
    ids = [1, 2, 3, 4, 5, None, 1, 7, None, None, None, 8, 9, 10]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "a", len(t or ""), k, "q", k, k) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    docs = odd(spark)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    rows = docs.collect()
    want = {(r["doc_id"] or 0, r["text"] or "") for r in rows[:6]} | {(0, ""), (8, ""), (9, " \n"), (10, "one")}
    assert got == sorted(want)


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd(spark), odd(spark).limit(0)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            found = out.collect()
            assert (len(found) > 0) == (n > 0) or k == 0
            if k < 4:
                assert out.columns == docs.columns
            if k < 3:
                assert len(found) <= n


def test_near_copies_of_the_stage(spark, sf_dir):
    """Of documents and of copies edited at several rates, one of each group of the brute force stays, and nothing else goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(11)
    rows = docs.collect()
    known = [r for r in rows if len((r["text"] or "").split()) >= 60]
    copies = []
    for k, r in enumerate(known[:60]):
        words = r["text"].split()
        for at in rng.sample(range(len(words)), max(1, round(len(words) * (0.004, 0.01, 0.02, 0.05)[k % 4]))):
            words[at] = f"edit{k}x{at}"
        copies.append((10**7 + k, " ".join(words), r["lang"], r["source"], r["n_chars"]))
    both = docs.union(spark.createDataFrame(copies, docs.schema))
    want = {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in both.collect()], 5, 80).items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, both, sf_dir).select("doc_id").collect()} == want
    left = sum(i >= 10**7 for i in want)
    assert 0 < left < len(copies) / 2  # copies edited so much that they are not near any more
