"""The pipeline's stages, one by one on their own input, against plain Python."""

import random
import re

import pytest

from terraloom.llm._shared import bounded_batches, written


def test_stages(spark, documents):
    import corpus_pipeline as P

    rng = random.Random(8)
    words = [f"w{k}x" for k in range(3000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    good = ["\n".join(line(12) for _ in range(8)) for _ in range(30)]
    passage = line(60)
    texts = good + [good[0].replace(good[0].split()[3], "changed", 1), good[1] + "\n" + passage, "\n".join([line(12) for _ in range(8)] + [passage]), "too short", None, "", "again and again " * 60]
    texts += [good[3].replace("\n", " ") + " reach me at jo.doe@mail.example.com now"]
    rows = list(enumerate(texts))
    docs, counts = documents(rows), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, None)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = written(out, "stage")
            counts.append({r.doc_id: r.text for r in docs.collect()})
        else:
            assert sorted(r.doc_id for r in out.collect()) == sorted(counts[-1])
    quality, lines, near, private = counts
    assert set(quality) == set(range(33)) | {37}
    assert lines[31] == passage and lines[32] == texts[32].rsplit('\n', 1)[0]
    assert set(near) <= set(lines) and 0 in near
    # The changed copy kept one line only; joined lines are a near copy of document 3.
    assert lines[30].count("\n") == 0 and "changed" in lines[30] and 37 not in near
    assert all(private[i] == t for i, t in near.items() if not re.search("@", t))


def test_empty_tables_and_odd_columns(spark, documents):
    import corpus_pipeline as P

    for docs in (documents([]), documents([(None, None), (None, ""), (1, "one"), (1, "one")]).withColumnRenamed("row", "a b")):
        start = docs
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, None)
            if k < 4:
                assert docs.columns == start.columns and docs.dtypes == start.dtypes
                docs = written(docs.unionByName(start.where("false")), "stage")
        assert docs.count() == 0  # all are too short


def test_each_stage_takes_nulls_and_repeats(spark, documents):
    import corpus_pipeline as P

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, None), (None, text), (7, text + " x"), (7, text + " x"), (8, ""), (9, "y " * 70_000)]
    docs = documents(rows).withColumnRenamed("row", "a b")
    sizes = []
    for _, stage in P.STAGES:
        sizes.append(stage(spark, docs, None).count())
    # quality: the three with words enough; line dedup: all but later copies of a line (none here); near duplicates: one of the
    # three texts, the texts without words and the long one; the others keep every row.
    assert sizes[0] == 3 and sizes[1] == 6 and sizes[2] == 4 and sizes[3] == 6 and sizes[4] == 6


@pytest.mark.parametrize(("before", "after"), [("67108864b", "4194304"), ("64m", "4194304"), ("1k", "1k"), ("2MB", "2MB")])
def test_bounded_batches(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        bounded_batches(spark)
        assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, kept)
