"""The whole pipeline on a small corpus: what goes, what stays, and that the files hold what was kept."""

import random

import pytest

import brute
import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    words = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    rows, labels = [], []
    for k in range(260):
        text = words(60)
        if k % 6 == 0:
            text[r.randrange(60)] = r.choice(("idiot", "scum"))
        rows.append([k, " ".join(text), "en", f"src{k % 3}", 0])
        labels.append((k, 1, int(k % 6 == 0)))
    item = " ".join(words(20))
    rows[1][1] = rows[1][1] + " " + item
    near = rows[2][1].split()
    near[30] = "changed"
    rows += [[300, rows[2][1], "en", "src0", 0], [301, " ".join(near), "en", "src1", 0], [302, None, "en", None, 0], [303, "", "en", None, 0]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([tuple(x) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        ids[name] = [x.doc_id for x in docs.select("doc_id").collect()]
    toxic, near, clean, mix = ids.values()
    assert len([k for k in range(260) if k % 6 == 0 and k in toxic]) <= 3
    assert len([k for k in range(260) if k % 6 and k in toxic]) >= 210 and {300, 301, 302, 303} <= set(toxic)
    assert set(near) == set(toxic) - {300, 301} and len(near) == len(set(near))
    assert set(clean) == set(near) - {1}
    assert set(mix) <= set(clean) - {302, 303}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(x.doc_id for x in out) == sorted(mix)
    assert brute.contamination([(k, t) for k, t, *_ in rows if k in set(mix)], [(7, "never")])


def test_no_rows(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
