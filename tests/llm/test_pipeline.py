"""The pipeline's stages against plain versions on a planted corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import toxicity

from .test_dealt import check_packing, plain_components, plain_contained, plain_simhash, planted_toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    docs, labels = planted_toxicity(400)
    n = len(docs)
    docs += [(n + i, docs[i][1]) for i in range(30)]  # exact copies
    long = [d for d in docs if len(d[1].split()) > 250][:10]
    docs += [(n + 30 + i, t + " tail") for i, (_, t) in enumerate(long)]  # near copies
    item = " ".join(f"q{rng.randrange(999)}" for _ in range(30))
    docs += [(n + 40 + i, f"intro {rng.random()} {item} outro") for i in range(5)]
    docs += [(n + 50, "mail bob.smith@example.com card 4418452524842581"), (n + 51, ""), (n + 52, None)]
    where = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table = table.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "not in any document at all here")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), table, dict(docs), item


def test_stages(spark, corpus):
    where, table, texts, item = corpus
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(table, spark.read.parquet(f"{where}/labels.parquet").where(toxicity.learnable()))
    clean = stages["toxicity"](spark, table, where)
    want = {i for i, t in texts.items() if model.scores([t])[0] < 0.7}
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == want

    once = stages["simhash_near_dedup"](spark, clean, where)
    components = plain_components({i: plain_simhash(texts[i]) for i in want})
    want = {i for i, c in components.items() if i == c}
    assert once.columns == table.columns and {r.doc_id for r in once.collect()} == want

    free = stages["decontamination"](spark, once, where)
    want -= {i for i, _ in plain_contained([(i, texts[i]) for i in want], [(1, item)])}
    assert {r.doc_id for r in free.collect()} == want

    private = stages["pseudonyms"](spark, free, where)
    got = {r.doc_id: r for r in private.collect()}
    assert private.columns == table.columns and private.schema == table.schema and set(got) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.values())
    assert not any("bob.smith" in (r.text or "") or "4418452524842581" in (r.text or "") for r in got.values())

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    ids = {i: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for i, r in got.items()}
    check_packing(stages["packing"](spark, private, where).collect(), ids)
    whole = corpus_pipeline.run(spark, where)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == want


def test_empty_corpus(spark, corpus, tmp_path):
    where, table, _, _ = corpus
    table.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
