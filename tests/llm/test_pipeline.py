"""The pipeline's stages against plain Python, each on its predecessor's rows."""

import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm import odd
from tests.llm.test_chunk_stretches import plain_without_stretches
from tests.llm.test_near_duplicates import plain_groups
from tests.llm.test_text_operators import plain_hits


def test_stages_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    given = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, docs, sf)
        assert df.columns == columns, name
        docs = spark.createDataFrame(df.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert len(after) >= 0.97 * len(rows) and all(after[d] == rows[d] for d in after)
        if name == "simhash_near_dedup":
            assert set(after) == set(plain_groups([(d, r.text) for d, r in rows.items()]).values())
        if name == "substring_dedup":
            assert {d: r.text for d, r in after.items()} == plain_without_stretches([(d, r.text) for d, r in rows.items()])
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "benchmark_decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            judged = plain_hits([(d, r.text) for d, r in rows.items()], bench)
            assert set(after) == {d for d, x in judged.items() if not x[3]}
        rows = after
    lib = Tokenizer.from_file(corpus_pipeline.bpe.vocabulary_path(corpus_pipeline.VOCABULARY))
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert set(last) == set(rows) and 0 < len(last) < len(given)
    for d, r in rows.items():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert last[d].ids == ids and last[d].n_tokens == len(ids)
        assert last[d].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {d: r.ids for d, r in last.items()}


def test_stages_of_odd_rows(spark, sf):
    for docs in (odd.docs(spark), odd.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            assert n <= len(odd.ROWS) and (docs.count() or not n), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
