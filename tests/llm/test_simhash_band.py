"""SimHash links bring texts together in the pipeline's near-copy stage, without any MinHash band."""

from pyspark.sql import functions as F

from colloquy.llm import near_duplicates
from tests.llm import odd


def test_simhash_links_alone_bring_near_copies_together(spark, monkeypatch):
    base = odd.words(400, 4)
    near = base[:-1] + ["other"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(odd.words(400, 5)))]
    # Bands that never agree: what meets does so by its fingerprint.
    monkeypatch.setattr(near_duplicates, "_keys_udf", lambda k: lambda text: F.array(F.xxhash64(text)))
    got = {x.doc_id: x.component_id for x in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
