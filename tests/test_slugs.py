"""Slugs of many words: every expanding character, and one slug made per distinct word."""

import unicodedata

from pyspark.sql import functions as F

from doorstep.checks import load_all
from doorstep.functions import text


def test_unaccented_covers_the_plane(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    _, _, _, expanding = text._decompositions()
    rows = [(c, f"a{c}z") for c in chars]
    df = spark.createDataFrame(rows, "c string, w string").select("c", text.unaccented(F.col("w")).alias("u"))
    for r in df.collect():
        if r.c in expanding:
            assert r.u == f"a{expanding[r.c]}z"
        elif unicodedata.combining(r.c):
            assert r.u == "az"
    assert text._ranges("acbx") == r"\x{61}-\x{63}\x{78}-\x{78}"


def test_a_word_is_made_a_slug_once(spark, tmp_path):
    rows = [(1, "Café cafe -- ½ ﬁsh"), (2, None), (3, ""), (4, "cafe__ 日本")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = load_all()["page_word_slugs"].run(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("cafe", 3), ("1_2", 1), ("fish", 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Neither a filter below nor a second branch makes it again.
    assert plan.count("translate(") == 1
