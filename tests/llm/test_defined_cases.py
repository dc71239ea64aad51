"""Empty tables, repeated rows, ties and very long inputs of the operators that learn or pack."""

from __future__ import annotations

import pytest

from sightline.llm import embedding_dedup, language_id, packing, quality, queries, simhash, url_filter

SMALL = "/root/testdata/sf0.001"
LONG = "the quick brown fox and the lazy dog " * 20_000


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.net/" + "a" * 300_000), (2, "http://x.net/"), (2, "http://x.net/"), (3, None)], "page_id long, url string")
    rows = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages).collect()), key=str)
    assert [r[:2] for r in rows] == [(1, "net/"), (2, "net/"), (2, "net/"), (3, None)] and rows[0][2] == "block"
    assert url_filter.judge(pages.limit(0)).collect() == []
    none = spark.createDataFrame([], "url string, label int")
    assert {(r.score, r.verdict) for r in url_filter.judge(pages, none).filter("page_id = 3").collect()} == {(0.5, "allow")}


def test_language(spark):
    docs = queries.table(spark, SMALL, "documents")
    more = spark.createDataFrame([(10_001, LONG, None), (10_002, LONG, None), (10_002, LONG, None), (10_003, "", None)], "doc_id long, text string, lang string")
    found = {}
    for r in language_id.language_id(docs.select("doc_id", "text", "lang").unionByName(more)).filter("doc_id > 10000").collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found[10_001][0][0] == "en" and found[10_001] * 2 == found[10_002] and found[10_003] == [("und", 0.0)]
    assert language_id.language_id(docs.limit(0)).collect() == []


def test_quality(spark):
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    more = spark.createDataFrame([(10_001, LONG), (10_001, LONG), (10_002, None)], "doc_id long, text string")
    found = [r for r in quality.quality(docs.unionByName(more, allowMissingColumns=True), labels).collect() if r.doc_id > 10_000]
    long = {(r.score, r.predicted) for r in found if r.doc_id == 10_001}
    assert len(found) == 3 and len(long) == 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_simhash_ties(spark):
    docs = spark.createDataFrame([(2, LONG), (1, LONG), (1, LONG), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_packing_of_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, None)], "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    one = sorted((p.piece, p.start, p.length) for p in pieces if p.doc_id == 1)
    assert one[::2] == one[1::2] and all(p[2] == packing.CAPACITY for p in one[2:]) and one[-1][1] + one[-1][2] > 150_000
    assert [p.length for p in pieces if p.doc_id == 2] == [1]


def test_embedding_ties(spark):
    """1 and 2 have exactly the threshold, 0.6; rows that share an id and a vector link, too."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, -1.0])]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.6, recall=0.999999).collect())
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("name", ["op3_simhash_near_dedup", "op4_license_scan", "op6_quality", "op10_url_filter"])
def test_queries_answer_for_each_row(spark, name):
    """The queries themselves, over their whole small tables."""
    table = "pages" if name.startswith("op10") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    found = queries.queries()[name](spark, SMALL)
    ids = sorted(r[0] for r in found.select(key).distinct().collect())
    assert set(ids) <= {r[0] for r in queries.table(spark, SMALL, table).select(key).collect()}
    if name != "op4_license_scan":
        assert found.count() == queries.table(spark, SMALL, table).count()
