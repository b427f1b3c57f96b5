"""Archives, the similarity join and the pipeline against brute force."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from cladewise.llm import language_id, ngram_join, queries, warc  # noqa: E402
from cladewise.llm.common import training_fold  # noqa: E402
from cladewise.session import scratch_path  # noqa: E402

PAGES = "page_id long, url string, html string, digest string, block string"


def pages():
    big = "".join(f"<p>{i} é日本</p>\r\n" for i in range(900))
    rows = [
        (1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, None), (4, "http://c/", ""),
        (5, "http://d/", big), (6, "http://e/", big), (7, "http://f/", big + "x"),
        (8, "http://g/WARC/1.1", "y" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "WARC/1.1" * 300),
        (9, "http://h/\r\nX-Record-Key: 99", "WARC/1.1"), (None, "http://i/", big), (None, "http://j/", "q" * 999),
        (10, "http://k/", "0\r\n\r\n" * 300), (4, "http://c/", ""), (12, "http://l/", "é" * 500), (13, "http://m/", "é" * 500),
    ]
    return [(*r, "clash", "clash") for r in rows]


@pytest.mark.parametrize("segment,chunk", [(32_768, 4_096), (700, 100), (97, 7)])
def test_archives_read_back(spark, segment, chunk):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(pages(), PAGES).repartition(3), path, segment_bytes=segment, chunk_bytes=chunk)
    found = warc.read_pages(spark, path).collect()
    assert len(found) == len(pages()) and all(r.complete for r in found)
    payloads = {r.record_id: bytes(r.payload) for r in found if r.record_type == "response"}
    keys = {r.record_id: r.record_key for r in found}
    got, want = Counter(), Counter()
    for r in found:
        data = bytes(r.payload) if r.record_type == "response" else payloads[r.refers_to]
        assert hashlib.sha1(data).hexdigest() == r.digest
        got[r.record_key, data.decode(), r.record_type, keys.get(r.refers_to)] += 1
    largest = {}
    for page, _, html, *_ in pages():
        data = html or ""
        if len(data.encode()) >= 1000 and page is not None:
            largest[data] = max(largest.get(data, page), page)
    for page, _, html, *_ in pages():
        data, name = html or "", None if page is None else str(page)
        revisit = data in largest and largest[data] != page
        want[name, data, "revisit" if revisit else "response", str(largest[data]) if revisit else None] += 1
    assert got == want


def test_a_missing_segment_is_seen(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(pages()[4:5], PAGES), path, segment_bytes=500)
    records = warc.read_records(spark, path)
    assert records.count() > 5
    assert [r.complete for r in warc.reassembled(records).collect()] == [True]
    for lost in (1, 3):
        assert [r.complete for r in warc.reassembled(records.where(f"segment <> {lost}")).collect()] == [False]
    last = records.agg(F.max("segment")).first()[0]
    assert [bool(r.complete) for r in warc.reassembled(records.where(f"segment <> {last}")).collect()] == [False]


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_payload(head + b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.http_payload(head + b"0\r\n\r\n") == b""
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    for broken in (b"3\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.http_payload(head + broken) is None
    assert warc.http_payload(b"no header") is None


def test_no_pages(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def plain_components(rows, words, percent):
    """(doc_id, set size, component) of each row, by comparing all pairs."""
    sets = [(d, shingles(t, words)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def near_groups():
    """Large groups of near copies whose members often don't link directly, and unrelated texts."""
    import random

    draw, rows = random.Random(7), []
    for group in range(3):
        base = cases.sentence(cases.EN, 150, 1000 + group).split()
        for i in range(40):
            words = list(base)
            for _ in range(draw.choice([1, 2, 4, 8, 15])):
                words[draw.randrange(len(words))] = f"w{draw.random()}"
            rows.append((len(rows), " ".join(words)))
        for i in range(4):
            rows.append((len(rows), " ".join(base)))
    return rows + [(1000 + i, cases.sentence(cases.EN, 12, i)) for i in range(60)]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_links_equal_all_pairs(spark, words, percent):
    for rows, schema in ((near_groups(), "doc_id long, text string"), (cases.rows(), cases.SCHEMA)):
        docs = spark.createDataFrame(rows, schema).repartition(4)
        found = ngram_join.linked_components(docs, ngram_join.Rule(words, percent)).collect()
        want = plain_components(rows, words, percent)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_one_document_of_each_component_stays(spark):
    docs = cases.documents(spark)
    kept = ngram_join.representatives(docs, ngram_join.Rule())
    assert kept.columns == docs.columns
    want = plain_components(cases.rows(), 5, 80)
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in want if d == c} | {None}


def test_no_documents(spark):
    assert ngram_join.linked_components(cases.no_documents(spark)).count() == 0
    assert ngram_join.representatives(cases.no_documents(spark)).count() == 0


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = cases.documents(spark)
    spark.createDataFrame([(10, 1), (None, 1), (12, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    language = stages[0](spark, docs, str(tmp_path))
    assert language.columns == docs.columns
    learned = language_id.learn(docs.where(training_fold(F.col("doc_id"))))
    assert learned.langs == ["de", "en"]
    want = Counter((d, t) for d, t, *_ in cases.rows() if t and any(c.isalpha() for c in t))
    assert Counter((r.doc_id, r.text) for r in language.collect()) == want
    # One class of labels only: nothing is called toxic.
    toxic = stages[1](spark, language, str(tmp_path))
    assert toxic.columns == docs.columns and toxic.count() == sum(want.values())
    exact = stages[2](spark, docs, str(tmp_path))
    assert exact.columns == docs.columns and exact.count() == len({t or "" for _, t, *_ in cases.rows()})
    near = stages[3](spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert stages[4](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({r[0] for r in cases.rows()})


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_keeps_texts_where_no_language_is_known(spark, tmp_path, lang):
    docs = cases.documents(spark).withColumn("lang", F.lit(lang).cast("string"))
    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    want = Counter((d, t) for d, t, *_ in cases.rows() if t and any(c.isalpha() for c in t))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_columns_named_like_an_operator_stay(spark, tmp_path):
    docs = cases.documents(spark).withColumn("_language", F.lit("mine")).withColumn("_toxicity", F.lit("also mine")).withColumn(
        "row", F.lit(3))
    spark.createDataFrame([(d, i % 2) for i, d in enumerate(range(10, 30))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.select("_language", "_toxicity", "row").distinct().collect() == [("mine", "also mine", 3)], name
    assert corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).count() > 0


def test_pipeline_runs_and_survives_an_empty_table(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder)
    kept = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert 0 < len(kept) < len(texts)
    assert len({texts[d] for d in kept}) == len(kept)
    cases.no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_numbered_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.BUILDERS) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.BUILDERS} == set(range(1, 14))
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())
