"""Exact dedup and sharding against brute force."""

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from cladewise.llm import exact_dedup, sharding  # noqa: E402
from cladewise.llm.common import bitmap, components, may_hold  # noqa: E402


def by_text(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc)
    return groups


def test_every_row_is_marked(spark):
    found = exact_dedup.mark_copies(cases.documents(spark), F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")).collect()
    groups = by_text(cases.rows())
    want = Counter()
    for doc, text, *_ in cases.rows():
        same = groups[text or ""]
        keep = max((d for d in same if d is not None), default=None)
        want[doc, keep, len(same), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.d) for r in found) == want


def test_one_row_of_each_text_stays_with_its_columns(spark):
    docs = cases.documents(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted(by_text(cases.rows()))
    assert {r.kept for r in rows} == {"x"}


def test_groups_name_only_copies(spark):
    found = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.copy_groups(cases.documents(spark)).collect()}
    want = {
        hashlib.sha256(t.encode()).hexdigest(): (max(d for d in ids if d is not None), len(ids))
        for t, ids in by_text(cases.rows()).items() if len(ids) > 1
    }
    assert found == want


def test_same_length_and_prefix_but_other_text(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "x"), (2, "a" * 300 + "y"), (3, "a" * 300 + "x")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(docs).collect()}
    assert found == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


def test_no_documents(spark):
    empty = cases.no_documents(spark)
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns
    assert sharding.sharded(empty.select("doc_id"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 97, 1000, 1023])
def test_permutation_and_inverse(spark, rows):
    frame = spark.range(rows).withColumn("p", sharding.permuted(F.col("id"), rows, 3))
    frame = frame.withColumn("back", sharding.inverse(F.col("p"), rows, 3))
    found = frame.collect()
    assert sorted(r.p for r in found) == list(range(rows))
    assert all(r.back == r.id for r in found)


def test_permutation_depends_on_the_seed(spark):
    frame = spark.range(200).select(sharding.permuted(F.col("id"), 200, 1).alias("a"), sharding.permuted(F.col("id"), 200, 2).alias("b"))
    assert sum(r.a == r.b for r in frame.collect()) < 20


def test_shards_and_slots(spark):
    rows = cases.documents(spark).select("doc_id", "text", F.lit("clash").alias("shards"))
    found = sharding.sharded(rows, ["doc_id", "text"], shards=16).collect()
    assert len(found) == len(cases.rows())
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sizes[shard]))
    order = [(r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in sorted(found, key=lambda r: r.row_number)]
    assert order == sorted(order)
    again = sharding.sharded(rows.repartition(7), ["doc_id", "text"], shards=16).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in found) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)


def test_equal_rows_get_places_of_their_own(spark):
    rows = spark.range(100).select(F.lit(None).cast("long").alias("doc_id"))
    assert sorted(r.place for r in sharding.sharded(rows, ["doc_id"]).collect()) == list(range(100))


def test_bitmap_loses_nothing(spark):
    some = spark.range(0, 1000, 7)
    held = may_hold(spark.range(1000), F.col("id"), bitmap(some, F.col("id"), 16), 16)
    assert {r.id for r in some.collect()} <= {r.id for r in held.collect()}
    assert may_hold(spark.range(1000), F.col("id"), bitmap(some, F.col("id"))).count() < 200


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_crc_of_the_query_is_unsigned(spark):
    text = next(t for t in map(str, range(100)) if zlib.crc32(t.encode()) > 1 << 31)
    assert spark.range(1).select(F.crc32(F.encode(F.lit(text), "UTF-8"))).first()[0] == zlib.crc32(text.encode())
