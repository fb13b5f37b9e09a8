"""The digest index: lots against a plain version, persistence, repeated lots, plans."""

import hashlib
import random
import re
from collections import Counter

import pytest

from sparkyard.llm.exact_dedup import DigestIndex, dedup_in_lots, digests
from sparkyard.llm.queries import op13_exact_dedup


def form(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain(rows):
    """(id, keep_id, group_size, kept, form) of every row."""
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(form(t), []).append(i)
    out = []
    for f, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, f) for k, i in enumerate(ids)]
    return out


def rows():
    r = random.Random(1)
    out = [(i, r.choice(["", None, " ", "\t\n", "a b", "a  b", "a b", "a\x1cb", "A b", f"own {i}", f"pair {i // 2}", "x" * 200_000]), i) for i in range(400)]
    return [*out, (5, "a b", 1), (5, "a b", 1), (None, "a b", 2), (None, "only null", 3), (None, "only null", 3)]


def digest(text):
    return hashlib.sha256(form(text).encode()).digest()


def shown(placed):
    return Counter((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in placed.collect())


def wanted(rows_):
    return Counter((i, k, n, kept, hashlib.sha256(f.encode()).digest()) for i, k, n, kept, f in plain(rows_))


@pytest.mark.parametrize("lots", [1, 2, 5])
def test_lots_equal_the_plain_version(spark, tmp_path, lots):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, digest int")
    assert shown(dedup_in_lots(docs, str(tmp_path), lots)) == wanted(rows())


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id bigint, text string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op13_exact_dedup(spark, str(tmp_path)).collect()))
    assert got == Counter((i, k, n, kept, hashlib.sha256(f.encode()).hexdigest()) for i, k, n, kept, f in plain(rows()))


def test_new_lots_meet_the_texts_of_old_ones(spark, tmp_path):
    """The index outlives its session object; what came first stays, though its id is larger."""
    make = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string")
    DigestIndex(spark, str(tmp_path), buckets=3).add(make((9, "a b"), (8, "c")), "monday")
    spark.sql(f"DROP TABLE {DigestIndex(spark, str(tmp_path)).table}")  # as in a new session; the files stay
    index = DigestIndex(spark, str(tmp_path))
    index.add(make((1, "a\tb"), (2, "d"), (3, "d")), "tuesday")
    index.add(make(), "wednesday")
    assert index.buckets == 3
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in index.placed(["monday", "tuesday", "wednesday"]).collect()} == {(9, 9, 2, True), (8, 8, 1, True), (1, 9, 2, False), (2, 2, 2, True), (3, 2, 2, False)}
    assert index.entries().count() == 3
    files = {p.name.split(".")[0][-5:] for p in (tmp_path / "index").glob("part-*")}
    assert files <= {f"{b:05d}" for b in range(3)}


def test_a_repeated_lot_changes_nothing(spark, tmp_path):
    docs, index = spark.createDataFrame(rows(), "doc_id bigint, text string, x int"), DigestIndex(spark, str(tmp_path))
    index.add(docs, "one")
    first = shown(index.placed(["one"]))
    index.add(docs, "one")
    assert shown(index.placed(["one"])) == first == wanted(rows())
    # a lot that broke off between its digests and the index
    index.spark.sql(f"DROP TABLE {index.table}")
    import shutil

    shutil.rmtree(tmp_path / "index")
    again = DigestIndex(spark, str(tmp_path))
    again.add(docs, "one")
    assert shown(again.placed(["one"])) == first


def test_index_is_joined_where_it_lies(spark, tmp_path):
    """A sort-merge anti-join with one shuffle of the new digests to the buckets and none of the index."""
    index = DigestIndex(spark, str(tmp_path), buckets=5)
    index.add(spark.createDataFrame(rows(), "doc_id bigint, text string, x int"), "one")
    groups = spark.read.parquet(f"{tmp_path}/groups/one")
    plan = index._fresh(groups, "two")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_empty_table_and_odd_names(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dedup_in_lots(docs, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        DigestIndex(spark, str(tmp_path)).add(docs, "../x")
    with pytest.raises(ValueError):
        DigestIndex(spark, f"{tmp_path}/none").entries()
    assert digests(docs).columns == ["id", "digest"]
