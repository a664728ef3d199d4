from datetime import datetime

import pytest

from manualake.operators.references import either_key, find_orphans, orphan_report

T1, T2, T3 = (datetime(2024, m, 1) for m in (1, 2, 3))
REFS = "id long, a string, b string, at timestamp_ntz, key string"
KEYS = "x string, y string, at timestamp_ntz, gone timestamp_ntz, id long"


def orphans(spark, refs, keys, cols=("a",), onto=("x",), **more):
    df = find_orphans(
        spark.createDataFrame(refs, REFS), spark.createDataFrame(keys, KEYS), src="s", id_col="id", at_col="at", ref_cols=list(cols), key_cols=list(onto),
        arrived_col="at", deleted_col="gone", **more,
    )
    return sorted((r.rec_id, r.ingest_month, r.reason) for r in df.collect())


def test_reasons_and_normal_keys(spark):
    keys = [("k1", None, T1, None, 1), ("K2", None, T1, T3, 2), ("k3", None, T3, None, 3)]
    refs = [(1, " K1 ", None, T2, "c"), (2, "k2", None, T2, "c"), (3, "k3", None, T2, "c"), (4, "nix", None, T2, "c"), (5, None, None, T2, "c"), (6, " ", None, T2, "c")]
    assert orphans(spark, refs, keys) == [("2", "2024-02", "deleted"), ("3", "2024-02", "late"), ("4", "2024-02", "missing"), ("6", "2024-02", "missing")]


def test_repeated_deliveries_count_once_by_the_earliest(spark):
    keys = [("k", None, T2, None, 1), ("k", None, T3, None, 1)]
    assert orphans(spark, [(1, "k", None, T3, ""), (1, "k", None, T1, "")], keys) == [("1", "2024-01", "late")]


@pytest.mark.parametrize(("match", "found"), [("simple", []), ("partial", [("2", "2024-02", "missing")]), ("full", [("1", "2024-02", "missing"), ("2", "2024-02", "missing")])])
def test_match_semantics_of_partly_null_keys(spark, match, found):
    keys = [("k", "v", T1, None, 1)]
    refs = [(1, "k", None, T2, ""), (2, None, "w", T2, ""), (3, None, None, T2, ""), (4, "k", "v", T2, "")]
    assert orphans(spark, refs, keys, ("a", "b"), ("x", "y"), match=match) == found


def test_empty_tables_and_bad_match(spark):
    assert orphans(spark, [], [("k", None, T1, None, 1)]) == []
    assert orphans(spark, [(1, "k", None, T1, "")], []) == [("1", "2024-01", "missing")]
    with pytest.raises(ValueError):
        orphans(spark, [], [], match="some")


def test_null_time_and_id(spark):
    assert orphans(spark, [(None, "q", None, None, "")], [("k", None, T1, None, 1)]) == [(None, None, "missing")]


def test_report_and_alternative_keys(spark):
    books = spark.createDataFrame([("d1", "p1", T1, None), ("d2", None, T1, None)], "doc string, path string, at timestamp_ntz, gone timestamp_ntz")
    assert sorted(r.key for r in either_key(books, ["doc", "path"], "key").collect()) == ["d1", "d2", "p1"]
    df = spark.createDataFrame([("s", "1", "2024-01", "late"), ("s", "2", "2024-01", "late")], "src string, rec_id string, ingest_month string, reason string")
    assert [tuple(r) for r in orphan_report(df).collect()] == [("s", "2024-01", "late", 2)]
