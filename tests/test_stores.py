"""The profile store's pruned reads, content fingerprints and the lineage of keys."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortry.operators.quality import lineage
from cohortry.sources import tables as S


def test_profile_reads_are_pruned(spark, tmp_path):
    rows = [(i, kind, ["Winger", "Striker", None][i % 3], f"Name {i}", i * 1.0) for i in range(600) for kind in ("season", "career")]
    profiles = spark.createDataFrame(rows, "player_id long, profile_type string, position_group string, player_name string, score double")
    S.save_profiles(profiles, profiles.limit(1), str(tmp_path), ["player_id", "player_name"])
    text = S.profiles_by(spark, str(tmp_path), "season", "Winger")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(profile_type" in text and "(position" in text.split("PartitionFilters")[1].split("]")[0]
    assert S.profiles_by(spark, str(tmp_path), "season", "Winger").count() == 200 and S.profiles_by(spark, str(tmp_path), position="Striker").count() == 400
    one = S.profile_of(spark, str(tmp_path), 302)
    assert sorted(map(tuple, one.select("player_id", "profile_type", "position_group", "player_name").collect())) == [(302, "career", None, "Name 302"), (302, "season", None, "Name 302")]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(player_id,302)" in scan and "position" in scan.split("PartitionFilters")[1]
    assert S.profile_of(spark, str(tmp_path), 9999).isEmpty() and S.profile_of(spark, str(tmp_path), 301).columns == profiles.columns[:1] + ["position_group", "player_name", "score", "profile_type"]
    # Within a type and position the row groups' ranges of keys don't overlap: a lookup needs one.
    for folder in glob.glob(f"{tmp_path}/profiles/*/*"):
        stats = [pq.ParquetFile(f).metadata.row_group(g).column(0).statistics for f in glob.glob(f"{folder}/*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
        ranges = sorted((s.min, s.max) for s in stats)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_content_fingerprint(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", None, "y"), ("b", 2, None), (None, 3, "z")]
    schema = "k string, v int, w string"
    of = lambda rows, cols=("k", "v", "w"): S.content_fingerprint(spark.createDataFrame(rows, schema).select(*cols).repartition(3), {"k": F.col("k")})
    base = of(rows)
    changes = lambda other: {tuple(r) for r in S.changed_partitions(base, other, ["k"]).collect()}
    assert changes(of(rows[::-1])) == changes(of(rows, ("w", "k", "v"))) == set()
    assert changes(of([("a", 1, "x"), ("a", 1, "q"), *rows[2:]])) == {("a", 3, 3, "changed")}
    assert changes(of([*rows[:3], ("b", None, "2"), ("c", 1, "1")])) == {("b", 1, 1, "changed"), ("c", 0, 1, "added"), (None, 1, 0, "removed")}
    # The same rows as often as before, but for one copy of a pair.
    assert changes(of([*rows[1:], ("a", None, "y")])) == {("a", 3, 3, "changed")}


def test_lineage(spark):
    one = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, None, 7), (None, "n", 1), (3, None, 7)], "id int, a string, b int")
    two = spark.createDataFrame([(1, "x", 2.0), (3, None, 3.0), (None, "m", 1.0), (9, "new", 1.0)], "id int, a string, c double")
    three = spark.createDataFrame([(1, 2.5), (2, 1.0), (9, 1.0)], "id int, c double")
    got = {r["id"]: r for r in lineage([("one", one), ("two", two), ("three", three)], "id").collect()}
    assert [(k, got[k]["stages"], got[k]["lost"], got[k]["rows"]) for k in (1, 2, 3, None, 9)] == [
        (1, ["one", "two", "three"], None, 1), (2, ["one", "three"], "two", 1), (3, ["one", "two"], "three", 2), (None, ["one", "two"], "three", 1), (9, ["two", "three"], None, 1),
    ]
    assert [tuple(x) for x in got[1]["differences"]] == [("c", "2.0", "2.5", "three")] and got[3]["differences"] == got[9]["differences"] == []
    assert [tuple(x) for x in got[None]["differences"]] == [("a", "n", "m", "two")]


def test_raw_files_with_faults(spark, tmp_path):
    import json

    import pytest

    from cohortry.operators import quality as Q
    from cohortry.sources.tables import bad_json_files, raw_records, read_json_arrays, with_file_key, write_json_arrays
    from pyspark.sql import types as T

    event = {"id": "x", "index": 1, "type": {"id": 3, "name": "Pass"}, "minute": 0, "second": None}
    files = {"a/11.json": json.dumps([event, {**event, "id": "y"}]), "a/12.json": json.dumps([{"id": "z", "note": "no [keys]"}]), "b/13.json": json.dumps({"id": "root"}), "b/14.json": '[{"id": "cut', "b/15.json": "", "b/x.json": json.dumps([7, event])}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    records = raw_records(spark, str(tmp_path))
    found = {}
    for r in records.collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["record"])
    assert sorted(k for k, v in found.items() if v == [None]) == ["13.json", "14.json", "15.json"] and len(found["11.json"]) == 2
    missing = {(r["file"].rsplit("/", 1)[1], json.loads(r["record"])["id"] if r["record"][0] == "{" else r["record"]): r["missing"] for r in Q.key_faults(records, "event").collect()}
    # A key with a null value is there; what is no object lacks all keys.
    assert missing == {("11.json", "x"): [], ("11.json", "y"): [], ("12.json", "z"): ["index", "type", "minute", "second"], ("x.json", "x"): [], ("x.json", "7"): Q.REQUIRED_KEYS["event"]}
    schema = T.StructType.fromDDL("id string, index long, minute long")
    bad = {r["file"].rsplit("/", 1)[1] for r in bad_json_files(spark, str(tmp_path), schema).collect()}
    assert {"14.json", "x.json"} <= bad and not bad & {"11.json", "12.json"}
    rows = with_file_key(read_json_arrays(spark, str(tmp_path / "a"), schema), "match_id").collect()
    assert sorted((r["id"], r["match_id"]) for r in rows) == [("x", 11), ("y", 11), ("z", 12)]
    with pytest.raises(KeyError):
        Q.key_faults(records, "nothing")
    # Written arrays read back as they were, but for null fields.
    df = spark.createDataFrame([(i, None if i % 3 else f"n{i}") for i in range(1300)], "id long, name string")
    write_json_arrays(df, str(tmp_path / "out"))
    assert len(glob.glob(f"{tmp_path}/out/*.txt")) == 3
    back = read_json_arrays(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    faults = Q.column_faults(df, "competition", {"id": "bigint", "name": "int", "season_id": "bigint"}).collect()
    assert [tuple(r) for r in faults] == [("competition", "warning", "name", "string", "int"), ("competition", "error", "season_id", None, "bigint")]
