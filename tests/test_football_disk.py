"""Profiles are written compressed, and what only led to them goes."""

from cohortry.operators import marts
from cohortry.plans import football as P
from test_marts import tables  # noqa: F401  (a fixture)


def test_profiles_leave_one_parquet_table(spark, tables, monkeypatch):  # noqa: F811
    paths = []
    for name in ("written", "stored"):
        made = getattr(P, name, None)
        if made:
            monkeypatch.setattr(P, name, lambda df, made=made: paths.append(made(df)) or paths[-1])
    p = P.profiles(spark, P.vectors(marts.player_summary(*tables)))
    assert p.count() > 0 and p.inputFiles() and all(f.endswith(".zstd.parquet") for f in p.inputFiles())
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = [hadoop.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(f)) for f in (f for df in paths[:-1] for f in df.inputFiles())]
    assert len(paths) == 3 and not any(there)


def test_forget_deletes_written_tables_only(spark, tmp_path):
    from cohortry.sources.tables import forget, written

    spark.range(5).write.parquet(f"{tmp_path}/input")
    theirs, ours = spark.read.parquet(f"{tmp_path}/input"), written(spark.range(5).toDF("n"))
    forget(theirs.where("id > 1"))
    assert theirs.count() == 5 and ours.count() == 5
    forget(ours)
    assert list(tmp_path.glob("input/*.parquet"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(ours.inputFiles()[0]).getParent()
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_scores_are_written_compressed(spark):
    from cohortry.plans.base import entity_scores

    files = entity_scores(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
