"""Readers and sinks: explicit schemas, file-name keys, fingerprints, partitioned stores."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_arrays(spark: SparkSession, path: str, schema, recursive: bool = True) -> DataFrame:
    """Files that hold one JSON array each, by an explicit schema; bad files give no rows (A1, A2)."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", recursive)
    return reader.json(path)


def write_json_arrays(df: DataFrame, path: str, rows: int = 500) -> None:
    """df as files that hold one JSON array of about so many rows each; null fields are left out of the objects."""
    chunks = max(1, -(-df.count() // rows))
    dealt = df.select(F.to_json(F.struct("*")).alias("row"), F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).alias("chunk"))
    arrays = dealt.groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).mode("append").text(path)


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no bytes below path, which Spark's scans don't show: from the listing, hidden files left out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and status.getPath().getName()[0] not in "_.":
            out.append(status.getPath().toString())
    return sorted(out)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the elements of each file's JSON array as text; one row with a null record for a file that is
    empty, can't be read, or whose root is no array (C1). A file is read as one text."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    elements = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>"))
    records = texts.select("file", F.explode_outer(elements).alias("record"))
    nothing = [(f, None) for f in empty_files(spark, path)]
    return records.unionByName(spark.createDataFrame(nothing, "file string, record string")) if nothing else records


def bad_json_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """(file, rows, bad): the files read_json_arrays leaves out or finds empty, to warn about (A1, C1): bad counts
    records that don't parse, among them files whose root is no array of objects."""
    from pyspark.sql import types as T

    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(marked).option("multiLine", True).option("recursiveFileLookup", True).json(path).select("*", F.col("_metadata.file_path").alias("__file"))
    nothing = F.least(*[F.col(f"`{c}`").isNull().cast("int") for c in schema.fieldNames()], F.lit(1)) == 1
    found = rows.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("rows"), F.count_if(F.col("_corrupt_record").isNotNull() | nothing).alias("bad"))
    return found.where("bad > 0")


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors and the driver see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the folder of spark.checkpoint.dir and read from there by all that follows."""
    new_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the folder of spark.checkpoint.dir, read again: for wide or many rows, which a
    checkpoint (stored) would not compress. Readers get the columns they need. The shuffle files of the frame go when
    it is written."""
    spark, path, name = df.sparkSession, new_folder(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() table, and no others. All that was made of it must be written itself."""
    spark, files = df.sparkSession, df.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    ours = (spark.sparkContext.getCheckpointDir() or "").split(":", 1)[-1].strip("/")
    if len(folders) == 1 and ours and files[0].split(":", 1)[-1].strip("/").startswith(f"{ours}/"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most so many short rows, else with one for a shuffled join:
    Spark's own estimate doesn't see what explode adds. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def save_reported(df: DataFrame, path: str, kind: str, kinds: list[str], wrong: dict[str, Column] | None = None) -> dict[str, int]:
    """Writes df and returns the rows of each of the kinds, of other kinds ("other") and those that fail a check (by
    its name), all observed during the write: no second pass over the data."""
    from pyspark.sql import Observation

    seen = Observation()
    metrics = [F.count_if(F.col(kind) == k).alias(f"k{i}") for i, k in enumerate(kinds)]
    metrics.append(F.count_if(~F.coalesce(F.col(kind).isin(kinds), F.lit(False))).alias("other"))
    metrics += [F.count_if(c).alias(f"w{i}") for i, c in enumerate((wrong or {}).values())]
    df.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    found = seen.get
    out = {k: found[f"k{i}"] for i, k in enumerate(kinds)} | ({"other": found["other"]} if found["other"] else {})
    return out | {name: found[f"w{i}"] for i, name in enumerate(wrong or {})}


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """df as a table bucketed and sorted by a column: joins on it read it without a shuffle. There are as many buckets
    as shuffle partitions, so that the other side's partitions fit them. Its entry in the catalogue goes at once;
    the files stay in the folder of spark.checkpoint.dir."""
    spark, name = df.sparkSession, f"b_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", new_folder(spark)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return out


def with_file_key(df: DataFrame, out: str) -> DataFrame:
    """df with the number that is its file's name; rows of files named otherwise go (A3)."""
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1)
    return df.withColumn(out, F.nullif(key, F.lit("")).cast("long")).where(F.col(out).isNotNull())


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON object a line; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_tables(spark: SparkSession, folder: str, names: list[str], views: bool = True) -> dict[str, DataFrame]:
    """Parquet tables by name, lazily; a missing table is left out (A4)."""
    out = {}
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            if views:
                out[name].createOrReplaceTempView(name)
    return out


def save(df: DataFrame, path: str, force: bool = True, partition_by: list[str] | None = None) -> None:
    """Overwrites, or leaves an existing table alone if not force (A5)."""
    writer = df.write.mode("overwrite" if force else "ignore")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_profiles(profiles: DataFrame, collectives: DataFrame, folder: str, index_columns: list[str], key: str = "player_id", position: str = "position_group") -> None:
    """Profiles by profile_type and position, clustered by key; their index with lower-case names; team profiles.

    A partition's files hold ranges of keys, sorted, so that a read by position sees its folders only and one by
    key skips all row groups but one of these. A null position is a folder of its own.
    """
    spread = profiles.withColumn("position", F.col(position)).repartitionByRange("profile_type", "position", key).sortWithinPartitions("profile_type", "position", key)
    save(spread, f"{folder}/profiles", partition_by=["profile_type", "position"])
    save(profiles.select(*index_columns, F.lower("player_name").alias("name_lower")), f"{folder}/index")
    places = profiles.select(key, "profile_type", F.col(position).alias("position")).distinct()
    save(places.repartitionByRange(key).sortWithinPartitions(key), f"{folder}/places")
    save(collectives, f"{folder}/collectives")


def profiles_by(spark: SparkSession, folder: str, profile_type: str | None = None, position: str | None = None) -> DataFrame:
    """Stored profiles of a type and position, from their folders only."""
    df = spark.read.parquet(f"{folder}/profiles")
    df = df if profile_type is None else df.where(F.col("profile_type") == profile_type)
    return (df if position is None else df.where(F.col("position") == position)).drop("position")


def profile_of(spark: SparkSession, folder: str, value, key: str = "player_id") -> DataFrame:
    """The stored profiles of one key: its places first, a few rows from one row group, then those folders only."""
    places = spark.read.parquet(f"{folder}/places").where(F.col(key) == value).select("profile_type", "position").collect()  # of one key
    df, here = spark.read.parquet(f"{folder}/profiles"), F.lit(False)
    for r in places:
        here = here | (F.col("profile_type") == r["profile_type"]) & (F.col("position").isNull() if r["position"] is None else F.col("position") == r["position"])
    return df.where(here & (F.col(key) == value)).drop("position")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes, and edges by type (A10)."""
    save(nodes, f"{folder}/nodes")
    save(edges, f"{folder}/edges", partition_by=["edge_type"])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n) of each table: what a rebuild is decided by."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("dataset"), "n") for k, df in tables.items()])


def same_fingerprint(now: DataFrame, before: DataFrame, versions: dict[str, str], versions_before: dict[str, str]) -> bool:
    return versions == versions_before and now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty()


def content_fingerprint(df: DataFrame, partition: dict[str, Column]) -> DataFrame:
    """(the partition's columns, n, low, mix): rows of each partition, and the sum and exclusive or of a hash of each
    row, which don't depend on the order of rows, columns or files and can be added up over parts. A null differs
    from any value and from a null in another column."""
    columns = sorted(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])
    return df.groupBy(*[c.alias(n) for n, c in partition.items()]).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("low"), F.bit_xor(h).alias("mix"))


def changed_partitions(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_before, n_now, change): partitions of two content fingerprints that were added, removed or changed."""
    old = before.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("n", "low", "mix").alias("__was"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    j = now.withColumn("__is", F.struct("n", "low", "mix")).join(old, on, "full")
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(F.col("__was") != F.col("__is"), "changed")
    known = [F.when(F.col("__is").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return j.select(*known, F.coalesce(F.col("__was")["n"], F.lit(0)).alias("n_before"), F.coalesce(F.col("__is")["n"], F.lit(0)).alias("n_now"), change.alias("change")).where("change IS NOT NULL")


def load_summary(expected: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """One row: keys expected, loaded and missing."""
    keys = loaded.select(key).distinct()
    marked = expected.select(key).distinct().join(keys.withColumn("there", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("expected"), F.count_if("there").alias("loaded"), F.count_if(F.col("there").isNull()).alias("missing"))


def catalogue(competitions: DataFrame, name: str, season: str) -> DataFrame:
    """Competitions by name and season, each with their total."""
    total = competitions.agg(F.count("*").alias("total"))
    return competitions.crossJoin(F.broadcast(total)).orderBy(name, season)  # one row


def views(spark: SparkSession) -> list[str]:
    """Names of the registered views."""
    return sorted(t.name for t in spark.catalog.listTables())


def sql(spark: SparkSession, query: str, **params) -> DataFrame:
    return spark.sql(query, args=params)
