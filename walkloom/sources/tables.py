"""Readers and writers: labelled CSV, run metrics, training logs, graph tables, and result tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "struct<epoch:int,lr:double,train_mse:double,valid_mae:double,dt_sec:double,improved:boolean>"
METRICS = f"config struct<target:string,seed:int,m:int,n_splits:int,n_total:int,y_mean:double,y_std:double>, splits array<struct<split:int,epochs_run:int,best_valid_mae:double,test_mae:double,final_test_mae:double,best_test_mae:double,epochs:array<{EPOCH}>>>, test_mae double, mean_test_mae double, best_test_mae double, summary struct<mean_test_mae:double,std_test_mae:double,mean_valid_mae:double,total_wall_sec:double,peak_gpu_mem_mb:double>"


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on a local master without that setting, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-walkloom-"))
    return "file://" + _own[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def valid_rows(df: DataFrame, y: Column, parsed: Column | None = None) -> DataFrame:
    """The rows whose y is a number and whose structure could be read; a null flag is a no."""
    ok = y.isNotNull() & ~F.isnan(y.cast("double"))
    return df.where(ok if parsed is None else ok & F.coalesce(parsed, F.lit(False)))


def read_labelled_csv(spark: SparkSession, path: str, idx_text: int, idx_y: int) -> DataFrame:
    """text and y by ordinal (negative from the end); rows without a number as y are dropped."""
    df = spark.read.option("header", True).csv(path)
    y = F.expr(f"try_cast(`{df.columns[idx_y]}` as double)")
    return valid_rows(df.select(F.col(f"`{df.columns[idx_text]}`").alias("text"), y.alias("y")), F.col("y"), F.col("text").isNotNull())


def run_keys(path: Column) -> list[Column]:
    """model, m, target, seed from a path .../<model>_m<m>/<target>/split<seed>/<file>, also with names before the values (a=<model>_m<m>/...); the
    model may be missing, and all are null elsewhere."""
    shape = r"(?:^|/)(?:[^/=]+=)?([^/=]*?)_?m([0-9]+)/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?(?:split|seed)([0-9]+)/[^/]+$"
    part = lambda k: F.nullif(F.regexp_extract(path, shape, k), F.lit(""))
    return [part(1).alias("model"), part(2).cast("int").alias("m"), part(3).alias("target"), part(4).cast("int").alias("seed")]


def read_run_metrics(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """One row per readable metrics file below root, with its path and the keys that stand in the path; only a file's first JSON object counts.
    Files whose first object is cut off, or that hold no object or no result, are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    # The parser stops after the first object; one that breaks off before its end is kept as corrupt.
    read = files.select("path", F.from_json("value", f"{METRICS}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r is not null and r._corrupt is null")
    read = read.withColumn("r", F.col("r").dropFields("_corrupt"))
    return read.where("r is not null and (r.summary is not null or r.splits is not null or r.test_mae is not null)").select("path", *run_keys(F.col("path")), "r.*")


def parsed_log(line: Column) -> Column:
    """Struct of an epoch line; run is null for other lines. lr is optional, a star at the end marks an improvement."""
    part = lambda p: F.regexp_extract(line, p, 1)
    number = lambda p: F.nullif(part(p), F.lit("")).cast("double")
    ok = line.rlike(r"^\[[^\]]+\] split +\d+ epoch +\d+ .*train_mse=\S+ valid_mae=\S+ dt=[0-9.]+s")
    return F.when(ok, F.struct(part(r"^\[([^\]]+)\]").alias("run"), part(r"split +(\d+)").cast("int").alias("split"), part(r"epoch +(\d+)").cast("int").alias("epoch"), number(r" lr=(\S+)").alias("lr"), number(r"train_mse=(\S+)").alias("train_mse"), number(r"valid_mae=(\S+)").alias("valid_mae"), number(r"dt=([0-9.]+)s").alias("dt_sec"), line.rlike(r"\*\s*$").alias("improved")))


def read_train_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(root).select(parsed_log(F.col("value")).alias("e")).where("e is not null").select("e.*")


NODES, EDGES, TARGETS = {"g": "long", "v": "int", "z": "int"}, {"g": "long", "u": "int", "v": "int"}, {"g": "long", "y": "array<double>"}


def read_graph_tables(spark: SparkSession, nodes: str, edges: str, targets: str | None = None) -> tuple[DataFrame, ...]:
    """Nodes (g, v, z), edges (g, u, v) and targets (g, y) in these types, further columns after them. A missing column is an error here, a value
    that does not fit its type an error when it is read."""
    found = []
    for path, schema in ((nodes, NODES), (edges, EDGES), (targets, TARGETS)):
        if path:
            df = spark.read.parquet(path)
            missing = [c for c in schema if c not in df.columns]
            if missing:
                raise ValueError(f"{path} has no column {', '.join(missing)}")
            found.append(df.select(*[F.col(c).cast(t) for c, t in schema.items()], *[c for c in df.columns if c not in schema]))
    return tuple(found)


def written_targets(spark: SparkSession, path: str) -> DataFrame:
    """target, n: the partitions that are under path and their rows; none if nothing is there yet."""
    try:
        found = spark.read.schema("g long, value double, target string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "target string, n long")
    return found.groupBy("target").agg(F.count("*").alias("n"))


def write_target_tables(df: DataFrame, path: str, names: list[str]) -> None:
    """Rows (g, y array) as one partition per target name. Targets that stand under path with all their rows are left alone; others, also those of
    which a run that broke off left a part, are written whole in their place. So a retry ends in the same tables."""
    target = F.get(F.array(*map(F.lit, names)), F.col("k"))
    rows = df.select("g", F.posexplode("y").alias("k", "value")).select("g", F.col("value").cast("double").alias("value"), target.alias("target")).where("target is not null")
    wanted = rows.groupBy("target").agg(F.count("*").alias("n"))  # a row for each name
    open_ = wanted.join(written_targets(df.sparkSession, path), ["target", "n"], "left_anti").select("target")
    open_ = written(open_, "targets")  # decided before anything is written
    if not open_.isEmpty():
        left = rows.join(F.broadcast(open_), "target", "left_semi").select("g", "value", "target")
        left.repartition("target", F.pmod("g", F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(path)


def write_walks(walks: DataFrame, path: str) -> None:
    walks.repartition("g").write.parquet(path)


def write_results(df: DataFrame, json_path: str, csv_path: str) -> None:
    df.write.json(json_path)
    df.write.option("header", True).csv(csv_path)
