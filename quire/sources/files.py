"""Documents in files: whole-text reading with one result per file, and writing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Options, normalize_texts

SCHEMA = "doc_id long, path string, ok boolean, text string, error string"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session may do without it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or tempfile.gettempdir()).rstrip("/")


def _visible(spark: SparkSession, path, fs, conf):
    """A copy under a name that Spark's readers don't pass over, in the folder that executors share."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    copy = hadoop.Path(f"{shared_dir(spark)}/files-{uuid.uuid4().hex}", "x" + path.getName())
    other = copy.getFileSystem(conf)
    if not hadoop.FileUtil.copy(fs, path, other, copy, False, conf):
        raise OSError(f"{path}: could not be copied")
    return other.makeQualified(copy)


def read_texts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(doc_id, path, ok, text, error): one row per path in input order (doc_id from 0). A path that
    doesn't exist, is a folder or is not UTF-8 gives an error row instead of failing the job. Executors read and
    decode the files; the driver only asks for their state. Files whose names begin with _ or . are copied first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, ready = [], []
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        try:
            state = fs.getFileStatus(path)
        except Py4JJavaError as e:
            if "FileNotFoundException" not in e.java_exception.getClass().getName():
                raise
            ready.append((i, p, False, None, "no such file"))
            continue
        if state.isDirectory():
            ready.append((i, p, False, None, "is a folder"))
        elif state.getLen() == 0:
            ready.append((i, p, True, "", None))
        else:
            whole = _visible(spark, path, fs, conf) if path.getName()[0] in "_." else fs.makeQualified(path)
            found.append((i, p, whole.toUri().toString(), whole.toString()))
    out = spark.createDataFrame(ready, SCHEMA)
    if found:
        keys = spark.createDataFrame([x[:3] for x in found], "doc_id long, path string, uri string")
        bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        contents = spark.read.format("binaryFile").load(list(dict.fromkeys(x[3] for x in found)))
        contents = contents.select("content", bare(F.col("_metadata.file_path")).alias("uri"))
        joined = keys.withColumn("uri", bare(F.col("uri"))).join(contents, "uri", "left")
        # the cast keeps the bytes, whatever they are
        text = F.col("content").cast("string")
        ok = F.coalesce(F.is_valid_utf8(text), F.lit(False))
        error = F.when(F.col("content").isNull(), "could not be read").when(~ok, "is not UTF-8")
        out = out.union(joined.select("doc_id", "path", ok, F.when(ok, text), error))
    return out


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """A single text, as read from standard input."""
    return spark.createDataFrame([(0, None, True, text, None)], SCHEMA)


def rewrite(spark: SparkSession, paths: Iterable[str], options: Options = Options(wrap=True)) -> DataFrame:
    """(doc_id, path, ok, text, error) with the good texts normalised."""
    read = read_texts(spark, paths)
    done = normalize_texts(read.where("ok").select("doc_id", "text"), options).withColumnRenamed("text", "_new")
    return read.join(done, "doc_id", "left").select("doc_id", "path", "ok", F.coalesce("_new", "text").alias("text"), "error")


def rewrite_no_wrap(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """rewrite() with the passes that always run only."""
    return rewrite(spark, paths, Options())


def write_texts(results: DataFrame, directory: str) -> None:
    """One folder part=doc_id with a text file for each good document; sources stay as they are."""
    good = results.where("ok").select(F.col("doc_id").alias("part"), F.regexp_replace("text", "\n\\z", "").alias("value"))
    good.write.partitionBy("part").text(directory)


def written_files(spark: SparkSession, directory: str) -> list[str]:
    """The files that write_texts() made, by doc_id."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(directory)
    found = [x.getPath() for x in folder.getFileSystem(conf).globStatus(hadoop.Path(folder, "part=*/part-*"))]
    return [str(x.toString()) for x in sorted(found, key=lambda x: int(x.getParent().getName().removeprefix("part=")))]


def write_in_place(results: DataFrame) -> None:
    """Put each good document in the place of its source file. Executors write the texts to a folder
    beside the first source. Then, one by one, a source is renamed into that folder (old-doc_id), the new
    file takes its place, and the old one goes; if the second step fails, the source is put back. After a
    crash in between the old text is still in the folder. Sources have to lie in one file system."""
    spark = results.sparkSession
    good = results.where("ok and path is not null")
    paths = {r.doc_id: (r.path, r.empty) for r in good.select("doc_id", "path", (F.col("text") == "").alias("empty")).toLocalIterator()}
    if not paths:
        return
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target = {k: hadoop.Path(p) for k, (p, _) in paths.items()}
    first = next(iter(target.values()))
    fs = first.getFileSystem(conf)
    folder = hadoop.Path(fs.makeQualified(first).getParent(), f".rewritten-{uuid.uuid4().hex}")
    write_texts(results.where("path is not null"), folder.toString())
    for key, (_, empty) in paths.items():
        made = [f.getPath() for f in fs.listStatus(hadoop.Path(folder, f"part={key}")) if f.getPath().getName().startswith("part-")]
        if empty:
            fs.create(made[0], True).close()
        old = hadoop.Path(folder, f"old-{key}")
        if not fs.rename(target[key], old):
            raise OSError(f"{paths[key][0]}: could not be moved")
        if not fs.rename(made[0], target[key]):
            fs.rename(old, target[key])
            raise OSError(f"{paths[key][0]}: could not be replaced")
        fs.delete(old, False)
    fs.delete(folder, True)
