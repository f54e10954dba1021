"""Reading and writing tables by file suffix."""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import travels

travels(__name__)

READ_BYTES = 128 << 20
SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".feather": "feather"}


def _format(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported format {suffix!r}; supported: {', '.join(sorted(SUFFIXES))}")
    return SUFFIXES[suffix]


def _require(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(p):
        raise FileNotFoundError(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """A file or a folder of files, its format taken from the suffix of the path.

    Pass a schema for large text inputs: inferring one costs an extra pass.
    """
    kind = _format(path)
    _require(spark, path)
    if kind == "feather":
        return read_feather(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        # a file is split between tasks; pass multiLine=True for quoted line breaks, at one task a file
        fixed = {"header": True, "sep": "," if kind == "csv" else "\t", "escape": '"', "multiLine": False, "inferSchema": schema is None}
        return reader.options(**{**fixed, **options}).csv(path)
    if kind in ("json", "jsonl"):
        return reader.options(**{"multiLine": kind == "json", **options}).json(path)
    return reader.options(**options).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write in parallel as a folder, its format taken from the suffix; parents are created."""
    kind = _format(path)
    if kind == "feather":
        return write_feather(df, path, mode, partition_by)
    if kind == "json":
        return write_json_arrays(df, path, mode, partition_by)
    if partition_by:
        df = df.hint("rebalance", *partition_by)  # a value that holds much of the data is split between tasks
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        return writer.option("header", True).option("sep", "," if kind == "csv" else "\t").option("escape", '"').csv(path)
    return writer.json(path) if kind == "jsonl" else writer.parquet(path)


def _by_folder(df: DataFrame, by: list[str], lead: list) -> DataFrame:
    """``lead`` with the values of ``by`` as JSON in ``__folder``; a folder's rows follow each other, a large folder is split between tasks."""
    if len(by) >= len(df.columns):
        raise ValueError("a column must be left to write")
    texts = F.to_json(F.array(*[F.col(c).cast("string") for c in by]))
    return df.hint("rebalance", *by).select(*lead, texts.alias("__folder")).sortWithinPartitions("__folder")


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """One JSON array per output file; rows are streamed, never gathered. With ``partition_by``, one folder per value."""
    import pandas as pd

    by = list(partition_by or [])
    if "value" in by:
        raise ValueError("JSON arrays are not written by a column named value")
    line = F.to_json(F.struct(*[c for c in df.columns if c not in by]), {"ignoreNullFields": "false"}).alias("value")
    rows = _by_folder(df, by, [line]) if by else df.select(line, F.lit("").alias("__folder"))

    def wrap(batches):
        current, turn = None, 0
        for pdf in batches:
            values, folders = [], []
            for value, folder in zip(pdf["value"], pdf["__folder"]):
                if folder != current:
                    if current is not None:
                        values.append("]")
                        folders.append(current)
                    current, mark = folder, "["
                else:
                    mark = ","
                values.append(mark + value)
                folders.append(folder)
            turns = range(turn, turn + len(values))
            turn += len(values)
            yield pd.DataFrame({"value": values, "__folder": folders, "__turn": turns})
        last = "[]" if current is None else "]"
        if current is not None or not by:
            yield pd.DataFrame({"value": [last], "__folder": [current or ""], "__turn": [turn]})

    lines = rows.mapInPandas(wrap, "value string, __folder string, __turn long")
    if not by:
        return lines.select("value").write.mode(mode).text(path)
    parsed = F.from_json("__folder", "array<string>")
    values = [f"__by{i}" for i in range(len(by))]
    lines = lines.select("value", "__turn", *[parsed[i].alias(v) for i, v in enumerate(values)])
    # the writer wants rows by folder; sorted so here, with the turn last, it leaves their order alone
    ordered = lines.sortWithinPartitions(*values, "__turn").select("value", *[F.col(v).alias(c) for v, c in zip(values, by)])
    ordered.write.mode(mode).partitionBy(*by).text(path)


# --- Arrow files ----------------------------------------------------------------------------------


def _open_fs(path: str):
    """File system and name of a path as Spark writes it: only scheme and host are a URI, names hold %XX as they stand."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        scheme, rest = path.split("://", 1)
        host, _, rest = rest.partition("/")
        system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        return system, f"{root.rstrip('/')}/{rest}"
    return fs.LocalFileSystem(), path


# Characters that partition folders hold as %XX.
ESCAPED = frozenset('"#%\'*/:=?\\{[]^\x7f' + "".join(map(chr, range(1, 32))))
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder(by: list[str], values: list[str | None]) -> str:
    """``a=1/b=x``, as partition discovery reads it."""

    def plain(text: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in text)

    return "/".join(f"{plain(c)}={plain(v) if v else NO_VALUE}" for c, v in zip(by, values))


def write_feather(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """One Arrow file per task, and per folder of partition values, in a shared folder; a retried task overwrites its own files.

    ``overwrite`` writes a folder beside the old one and puts it in its place when the job is done, so a job that fails or that
    reads the old folder loses nothing; ``append`` adds files, ``ignore`` and ``error`` leave an existing folder alone. A table
    without rows leaves one file that holds the schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if hadoop.exists(folder) and mode != "append":
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
    run = os.urandom(6).hex()
    target = folder if mode == "append" else folder.suffix(f".new-{run}")
    path = hadoop.makeQualified(target).toString()

    by = list(partition_by or [])
    kept = [c for c in df.columns if c not in by]
    if by:
        df = _by_folder(df, by, [F.col(c) for c in kept])

    def store(batches):
        import json

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.ipc as ipc
        from pyspark import TaskContext

        system, root = _open_fs(path)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        current, name, sink, writer, rows = None, None, None, None, 0

        def finish():
            if writer is not None:
                writer.close()
                sink.close()
                system.move(f"{name}.tmp-{attempt}", f"{name}.arrow")

        for batch in batches:
            if by:
                runs = pc.run_end_encode(batch.column("__folder"))
                folders, ends = runs.values.to_pylist(), runs.run_ends.to_pylist()
                batch = batch.drop_columns(["__folder"])
            else:
                folders, ends = [""], [batch.num_rows]
            for folder, start, end in zip(folders, [0, *ends], ends):
                if writer is None or folder != current:
                    finish()
                    current, place = folder, f"{root}/{_folder(by, json.loads(folder))}" if by else root
                    system.create_dir(place, recursive=True)
                    name = f"{place}/part-{TaskContext.get().partitionId():06d}-{run}"
                    sink = system.open_output_stream(f"{name}.tmp-{attempt}")
                    writer = ipc.new_file(sink, batch.schema)
                writer.write_batch(batch.slice(start, end - start))
            rows += batch.num_rows
        finish()
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    try:
        rows = df.mapInArrow(store, "rows long").agg(F.sum("rows")).first()[0]
        if not rows:
            system, root = _open_fs(path)
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/part-empty-{run}.arrow") as sink, pa.ipc.new_file(sink, to_arrow_schema(df.select(*kept).schema)):
                pass
    except Exception:
        if target is not folder:
            hadoop.delete(target, True)
        raise
    if target is not folder:
        hadoop.delete(folder, True)
        if not hadoop.rename(target, folder):
            raise OSError(f"{target} could not be renamed")


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Arrow files; each task opens its files and streams their batches. Folders like ``a=1`` become columns."""
    from pyspark.sql.pandas.types import from_arrow_schema

    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arrow,feather}").load(path)
    held = listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    listing = listing.drop("modificationTime", "length", "content")  # partition values stay
    first = listing.limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no Arrow files in {path}")
    system, name = _open_fs(first[0]["path"])
    with system.open_input_file(name) as f:
        schema = from_arrow_schema(pa.ipc.open_file(f).schema)
    found = [f for f in listing.schema.fields if f.name != "path"]
    schema = StructType([*schema.fields, *found])
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(held["bytes"] / READ_BYTES))  # small files share a task

    places = [f.name for f in found]

    def load(batches):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        for batch in batches:
            for at, p in enumerate(batch.column("path").to_pylist()):
                handle, key = _open_fs(p)
                with handle.open_input_file(key) as f:
                    reader = ipc.open_file(f)
                    for i in range(reader.num_record_batches):
                        out = reader.get_batch(i)
                        for place in places:
                            column = batch.column(place)
                            same = pa.repeat(column[at], out.num_rows).cast(column.type)
                            out = out.append_column(place, same)
                        yield out

    return listing.repartition(max(1, min(held["files"], tasks)), "path").mapInArrow(load, schema)


# --- reports and catalog --------------------------------------------------------------------------


def dataset_info(spark: SparkSession, path: str) -> DataFrame:
    """``(path, format, files, bytes, columns, dtypes)`` from the listing and the schema, no rows read."""
    kind = _format(path)
    _require(spark, path)
    df = read_table(spark, path)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(
        ~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")
    )
    size = listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return size.select(
        F.lit(path).alias("path"),
        F.lit(kind).alias("format"),
        "files",
        "bytes",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(d) for _, d in df.dtypes]).alias("dtypes"),
    )


def ingest_report(df: DataFrame) -> DataFrame:
    """Row and column count, dtypes and a three-row preview as JSON."""
    preview = F.array(*[F.lit(x) for x in df.limit(3).toJSON().collect()])
    dtypes = F.array(*[F.lit(f"{c}:{d}") for c, d in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), dtypes.alias("dtypes"), preview.alias("preview")
    )


def append_checked(df: DataFrame, path: str, bad) -> DataFrame:
    """Append the rows without a violation; the rejected rows come back."""
    write_table(df.filter(~F.coalesce(bad, F.lit(False))), path, mode="append")
    return df.filter(bad)


def catalog_entry(df: DataFrame, name: str, source: str, uri: str, created_at: str, description: str = "") -> DataFrame:
    """One catalog row: schema JSON and per-column statistics JSON."""
    from tidemark.operators.columns import missing

    stats = [
        F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("missing")) for c in df.columns
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.to_json(F.array(*stats)).alias("stats")).select(
        F.lit(name).alias("name"),
        F.lit(description).alias("description"),
        F.lit(source).alias("source"),
        F.lit(uri).alias("uri"),
        F.lit(df.schema.json()).alias("schema"),
        "rows",
        "stats",
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def latest_entries(catalog: DataFrame) -> DataFrame:
    """The newest entry per dataset name."""
    from tidemark.operators.relational import latest

    return latest(catalog, ["name"], ["created_at"], status=None)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000, **options
) -> DataFrame:
    """Parallel database read over ranges of a numeric column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties={"fetchsize": str(fetch_size), **options}
    )
