"""File source: list first, read bytes only for the rows that survive filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.functions.names import file_name, is_image


def scan_files(spark: SparkSession, path: str, images_only: bool = False) -> DataFrame:
    """``(filename, path, modificationTime, length, content)`` of a file or of a flat folder.

    Only direct files of a folder are kept; anything that is neither file nor folder raises.
    ``content`` is pruned from the scan unless it is selected. Names starting with ``.`` or
    ``_`` are hidden by Spark's file listing.
    """
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(f"{path} is neither a file nor a folder")
    status = fs.getFileStatus(hpath)
    reader = (
        spark.read.format("binaryFile")
        .option("ignoreMissingFiles", "true")
        .option("recursiveFileLookup", "true")
    )
    files = reader.load(path)
    if status.isDirectory():
        parent = status.getPath().toString()
        files = files.filter(F.regexp_replace("path", r"/[^/]*$", "") == parent)
    files = files.select(file_name(F.col("path")).alias("filename"), "*")
    return files.filter(is_image(F.col("filename"))) if images_only else files


def _open(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_stream(inner)


def read_content(keys: DataFrame, piece: int | None = None) -> DataFrame:
    """``(filename, content)`` for the listed ``(filename, path)`` rows.

    Runs after key filtering: each task opens the files of its own rows only, so bytes of files
    that are already stored are never read. A file that vanished meanwhile or may not be read is skipped.

    With ``piece``, files come as ``(filename, part, content)`` in parts of at most so many bytes, numbered from 0
    (an empty file is one empty part): a task holds one part, however long the file is.
    """
    schema = "filename string, content binary" if piece is None else "filename string, part long, content binary"

    def load(batches):
        import pyarrow as pa

        def row(name, part, data):
            cols = {"filename": pa.array([name], pa.string()), "part": pa.array([part], pa.int64()), "content": pa.array([data], pa.binary())}
            if piece is None:
                del cols["part"]
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    stream = _open(path)
                except (FileNotFoundError, PermissionError):
                    continue
                with stream:
                    try:
                        data, part = stream.read(piece), 0
                    except (FileNotFoundError, PermissionError):
                        continue
                    yield row(name, part, data)
                    while piece is not None and (data := stream.read(piece)):
                        part += 1
                        yield row(name, part, data)

    return keys.select("filename", "path").mapInArrow(load, schema)
