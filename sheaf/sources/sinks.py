"""Writing results: Markdown and chunked text, archive listings, images under names that don't depend on the order of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def chunk_text(page: Column, width: Column, height: Column, font: Column, body: Column) -> Column:
    return F.concat(text.page_header(page, width, height, font), F.lit("\n"), body, F.lit("\n\n"))


def member_text(path: Column, markdown: Column, error: Column) -> Column:
    """As the command line prints a member: its Markdown, or its error."""
    failed = F.concat(F.lit("=== "), path, F.lit(" — ERROR: "), error, F.lit(" ===\n\n"))
    return F.when(F.coalesce(error, F.lit("")) != "", failed).otherwise(F.concat(F.lit("=== "), path, F.lit(" ===\n"), markdown, F.lit("\n\n")))


def exit_code(members: DataFrame, *by: str) -> DataFrame:
    """2 if a member failed, else 0; for each value of the columns `by`, if any are given."""
    return members.groupBy(*by).agg(F.when(F.count_if(F.coalesce("error", F.lit("")) != "") > 0, 2).otherwise(0).alias("exit_code"))


def named_images(images: DataFrame, folder: str = "folder", name: str = "name", kind: str = "format") -> DataFrame:
    """Adds file_name: a name that is taken within a folder gets _1, _2, ... by a stable order instead of a race."""
    order = Window.partitionBy(folder, name, kind).orderBy(*(c for c in images.columns if c not in (folder, name, kind, "data")))
    ext = text.image_file_extension(F.col(kind))
    n = F.row_number().over(order) - 1
    return images.withColumn("file_name", F.concat(F.col(name), F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit("."), ext))


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_images(images: DataFrame, path: str) -> int:
    """Writes rows(folder, file_name, data) as files below a shared path; returns how many.

    Names are given before (`named_images`), so a task that runs twice writes the same file again: first beside it, then
    by a rename. Null payloads, as repeats of an image have, are passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(path)
        attempt, count = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for folder, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not data:
                    continue
                fs.create_dir(f"{base}/{folder}", recursive=True)
                with fs.open_output_stream(f"{base}/{folder}/.{name}.{attempt}") as out:
                    out.write(data)
                fs.move(f"{base}/{folder}/.{name}.{attempt}", f"{base}/{folder}/{name}")
                count += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    return images.select("folder", "file_name", "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
