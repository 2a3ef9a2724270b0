"""File sources and sinks with checks: strict CSV, repaired TSV, COPY text, JSON lines, XML, zip members; publishing."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.sources.scratch import fresh_path, stored, swapped_in


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Comma-separated rows with a header that must equal the schema's names; a row of another width fails the read."""
    first = spark.read.text(path).filter(F.col("value").startswith(schema.names[0])).limit(1).collect()
    if not first or first[0]["value"].replace('"', "").split(sep) != schema.names:
        raise ValueError(f"the header of {path} is not {', '.join(schema.names)}")
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, sep=sep, escape='"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of malformed ones."""
    held = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(held).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select("*")  # the corrupt-record column may not be asked for alone
    return rows.filter(F.col("_bad").isNull()).drop("_bad"), rows.filter(F.col("_bad").isNotNull()).select("_bad", *schema.names).select("_bad")


#: fixed values: the letters that stand for control characters after a backslash in COPY text
COPY_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _copy_unescaped(cell: Column) -> Column:
    """One pass from left to right: a backslash and what follows it are one piece, so no piece is undone twice."""
    pieces = F.regexp_extract_all(cell, F.lit(r"(?s)\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+|\\$"), F.lit(0))

    def char(p: Column) -> Column:
        mark = F.substring(p, 2, F.length(p))
        out = F.when(~F.startswith(p, F.lit("\\")) | (F.length(p) == 1), p)
        out = out.when(mark.rlike("^x[0-9A-Fa-f]+$"), F.char(F.conv(F.substring(mark, 2, 2), 16, 10).cast("long")))
        out = out.when(mark.rlike("^[0-7]+$"), F.char(F.conv(mark, 8, 10).cast("long")))
        for letter, c in COPY_ESCAPES.items():
            out = out.when(mark == letter, F.lit(c))
        return out.otherwise(mark)

    return F.array_join(F.transform(pieces, char), "")


def read_copy_text(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    r"""Tab-separated rows with backslash escapes in which \N is null; and, held back, the lines (line) of another width.

    The end mark \. is no row.
    """
    raw = spark.read.option("lineSep", "\n").text(path).filter(F.col("value") != "\\.")
    cells = F.split("value", "\t")
    fits = F.size(cells) == len(schema.fields)

    def cell(i: int, f: T.StructField) -> Column:
        c = F.get(cells, F.lit(i))
        return F.when(c != "\\N", F.when(F.contains(c, F.lit("\\")), _copy_unescaped(c)).otherwise(c)).cast(f.dataType).alias(f.name)

    return raw.filter(fits).select(*[cell(i, f) for i, f in enumerate(schema.fields)]), raw.filter(~fits).select(F.col("value").alias("line"))


def write_copy_text(df: DataFrame, path: str) -> None:
    r"""The inverse of read_copy_text()."""
    def cell(name: str) -> Column:
        c = F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for letter, char in COPY_ESCAPES.items():
            c = F.replace(c, F.lit(char), F.lit("\\" + letter))
        return F.coalesce(c, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias("value")).write.option("lineSep", "\n").text(path)


class _Repair:
    """Records from a file's lines, one after another.  A line with too few tabs opens a fragment, to which the next lines
    are added, without anything between, until it has the tabs of a record; a whole line that meets an open fragment, or
    too many tabs, end it as beyond repair (that line goes with it).  Surplus tabs of a line belong to its free text."""

    def __init__(self, tabs: int, at: int, held: str | None = None):
        self.tabs, self.at, self.held, self.out = tabs, at, held, []

    def put(self, kind: str, line: str | None = None) -> None:
        cells = line.split("\t") if line is not None else []
        if len(cells) > self.tabs + 1:
            after = self.tabs - self.at
            cells = [*cells[: self.at], "\t".join(cells[self.at : len(cells) - after]), *cells[len(cells) - after :]]
        self.out.append((kind, cells))

    def take(self, line: str) -> None:
        n = line.count("\t")
        if self.held is None:
            if n < self.tabs and line:
                self.held = line
            elif line:
                self.put("whole" if n == self.tabs else "merged", line)
        elif n == self.tabs:
            self.held = self.put("fragment")
        else:
            self.held += line
            n = self.held.count("\t")
            if n == self.tabs:
                self.held = self.put("rejoined", self.held)
            elif n > self.tabs:
                self.held = self.put("fragment")


def read_repaired_tsv(spark: SparkSession, path: str, columns: list[str], free_text: str, line_end: str = "\r\n", header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, (kind, n)): rows of all records that are whole or can be made whole, and how many are whole, rejoined, merged
    (tabs in the free text) or fragments beyond repair, which give no rows.

    A file is read by as many tasks as it has splits.  After the first line with the tabs of a record no fragment is open,
    whatever stood before, so a split works on from there; the lines up to it, and what is left open at its end, meet the
    file's other splits in one small pass.  header: each file's first line is one.
    """
    at, tabs = columns.index(free_text), len(columns) - 1
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", line_end).text(path).select(*place, F.col("value").alias("line"))
    schema = "file string, block long, kind string, cells array<string>"

    def rows(file: str, block: int, out: list) -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([k for k, _ in out], pa.string()), pa.array([c for _, c in out], pa.list_(pa.string()))], names=["file", "block", "kind", "cells"])

    def by_split(batches):
        file = block = repair = head = None
        for batch in batches:
            for f, b, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line")), strict=True):
                if (f, b) != (file, block):
                    if file is not None:
                        yield rows(file, block, [*repair.out, ("head", head), ("open", [x for x in [repair.held] if x is not None])])
                    file, block, repair, head = f, b, _Repair(tabs, at), []
                    seeking, first = True, b == 0 and header
                if first:
                    first = False
                elif seeking:
                    head.append(line)
                    seeking = line.count("\t") != tabs
                else:
                    repair.take(line)
            if file is not None and repair.out:
                yield rows(file, block, repair.out)
                repair.out = []
        if file is not None:
            yield rows(file, block, [("head", head), ("open", [x for x in [repair.held] if x is not None])])

    def stitched(table: pa.Table) -> pa.Table:
        rest = sorted(table.to_pylist(), key=lambda r: (r["block"], r["kind"]))  # of each split its head, then what it left open
        repair = _Repair(tabs, at)
        for r in rest:
            if r["kind"] == "head":
                for line in r["cells"]:
                    repair.take(line)
            elif r["cells"]:
                repair.held = r["cells"][0]
        if repair.held is not None:
            repair.put("fragment")
        return pa.Table.from_batches([rows(rest[0]["file"], -1, repair.out)])

    found = stored(lines.mapInArrow(by_split, schema), "records")
    edges = ["head", "open"]
    small = found.filter(F.col("kind").isin(edges)).groupBy("file").applyInArrow(stitched, schema)  # a few lines a split
    every = stored(found.filter(~F.col("kind").isin(edges)).unionByName(small), "repaired")
    counts = every.groupBy("kind").agg(F.count("*").alias("n"))
    return every.filter("kind <> 'fragment'").select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)]), counts


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of every stored or deflated member; an archive is read by one task."""
    import pyarrow as pa

    def members(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and info.filename.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([info.filename]), pa.array([z.read(info)], pa.binary())], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, content binary")


def _digest_parts(columns: list[str]) -> tuple[Column, Column]:
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).alias("s")


def _digest(rows: int, total) -> str:
    return hashlib.sha256(f"{rows}:{total}".encode()).hexdigest()


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free digest of a table: the rows' hashes added up, hashed with their number."""
    facts = df.agg(*_digest_parts(df.columns))
    return facts.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def publish(df: DataFrame, path: str, id_col: str) -> dict:
    """Replace a dataset: {rows, digest}.  It is written aside once, digested on its way; the written rows are checked
    (ids there and unique, the same digest) and only then take the old ones' place, which stay if anything fails."""
    spark, seen = df.sparkSession, Observation()
    aside = f"{path}.new-{uuid.uuid4().hex}"
    df.observe(seen, *_digest_parts(df.columns)).write.parquet(aside)
    written = spark.read.schema(df.schema).parquet(aside)
    bad = written.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0][id_col]} is missing or repeated")
    got = row_digest(written).first().asDict()
    if got != {"rows": seen.get["rows"], "digest": _digest(seen.get["rows"], seen.get["s"])}:
        raise RuntimeError("the published rows differ from the offered ones")
    swapped_in(spark, aside, path)
    return got


def read_windows(df: DataFrame, id_col: str, size: int, most: int) -> DataFrame:
    """df with `page`: rows in order of the id in windows of a fixed size; more rows than `most`, or windows that do not
    add up to the table, are an error."""
    from tabulon.operators.ranking import numbered

    total = df.count()
    if total > most:
        raise ValueError(f"{total} rows are there, {most} at most are read")
    paged = numbered(df, [id_col], "_n").withColumn("page", F.floor((F.col("_n") - 1) / size)).drop("_n")
    if paged.count() != total:
        raise RuntimeError("the windows do not add up to the table")
    return paged


def write_half_vectors(df: DataFrame, id_col: str, vector: str, path: str) -> None:
    """(id, half: little-endian 16-bit floats, sha256) as Parquet."""
    import numpy as np
    import pyarrow as pa

    def narrow(batches):
        for batch in batches:
            data = [None if v is None else np.asarray(v, np.float64).astype("<f2").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "half"])

    schema = T.StructType([df.schema[id_col], T.StructField("half", T.BinaryType())])
    df.select(id_col, vector).mapInArrow(narrow, schema).withColumn("sha256", F.sha2("half", 256)).write.parquet(path)


def read_half_vectors(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(id, vector array<float>); a shard whose digest is wrong fails the read."""
    import numpy as np
    import pyarrow as pa

    def widen(batches):
        for batch in batches:
            data = [None if b is None else np.frombuffer(b, "<f2").astype(np.float32) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.list_(pa.float32()))], names=[id_col, "vector"])

    held = spark.read.parquet(path)
    right = F.when(F.sha2("half", 256).eqNullSafe(F.col("sha256")), F.col("half")).otherwise(F.raise_error(F.lit("a vector's digest is wrong")).cast("binary"))
    schema = T.StructType([held.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])
    return held.select(id_col, right.alias("half")).mapInArrow(widen, schema)


def upsert_batches(df: DataFrame, order: str, most_rows: int, most_bytes: int, newest_first: bool = False) -> DataFrame:
    """df with `batch`: consecutive rows in an order, at most so many and so many bytes of JSON a batch; 0 is sent first.

    newest_first: batches go oldest first, but rows keep newest-first order inside (`place`), so that each batch lands
    ahead of the ones before.  A row over the byte bound is an error.  Rows are first dealt into blocks of most_rows by
    their number; only rows of one block meet, and a block is cut where its running bytes pass the bound.
    """
    from tabulon.operators.ranking import numbered

    size = F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) + 1
    n = numbered(df.withColumn("_size", size), [order], "_n").withColumn("_block", F.floor((F.col("_n") - 1) / most_rows))
    too_large = F.when(F.col("_size") + 2 > most_bytes, F.raise_error(F.lit("a row exceeds the byte bound of a batch"))).otherwise(F.col("_size"))
    listed = n.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_n", too_large.alias("_size")))).alias("_l"))  # most_rows numbers at most
    start = F.struct(F.lit(0).alias("part"), F.lit(2).cast("long").alias("bytes"), F.array().cast("array<struct<n:bigint,part:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        full = acc["bytes"] + r["_size"] > most_bytes
        part = F.when(full & (F.size(acc["out"]) > 0), acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(full, 2 + r["_size"].cast("long")).otherwise(acc["bytes"] + r["_size"]).alias("bytes"), F.concat(acc["out"], F.array(F.struct(r["_n"].cast("long").alias("n"), part.alias("part")))).alias("out"))

    parts = stored(listed.select("_block", F.inline(F.aggregate("_l", start, step, lambda acc: acc["out"]))), "parts")
    batches = parts.select("_block", "part").distinct().withColumn("key", F.struct("_block", "part"))
    batches = numbered(batches, ["_block", "part"], "batch").select("_block", "part", (F.col("batch") - 1).alias("batch"))
    place = F.col("_n").alias("place") if not newest_first else (-F.col("_n")).alias("place")
    return n.join(parts.withColumnRenamed("n", "_n"), ["_block", "_n"]).join(batches, ["_block", "part"]).select(*df.columns, "batch", place)


def publish_more(df: DataFrame, path: str, id_col: str, expected_before: int) -> int:
    """Append rows that are not there yet, if the dataset still has the expected number; the number of new rows."""
    spark = df.sparkSession
    held = spark.read.parquet(path)
    before = held.count()
    if before != expected_before:
        raise ValueError(f"{before} rows are held, {expected_before} were expected")
    new = df.join(held.select(id_col), id_col, "left_anti").dropDuplicates([id_col])
    target = fresh_path(spark, "append")
    new.write.parquet(target)  # fixed before it is appended to what it was compared with
    spark.read.parquet(target).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def dictionary_encoded(df: DataFrame, column: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows with integer codes instead of the column, dictionary (code, value)); codes follow the values' order."""
    from tabulon.operators.ranking import numbered

    words = numbered(df.filter(F.col(column).isNotNull()).select(column).distinct(), [column], out)
    return df.join(words, column, "left").drop(column), words.select(F.col(out).alias("code"), F.col(column).alias("value"))
