"""Splittable reading of CSV whose quoted fields hold newlines.

Spark's ``multiLine`` reader takes a whole file in one task, since a byte block does not tell whether
it starts inside a quoted field. Here the file is read as lines, which Spark splits, and the state
at the start of every block is found by a prefix scan:

1. per block (scan split): whether a quoted field is open at its end, if it starts outside and if it
   starts inside one, and where its first whole record and its last unfinished one begin; one row
   a block;
2. per file, the blocks' maps are composed in order: the true state at the start of each block;
3. whole records come from their block alone; a record cut by a block border is put together from the
   end of its block and the heads of the following ones, by one small aggregate.

Records are then parsed by Spark's own CSV parser (``from_csv``). A quote opens a field only where a
field starts and ``""`` stands for a quote. In a file whose first line ends in ``\\r\\n``, line ends inside
fields become ``\\n``, as in Spark's reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.session import cut_lineage

#: Blocks whose states are broadcast at most (about 100 bytes each); beyond, lines are shuffled to them.
BROADCAST_BLOCKS = 100_000
_BLOCK = ("file string, block long, first long, crlf boolean, end_out boolean, end_in boolean, start_in long, "
          "open_out long, open_in long")
_STATE = ("file string, block long, first long, crlf boolean, inside boolean, owner long, head_end long, "
          "tail_start long")


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted field is open after ``line``, given whether one was open before."""
    at, opening = 0, delimiter + '"'
    if not inside:
        if line[:1] != '"':
            at = line.find(opening)
            if at < 0:
                return False
            at += len(delimiter)
        at += 1
    while True:
        at = line.find('"', at)
        while at >= 0 and line[at + 1:at + 2] == '"':
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(opening, at + 1)
        if at < 0:
            return False
        at += len(opening)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value"))


def _block_maps(delimiter: str):
    """Pass 1: what a block does to either state."""
    def run(batches):
        import pyarrow as pa
        key, out, seen = None, [], None

        def close():
            out.append({"file": key[0], "block": key[1], "first": seen[5], "crlf": seen[6], "end_out": seen[0],
                        "end_in": seen[1], "start_in": seen[2], "open_out": seen[3] if seen[0] else None, "open_in": seen[4] if seen[1] else None})

        for batch in batches:
            for file, block, row, line in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "row", "value"))):
                if (file, block) != key:
                    if key:
                        close()
                    key, seen = (file, block), [False, True, None, None, None, row, line.endswith("\r")]
                if not seen[0]:
                    seen[3] = row                 # a record starts here if the block starts outside
                if not seen[1]:
                    seen[4] = row                 # ... and here if it starts inside
                    if seen[2] is None:
                        seen[2] = row
                if '"' in line:
                    seen[0], seen[1] = ends_inside(line, seen[0], delimiter), ends_inside(line, seen[1], delimiter)
        if key:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("crlf", pa.bool_()),
             ("end_out", pa.bool_()), ("end_in", pa.bool_()),
             ("start_in", pa.int64()), ("open_out", pa.int64()), ("open_in", pa.int64())]))
    return run


def _compose(table):
    """Pass 2, one file's blocks (a few rows a gigabyte): state at the start of each."""
    import pyarrow as pa
    inside, owner, rows = False, None, []
    blocks = table.sort_by("block").to_pylist()
    for b in blocks:
        opened = b["open_in"] if inside else b["open_out"]      # last record, if it does not end here
        rows.append({"file": b["file"], "block": b["block"], "first": b["first"], "crlf": blocks[0]["crlf"],
                     "inside": inside, "owner": owner if inside else None, "head_end": b["start_in"] if inside else None, "tail_start": opened})
        if opened is not None:
            owner = b["block"]
        inside = b["end_in"] if inside else b["end_out"]
    return pa.Table.from_pylist(rows, schema=pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("crlf", pa.bool_()),
         ("inside", pa.bool_()), ("owner", pa.int64()),
         ("head_end", pa.int64()), ("tail_start", pa.int64())]))


def _records(delimiter: str):
    """Pass 3: the records that lie in one block; lines come in the file's order."""
    def run(batches):
        import pyarrow as pa
        key, inside, held = None, False, []
        for batch in batches:
            out = {"file": [], "block": [], "row": [], "first_record": [], "record": []}
            names = ("file", "block", "first", "crlf", "row", "value")
            for file, block, first, crlf, row, line in zip(*(batch.column(n).to_pylist() for n in names)):
                if (file, block) != key:
                    key, inside, held = (file, block), False, []
                if not inside:
                    start, held = row, []
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside, delimiter)
                if not inside:
                    record = "\n".join(held) if len(held) > 1 else line
                    if crlf:
                        record = record.removesuffix("\r").replace("\r\n", "\n")
                    for n, v in zip(out, (file, block, start, block == 0 and start == first, record)):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("first_record", pa.bool_()),
                 ("record", pa.string())]))
    return run


def read_records(spark: SparkSession, path: str, delimiter: str = ",",
                 broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(file, block, row, first_record, record): the records of the CSV files at ``path``; the first of
    each file, its header perhaps, is marked."""
    lines = _lines(spark, path)
    maps = lines.mapInArrow(_block_maps(delimiter), _BLOCK)
    states = cut_lineage(maps.groupBy("file").applyInArrow(_compose, _STATE))
    if states.count() <= broadcast_blocks:
        placed = lines.join(F.broadcast(states), ["file", "block"])      # keeps the order of the lines
    else:
        placed = lines.join(states, ["file", "block"]).sortWithinPartitions("file", "block", "row")
    head = F.col("inside") & (F.col("head_end").isNull() | (F.col("row") < F.col("head_end")))
    tail = F.coalesce(F.col("row") >= F.col("tail_start"), F.lit(False))
    whole = placed.where(~head & ~tail).select("file", "block", "first", "crlf", "row", "value").mapInArrow(
        _records(delimiter), "file string, block long, row long, first_record boolean, record string")
    part = F.struct("block", "row", "value", ((F.col("block") == 0) & (F.col("row") == F.col("first"))).alias("first"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    cut = (placed.where(head | tail).withColumn("owner", F.when(head, F.col("owner")).otherwise(F.col("block")))
           .groupBy("file", "owner", "crlf").agg(F.sort_array(F.collect_list(part)).alias("parts"))
           .select("file", F.col("owner").alias("block"), F.get("parts", F.lit(0))["row"].alias("row"),
                   F.get("parts", F.lit(0))["first"].alias("first_record"),
                   F.when(F.col("crlf"), F.regexp_replace(text, "\r(\n|$)", "$1")).otherwise(text).alias("record")))
    return whole.unionByName(cut)


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                    delimiter: str = ",", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """The files' rows, as Spark's ``multiLine`` reader gives them, under ``schema`` and ``file_order``, the place (file, block, row) of each. Blank
    records are skipped, missing fields are NULL, surplus ones are ignored; with ``header`` the first
    record of every file is skipped."""
    d = read_records(spark, path, delimiter, broadcast_blocks)
    if header:
        d = d.where(~F.col("first_record"))
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return d.where(F.length("record") > 0).select(
        F.from_csv("record", ddl, options).alias("_r"), F.struct("file", "block", "row").alias("file_order")).select(
        "_r.*", "file_order")
