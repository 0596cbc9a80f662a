"""CSV files with line breaks inside quotes, read in splits.

A split can't tell by itself whether it begins inside quotes. One pass notes for
every block of a file where it would end, begun outside and begun inside; put
together block by block, that gives each block's true beginning. A second pass then
makes records of lines, block by block; what runs over a block's edge, two pieces of
a block at most, is put together by a small shuffle. Files stay split between tasks
throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.operators import frames

# Blocks that begin inside quotes are broadcast, 40 bytes each, up to so many.
MAX_OPEN_BLOCKS = 2_000_000
# A line that is a whole record: fields in quotes, with doubled quotes in them, and fields without a quote in front.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
WHOLE_RECORD = f"^{_FIELD}(?:,{_FIELD})*+$"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block)`` of every line, in file order within a block."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"))


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line isn't a whole record by itself. Lines without a quote are only searched for one."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where(F.contains("value", F.lit('"')) & ~F.col("value").rlike(WHOLE_RECORD)).isEmpty()


def end_state():
    """A function (line, begins inside quotes) -> (ends inside quotes, where the quotes it began in close or -1)."""
    def run(line: str, inside: bool) -> tuple[bool, int]:
        at, closed, began = 0, -1, inside
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True, closed
                if line.startswith('""', at):
                    at += 2
                    continue
                inside = False
                if began and closed < 0:
                    closed = at
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            at = line.find(",", at)  # the rest of a field is taken as it stands
            if at < 0:
                return False, closed
            at += 1

    return run


def block_edges(batches):
    """For mapInArrow: one row for each block with its end state from either beginning."""
    import pyarrow as pa
    import pyarrow.compute as pc

    step = end_state()
    current, state = None, None
    names = ["file", "block", "from_out", "from_in", "closes"]

    def row():
        return pa.RecordBatch.from_arrays([
            pa.array([current[0]], pa.int64()), pa.array([current[1]], pa.int64()), pa.array([state[0]]), pa.array([state[1]]), pa.array([state[2]])], names)

    for batch in batches:
        lines = batch.column(0)
        quoted = pc.match_substring(lines, '"')
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, marked in enumerate(quoted.to_pylist()):
            if (files[i], blocks[i]) != current:
                if current is not None:
                    yield row()
                current, state = (files[i], blocks[i]), [False, True, False]
            if marked:
                line = lines[i].as_py()
                # A record that closes on this line ends with it: quotes that open again later on belong to the next field.
                out, _ = step(line, state[0])
                into, closed = step(line, state[1])
                state = [out, into, state[2] or not into]
    if current is not None:
        yield row()


def records_of_blocks(batches):
    """For mapInArrow: ``(file, owner, block, place, record, whole)``; pieces of records that run over a block's edge aren't whole."""
    import pyarrow as pa
    import pyarrow.compute as pc

    step = end_state()
    current, inside, owner, held, place = None, False, None, [], 0
    names = ["file", "owner", "block", "place", "record", "whole"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    rows: list[tuple] = []

    def flush():
        columns = list(zip(*rows)) if rows else [()] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def finish(whole: bool) -> None:
        nonlocal held, place
        rows.append((current[0], owner if owner is not None else current[1], current[1], place, "\n".join(held), whole))
        held, place = [], place + 1

    for batch in batches:
        lines, marks = batch.column(0).to_pylist(), pc.match_substring(batch.column(0), '"').to_pylist()
        files, blocks, begins, owners = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        for i, line in enumerate(lines):
            if (files[i], blocks[i]) != current:
                if held:
                    finish(False)
                current, place = (files[i], blocks[i]), 0
                inside, owner = begins[i], owners[i] if begins[i] else None
            held.append(line)
            if marks[i]:
                inside, _ = step(line, inside)
            if not inside:
                finish(owner is None)
                owner = None
        if len(rows) > 10_000:
            yield flush()
    if held:
        finish(False)
    yield flush()


def open_blocks(lines: DataFrame) -> DataFrame:
    """``(file, block, owner)`` of the blocks that begin inside quotes; owner: the block in which that record begins."""
    edges = lines.mapInArrow(block_edges, "file long, block long, from_out boolean, from_in boolean, closes boolean")
    steps = F.array_sort(F.collect_list(F.struct("block", "from_out", "from_in", "closes")))

    def follow(acc: Column, x: Column) -> Column:
        begins = acc["inside"]
        ends = F.when(begins, x["from_in"]).otherwise(x["from_out"])
        starter = F.when(begins & ~x["closes"], acc["owner"]).otherwise(x["block"])
        mine = F.struct(x["block"].alias("block"), acc["owner"].alias("owner"))
        return F.struct(ends.alias("inside"), F.when(ends, starter).alias("owner"),
                        F.when(begins, F.concat(acc["found"], F.array(mine))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("long").alias("owner"),
                     F.array().cast("array<struct<block:bigint,owner:bigint>>").alias("found"))
    # As many steps as a file has blocks.
    followed = edges.groupBy("file").agg(F.aggregate(steps, start, follow).alias("end"))
    return followed.select("file", F.inline("end.found"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, place, record)`` of every record; lines without text are left out, as a plain scan leaves them out."""
    lines = lines_of(spark, path)
    begun = frames.stage(open_blocks(lines))
    if begun.count() > MAX_OPEN_BLOCKS:
        raise ValueError(f"{path} has too many blocks that begin inside quotes")
    marked = lines.join(F.broadcast(begun), ["file", "block"], "left").select(
        "value", "file", "block", F.col("owner").isNotNull().alias("begins"), "owner")
    made = frames.stage(marked.mapInArrow(records_of_blocks, "file long, owner long, block long, place long, record string, whole boolean"))
    pieces = made.where("NOT whole").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "record"))).alias("pieces"))
    joined = pieces.select("file", F.col("owner").alias("block"), F.col("pieces")[0]["place"].alias("place"),
                           F.array_join(F.col("pieces.record"), "\n").alias("record"))
    everything = made.where("whole").select("file", "block", "place", "record").unionByName(joined)
    return everything.withColumn("record", F.rtrim(F.col("record"), F.lit("\r"))).where(F.trim("record") != "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header that every file begins with."""
    found = records(spark, path)
    heads = found.where("block = 0").groupBy("file").agg(F.min("place").alias("place"), F.min_by("record", "place").alias("head"))
    heads = frames.stage(heads)  # one row per file
    first = heads.select("head").orderBy("file").first()
    if first is None:
        return spark.createDataFrame([], "value string")
    names = _header(spark, first["head"])
    options = {"escape": '"', "mode": "PERMISSIVE"}
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    body = found.join(F.broadcast(heads.select("file", "place", F.lit(0).cast("long").alias("block"))), ["file", "block", "place"], "left_anti") \
        if heads.count() <= MAX_OPEN_BLOCKS else found.join(heads.withColumn("block", F.lit(0).cast("long")), ["file", "block", "place"], "left_anti")
    return body.select(F.from_csv("record", schema, options).alias("r")).select("r.*").toDF(*names)


def _header(spark: SparkSession, head: str) -> list[str]:
    """Names as a plain scan gives them: its own rules for empty and repeated names."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(
        spark.sparkContext.parallelize([head.replace("\n", " ")], 1)).columns
