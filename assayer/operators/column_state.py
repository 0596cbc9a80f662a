"""Column profiles that grow with a table: mergeable state per part, stored and added up.

A part is a file or a batch. One narrow pass over new parts gives every column of
each a row of state: counts, sums, a distinct sketch, a quantile sketch, the most
frequent values and what each date format parses. A profile merges the states of
all parts, so parts profiled before are never read again.

Distinct counts decide types near certain thresholds. Where a part's sketch is
close to one, the digests of its values are stored too; a column that has them for
all its parts is counted exactly from the digests.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from assayer.functions import dates, text, tokens as t
from assayer.operators import frames, profile

# log2 of the distinct sketch's size (relative error about 1 / sqrt(2^17)), values of
# the quantile sketch (exact up to so many), values tracked for the most frequent ones.
DISTINCT_BITS, QUANTILE_VALUES, TRACKED_VALUES = 16, 4096, 10_000

FORMATS = [f.label for f in dates.DATE_FORMATS] + [dates.MIXED]


def _parsed(value: Column, i: int) -> Column:
    return dates.parse_mixed(value) if i == len(dates.DATE_FORMATS) else dates.parse_format(value, dates.DATE_FORMATS[i])


def _state(value: Column, dtype: T.DataType) -> dict[str, Column]:
    """Aggregates of one column. Every name is there for every type, so states of all columns are rows of one table."""
    is_text = text.is_string(dtype)
    trimmed, low = (text.trimmed(value), text.folded(value)) if is_text else (value, value)
    metrics = profile._text_metrics(trimmed, low) if is_text else profile._other_metrics(value, dtype)
    counted = text.is_numeric(dtype) or is_text
    x = text.to_number(value, dtype, lenient=True) if counted else F.lit(None).cast("double")
    shown = value.cast("string")
    out = {
        "rows": F.count(F.lit(1)), "non_null": F.count(value),
        "distinct": F.hll_sketch_agg(F.when(shown == "-0.0", "0.0").otherwise(shown), F.lit(DISTINCT_BITS)),
        "length_sum": F.sum(F.char_length(trimmed if is_text else shown)),
        "n": F.count(x), "mean": F.avg(x), "squares": F.var_pop(x) * F.count(x), "lo": F.min(x), "hi": F.max(x),
        "quantiles": F.kll_sketch_agg_double(x, F.lit(QUANTILE_VALUES)),
    }
    for name, kind in (("words", "boolean"), ("has_true", "boolean"), ("has_false", "boolean"), ("null_like", "long"),
                       ("numbers", "long"), ("amounts", "long"), ("structured", "long"), ("date_like", "long")):
        out[name] = metrics.get(name, F.lit(None)).cast(kind)
    marks = F.when(low.isin(list(t.SCHEMA_NULLS)), trimmed) if is_text else F.lit(None).cast("string")
    out["marks"] = F.collect_set(marks)  # spellings of a fixed word list
    looks = F.when(trimmed.rlike(dates.DATE_LIKE), trimmed) if is_text else None
    spans = []
    for i, label in enumerate(FORMATS if is_text else FORMATS[:1]):
        d = _parsed(looks, i) if is_text else (dates.to_datetime(value, dtype, None) if text.is_temporal(dtype) else F.lit(None).cast("timestamp"))
        spans.append(F.struct(F.lit(label if is_text else "").alias("format"), F.count(d).alias("parsed"),
                              dates.iso(F.min(d)).alias("first"), dates.iso(F.max(d)).alias("last")))
    out["dates"] = F.array(*spans)
    return out


class ColumnStates:
    """States of a table's parts under one path. A commit shows up whole or not at all; adding a part again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- storage

    def _commits(self) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().toString() for f in system.listStatus(target)) if system.exists(target) else []

    def _read(self, name: str) -> DataFrame | None:
        """A table of all commits; of a part that two commits hold, the first counts."""
        commits = self._commits()
        if not commits:
            return None
        found = frames.union_all([self.spark.read.parquet(f"{c}/{name}").withColumn("commit", F.lit(c)) for c in commits])
        first = Window.partitionBy("part")
        return found.withColumn("__first", F.min("commit").over(first)).where("commit = __first").drop("commit", "__first")

    def parts(self) -> set[str]:
        """Names of the parts that are in; one for each file or batch."""
        commits = self._commits()
        return {r["part"] for r in self.spark.read.parquet(*[f"{c}/parts" for c in commits]).collect()} if commits else set()

    # -- adding

    def add(self, df: DataFrame, part: Column | str, row_key: Sequence[str] = ()) -> int:
        """Profile the parts of ``df`` that aren't in yet; ``part`` names each row's. Returns how many were added."""
        named = df.withColumn("__part", (F.lit(part) if isinstance(part, str) else part).cast("string"))
        known = self.parts()
        if known:
            named = named.where(~F.col("__part").isin(sorted(known)))
        columns = frames.analysed_columns(df, row_key)
        dtypes = {c: frames.dtype(df, c) for c in columns}
        # One aggregate per column in one pass: the value stands in a column of its own for the sketches that are SQL only.
        inputs = [frames.column(c).alias(f"v{i}") for i, c in enumerate(columns)]
        shown = [frames.column(c).cast("string").alias(f"s{i}") for i, c in enumerate(columns)]
        rows, fields = named.select("__part", *inputs, *shown), []
        exprs = []
        for i, c in enumerate(columns):
            state = _state(F.col(f"v{i}"), dtypes[c])
            state["top"] = F.expr(f"approx_top_k_accumulate(s{i}, {TRACKED_VALUES})")
            exprs += [e.alias(f"c{i}_{m}") for m, e in state.items()]
            fields.append(F.struct(F.lit(c).alias("column"), F.lit(dtypes[c].simpleString()).alias("physical_type"), F.lit(i).alias("place"),
                                   *[F.col(f"c{i}_{m}").alias(m) for m in state]))
        wide = frames.stage(rows.groupBy("__part").agg(*exprs))
        states = wide.select(F.col("__part").alias("part"), F.inline(F.array(*fields)))
        states = frames.stage(states.withColumn("approx", F.hll_sketch_estimate("distinct")))
        added = states.select("part").distinct().count()
        if not added:
            return 0
        close = [F.abs(F.try_divide("approx", "non_null") - cut) <= profile.APPROX_MARGIN * cut for cut in profile.UNIQUE_CUTS]
        near = (F.col("approx") <= 200) | close[0] | close[1] | close[2] | close[3]
        wanted = {r["column"] for r in states.where(near).select("column").distinct().collect()}
        cells = [frames.cell_digest(i, F.col(f"v{i}")) for i, c in enumerate(columns) if c in wanted]
        digests = rows.select(F.col("__part").alias("part"), F.inline(F.array(*cells) if cells else F.array().cast(
            "array<struct<__column:int,__there:boolean,__digest_1:bigint,__digest_2:bigint>>"))).where("__there")
        names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (i, c)])
        digests = digests.select("part", names[F.col("__column")].alias("column"), *frames.DIGEST).distinct()
        counted = states.withColumn("digests", F.col("column").isin(sorted(wanted)))
        self._commit({"states": counted, "digests": digests, "parts": states.select("part").distinct()})
        return added

    def add_files(self, files: Iterable[str], read: Callable[[list[str]], DataFrame]) -> int:
        """Profile the files that aren't in yet, each a part of its own; ``read`` makes a frame of paths and sees new ones only."""
        known = self.parts()
        new = [f for f in files if f.rpartition("/")[2] not in known]
        return self.add(read(new), F.element_at(F.split(F.input_file_name(), "/"), -1)) if new else 0

    def _commit(self, tables: Mapping[str, DataFrame]) -> None:
        work = f"{self.path}/work/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{work}/{name}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        target = hadoop(f"{self.path}/commits/{len(self._commits()):09d}-{uuid.uuid4().hex}")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(target.getParent())
        if not system.rename(hadoop(work), target):
            raise OSError(f"the state could not be committed to {self.path}")

    # -- merging

    def merged(self) -> DataFrame:
        """One row per column: the states of all parts as one."""
        states = self._read("states")
        if states is None:
            raise ValueError("no part has been profiled yet")
        c = F.col
        mean = F.try_divide(F.sum(c("n") * F.coalesce("mean", F.lit(0.0))), F.sum("n"))
        sums = [F.sum(m).alias(m) for m in ("rows", "non_null", "length_sum", "n", "null_like", "numbers", "amounts", "structured", "date_like")]
        total = states.groupBy("column").agg(
            F.max("physical_type").alias("physical_type"), F.min("place").alias("place"), *sums,
            F.bool_and("words").alias("words"), F.bool_or("has_true").alias("has_true"), F.bool_or("has_false").alias("has_false"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), mean.alias("mean"),
            F.sum("squares").alias("within"), F.sum(c("n") * c("mean") * c("mean")).alias("raw_squares"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx"), F.expr(f"approx_top_k_combine(top, {TRACKED_VALUES})").alias("top"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"),
            F.bool_and("digests").alias("digests"),
        )
        between = F.greatest(c("raw_squares") - c("n") * c("mean") * c("mean"), F.lit(0.0))
        spread = F.when(c("n") > 1, F.sqrt(F.try_divide(c("within") + between, c("n") - 1))).when(c("n") == 1, 0.0).alias("std")
        return total.select("*", spread)

    def profile(self) -> profile.Profile:
        """The semantic schema of all parts together, from their states alone."""
        settled = frames.stage(self.merged())
        columns = settled.drop("top", "quantiles", "within", "raw_squares").orderBy("place").collect()
        exact = [r["column"] for r in columns if r["digests"]]
        unique: dict[str, int] = {}
        if exact:
            kept = self._read("digests").where(F.col("column").isin(exact)).select("column", *frames.DIGEST).distinct()
            unique = {r["column"]: r["n"] for r in kept.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        spans = self._read("states").select("column", F.inline("dates")).groupBy("column", "format").agg(
            F.sum("parsed").alias("parsed"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
        by_format = {(r["column"], r["format"]): r for r in spans}
        facts: dict[str, dict] = {}
        for r in columns:
            f = r.asDict() | {"unique": unique.get(r["column"], 0) if r["digests"] else r["approx"], "length": profile.stats_ratio(r["length_sum"] or 0, r["non_null"])}
            for i, label in enumerate(FORMATS):
                got = by_format.get((r["column"], label))
                f["date_mixed" if label == dates.MIXED else f"date{i}"] = got["parsed"] if got else 0
            if not f["rows"]:
                raise ValueError("cannot profile an empty table")
            profile.settle_type(r["column"], _type_of(r), f)
            facts[r["column"]] = f
        medians = self._medians(settled, {c: f["n"] for c, f in facts.items() if f["type"] == "Numerical" and f["n"]})
        listed = [c for c, f in facts.items() if f["type"] in ("Categorical", "Boolean")]
        tops = self._tops(settled, listed)
        records = [profile.record(c, _type_of(f), f, f["marks"][:profile.TOP_VALUES], medians.get(c),
                                  tops.get(c), _summary(f, by_format)) for c, f in facts.items()]
        return profile.Profile(self.spark, columns[0]["rows"], records, all(r["digests"] for r in columns))

    def _medians(self, settled: DataFrame, counts: Mapping[str, int]) -> dict[str, float]:
        """Between the two middle values of each column, which the sketch holds exactly as long as they are few."""
        if not counts:
            return {}

        def middle(n: int) -> Column:
            low, high = (n - 1) // 2, n // 2
            return (F.kll_sketch_get_quantile_double("quantiles", F.lit((low + 0.75) / n)) + F.kll_sketch_get_quantile_double("quantiles", F.lit((high + 0.75) / n))) / 2

        picked = F.coalesce(*[F.when(F.col("column") == c, middle(n)) for c, n in counts.items()])
        return {r["column"]: r["m"] for r in settled.where(F.col("column").isin(list(counts))).select("column", picked.alias("m")).collect()}

    def _tops(self, settled: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
        if not columns:
            return {}
        items = settled.where(F.col("column").isin(list(columns))).select("column", F.inline(F.expr(f"approx_top_k_estimate(top, {TRACKED_VALUES})")))
        order = Window.partitionBy("column").orderBy(F.desc("count"), "item")
        best = items.where(F.col("item").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile.TOP_VALUES)
        out: dict[str, dict[str, int]] = {c: {} for c in columns}
        for r in sorted(best.collect(), key=lambda r: r["place"]):
            out[r["column"]][r["item"]] = r["count"]
        return out


def _type_of(state: Row | Mapping) -> T.DataType:
    return T._parse_datatype_string(state["physical_type"])


def _summary(f: Mapping, spans: Mapping) -> dict:
    if f["type"] == "Numerical":
        return {"min": f["lo"], "max": f["hi"], "mean": None if f["mean"] is None or math.isnan(f["mean"]) else f["mean"], "std": f["std"]}
    if f["type"] == "Datetime":
        got = spans.get((f["column"], f.get("date_format") or "")) or spans.get((f["column"], dates.MIXED))
        return {"date_min": got["first"], "date_max": got["last"]} if got else {}
    return {}
