"""CSV records with their position, parsed in parallel inside one file.

A quoted field may hold separators, doubled quotes and line breaks, so a split
of a file cannot tell by itself whether its first line lies inside quotes.
Each split is therefore read under both assumptions at once: for a line, the
state after it given the state before it.  A split is then one of four
functions of its entry state (keep, flip, always outside, always inside), and
their running composition over the splits of a file gives every entry state.
Lines that are records by themselves stay where they are; only lines of
records that span several lines are grouped.

A record's position is (file, first byte of its split, line in the split).  Its
dense row number follows from it without a sort: the records begun before it in
its split, plus those begun in earlier splits and files.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rank import running_total
from ..session import drop_stored, map_arrow, stored

POSITION = ("_file", "_split", "_line", "_row")
_MAX_BROADCAST_SPLITS = 200_000  # splits (one short row each) sent to every task; beyond it a shuffled join


def _inside_after(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether the end of a line lies inside quotes.  A quote opens at the start of a field only; a doubled one is text."""
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _scan(sep: str, quote: str):
    """Lines in order with their number in the split and, under both assumptions (suffix 0: the split starts outside
    quotes, 1: inside), the state before and after the line, the line that its record starts at (-1: an earlier split) and
    the records that begin in the split before it (blank lines are none).
    """
    def states(lines: pa.Array, carry: list[dict]) -> dict[str, pa.Array]:
        quoted = np.flatnonzero(np.asarray(pc.match_substring(lines, quote)))
        before = [c["state"] for c in carry]
        outs: tuple[list, list] = ([], [])
        for j in quoted.tolist():
            text = lines[j].as_py()
            after = [_inside_after(text, before[0], sep, quote)]
            after.append(after[0] if before[0] == before[1] else _inside_after(text, before[1], sep, quote))
            before = after
            outs[0].append(after[0])
            outs[1].append(after[1])
        at = np.arange(len(lines))
        number = carry[0]["lines"] + at
        full = ~np.asarray(pc.is_in(lines, value_set=pa.array(["", "\r"], lines.type)))
        cols = {"_line": pa.array(number, pa.int64())}
        for i in (0, 1):
            seq = np.array([carry[i]["state"], *outs[i]], dtype=bool)
            pre, post = seq[np.searchsorted(quoted, at, "left")], seq[np.searchsorted(quoted, at, "right")]
            start = np.maximum(np.maximum.accumulate(np.where(pre, -1, number)), carry[i]["start"])
            begun = carry[i]["begun"] + np.cumsum(full & ~pre)
            carry[i] = {"state": bool(post[-1]), "lines": int(number[-1]) + 1, "start": int(start[-1]), "begun": int(begun[-1])}
            cols |= {f"pre{i}": pa.array(pre), f"post{i}": pa.array(post), f"start{i}": pa.array(start, pa.int64()), f"begun{i}": pa.array(begun - (full & ~pre), pa.int64())}
        return cols

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            files, splits = batch.column(1).dictionary_encode(), np.asarray(batch.column(2))
            codes = np.asarray(files.indices)
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = (files.dictionary[int(codes[a])].as_py(), int(splits[a]))
                if now != key:
                    key, carry = now, [{"state": bool(i), "lines": 0, "start": -1, "begun": 0} for i in (0, 1)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({name: part.column(name) for name in part.schema.names} | states(part.column(0), carry))
    return job


def _splits(scanned: DataFrame) -> DataFrame:
    """One row per split: entry state, the record that its first lines go on with, and its file's header record."""
    full = ~F.col("value").isin("", "\r")
    heads = [F.min(F.when(full & ~F.col(f"pre{i}"), F.struct("_line", F.col("value").alias("text"), F.col(f"post{i}").alias("more")))).alias(f"head{i}") for i in (0, 1)]
    last = F.max(F.struct("_line", "post0", "post1", "start0", "start1")).alias("end")
    counts = [F.count_if(full & ~F.col(f"pre{i}")).alias(f"count{i}") for i in (0, 1)]
    ends = (scanned.groupBy("_file", "_split").agg(last, *heads, *counts)
            .select("_file", "_split", "head0", "head1", "count0", "count1", *[F.col(f"end.post{i}").alias(f"state{i}") for i in (0, 1)], *[F.col(f"end.start{i}").alias(f"start{i}") for i in (0, 1)]))
    order = Window.partitionBy("_file").orderBy("_split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = (F.col("state0") & ~F.col("state1")).cast("long")  # inside becomes outside and the other way round
    fixed = F.when(F.col("state0") == F.col("state1"), F.struct(F.col("state0").alias("state"), F.sum(flips).over(order).alias("flips")))
    known = (ends.withColumn("fixed", fixed)
             .withColumn("flipped", F.coalesce(F.sum(flips).over(earlier), F.lit(0)))
             .withColumn("last", F.last("fixed", True).over(earlier))
             .withColumn("inside", F.coalesce(F.col("last.state"), F.lit(False))
                         != ((F.col("flipped") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1)))

    def actual(name: str):
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    begun = F.when(actual("start") >= 0, F.struct(F.col("_split").alias("split"), actual("start").alias("line")))
    top = actual("head")
    head = F.when(top.isNotNull(), F.struct(F.col("_split").alias("split"), top["_line"].alias("line"), top["text"].alias("text"), top["more"].alias("more")))
    return (known.withColumn("open", actual("state"))
            .withColumn("from", F.last(begun, True).over(earlier))
            .withColumn("header", F.first(head, True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("final", F.lead("_split").over(order).isNull())
            .withColumn("own", actual("count") - F.coalesce((F.col("header.split") == F.col("_split")).cast("long"), F.lit(0)))  # without the header
            .select("_file", "_split", "inside", "open", "from", "header", "final", "own"))


def _names(header: str, sep: str, quote: str) -> list[str]:
    """Column names of a header record: empty ones are numbered, repeated ones get a counter."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header], delimiter=sep, quotechar=quote), [])):
        name = name or f"Unnamed: {i}"
        given, k = name, 0
        while name in out:
            k += 1
            name = f"{given}.{k}"
        out.append(name)
    return out


def read_records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """All data records of the CSV files under ``path`` as text columns, with ``POSITION`` columns; ``_row`` numbers them
    from 0 without gaps, in the order of the files' paths and of the records in them.

    The first record of a file that is not blank is its header; files must agree on it.  Blank lines are skipped.  Missing
    last fields are NULL, fields beyond the header's are left out.  Line breaks inside quotes are kept as they are; a
    record may end in LF or CRLF.  Lines, then records, are stored in the shared folder, as another scan could cut
    the files elsewhere (split sizes follow the cores at hand); only the records stay.  Partition folders (``name=value``) become columns.  A quote that is never closed, files
    with different headers and a path without any header raise ValueError.  Texts are UTF-8.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    extra = [c for c in raw.columns if c != "value"]
    lines = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), *[F.col(f"`{c}`") for c in extra])
    schema = lines.withColumn("_line", F.lit(0).cast("long"))
    for i in (0, 1):
        schema = schema.withColumn(f"pre{i}", F.lit(False)).withColumn(f"post{i}", F.lit(False)).withColumn(f"start{i}", F.lit(0).cast("long")).withColumn(f"begun{i}", F.lit(0).cast("long"))
    scanned = stored(map_arrow(lines, _scan(sep, quote), schema.schema), "csv-lines")
    splits = stored(running_total(stored(_splits(scanned), "csv-splits"), ["_file", "_split"], "own", out="_rows"), "csv-offsets")
    unclosed = splits.filter("final and open").select("_file").limit(1).collect()
    if unclosed:
        raise ValueError(f"a quote is never closed in {unclosed[0]['_file']}")
    known = splits.select("_file", "_split", "inside", "from", "_rows", F.struct("header.split", "header.line").alias("header"))
    if splits.count() <= _MAX_BROADCAST_SPLITS:
        known = F.broadcast(known)

    def actual(name: str):
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    placed = (scanned.join(known, ["_file", "_split"]).withColumn("first", ~actual("pre")).withColumn("ends", ~actual("post"))
              .withColumn("begin", F.when(actual("start") >= 0, F.struct(F.col("_split").alias("split"), actual("start").alias("line"))).otherwise(F.col("from")))
              .withColumn("_row", F.col("_rows") + actual("begun") - (F.col("header.split") == F.col("_split")).cast("long")))
    carried = [F.col(f"`{c}`") for c in extra]
    alone = placed.filter("first and ends").select(*POSITION, "value", "header", *carried)
    pieces = F.array_sort(F.collect_list(F.struct("_split", "_line", "value")))
    spanning = (placed.filter("not (first and ends)").groupBy("_file", F.col("begin.split").alias("_s"), F.col("begin.line").alias("_l"))
                .agg(F.min_by("_row", F.struct("_split", "_line")).alias("_row"), F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"), F.first("header").alias("header"), *[F.first(c).alias(n) for c, n in zip(carried, extra)])
                .select("_file", F.col("_s").alias("_split"), F.col("_l").alias("_line"), "_row", "value", "header", *carried))
    records = alone.unionByName(spanning).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    is_header = (F.col("_split") == F.col("header.split")) & (F.col("_line") == F.col("header.line"))
    heads = splits.filter("header is not null").select("header.text", "header.more").distinct().limit(3).collect()
    if any(h["more"] for h in heads):  # a header with line breaks in its names
        texts = [r["value"] for r in records.filter(is_header).select("value").distinct().limit(2).collect()]
    else:
        texts = sorted({h["text"].removesuffix("\r") for h in heads})
    texts = sorted({t.removeprefix("\ufeff") for t in texts})
    if len(texts) != 1:
        raise ValueError(f"no header record under {path}" if not texts else f"files under {path} have different headers")
    names = _names(texts[0], sep, quote)
    fields = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"sep": sep, "quote": quote, "escape": quote, "maxColumns": str(len(names) + 1024)})
    # stored, so that the passes that find the types group the lines of long records only once
    data = stored(records.filter((F.col("value") != "") & ~is_header).drop("header"), "csv-records").withColumn("_f", fields)
    drop_stored(scanned, splits)
    return data.select(*POSITION, *[F.col(f"_f.c{i}").alias(n) for i, n in enumerate(names)], *[c for c, n in zip(carried, extra) if n not in names])
