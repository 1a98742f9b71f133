"""python -m siftflow PATH QUERY: rows of a query over Parquet or JSON lines, as lines of JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftflow.engine import Engine
from siftflow.frame import LogFrame
from siftflow.sources import common, formats


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("query")
    p.add_argument("--time", default="_time", help="the column of the time")
    p.add_argument("--msg", default="_msg", help="the column of the message")
    p.add_argument("--stream", default="", help="the columns that tell streams apart, with commas between them")
    p.add_argument("--limit", type=int, default=1000, help="rows that are printed at most")
    p.add_argument("--explain", action="store_true", help="print the plan and run nothing")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    stream = tuple(filter(None, a.stream.split(",")))
    if a.path.endswith((".json", ".jsonl", ".ndjson")):
        how = common.Ingest(time_fields=(a.time,), msg_fields=(a.msg,), stream_fields=stream)
        fr = common.log(common.accepted(formats.json_lines(spark, a.path, how)))
    else:
        fr = LogFrame.of(spark.read.parquet(a.path), a.time, a.msg, stream)
    e = Engine(fr)
    if a.explain:
        e.explain(a.query)
        return
    for r in e.json_lines(a.query, a.limit).toLocalIterator():
        print(r.line)


if __name__ == "__main__":
    main()
