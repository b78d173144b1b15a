"""Command line: inspect, query, explain, advise, convert, check, verify."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tabulon.operators.filters import where
from tabulon.operators.orders import page
from tabulon.plans import introspect
from tabulon.sources import text_io
from tabulon.sources.dataset import Dataset


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tabulon")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "check", "verify", "storage"):
        sub.add_parser(name).add_argument("path")
    for name in ("query", "explain", "estimate"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("table")
        p.add_argument("--filter", default="{}")
        p.add_argument("--select", default="")
        p.add_argument("--sort", default="")
        p.add_argument("--limit", type=int, default=100)
        p.add_argument("--offset", type=int, default=0)
    p = sub.add_parser("advise")
    p.add_argument("path")
    p.add_argument("table")
    p.add_argument("columns", nargs="+")
    p = sub.add_parser("convert")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--table", default="rows")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tabulon").getOrCreate()
    if a.command == "convert":
        kind = a.source.rsplit(".", 1)[-1]
        readers = {"csv": text_io.read_csv, "json": lambda s, x: text_io.read_json(s, x, lines=False), "jsonl": text_io.read_json, "xml": text_io.read_xml}
        print(json.dumps(Dataset.create(spark, a.target, {a.table: readers[kind](spark, a.source)}).inspect(), indent=2))
        return
    data = Dataset(spark, a.path)
    if a.command in ("inspect", "storage", "verify"):
        print(json.dumps(getattr(data, a.command)(), indent=2, default=str))
    elif a.command == "check":
        print(json.dumps(data.check_links(), indent=2, default=str))
    else:
        df = data.table(a.table)
        if a.command == "advise":
            print(json.dumps(introspect.advise(df, a.columns), indent=2))
        elif a.command == "estimate":
            print(json.dumps(introspect.estimate(df, json.loads(a.filter)), indent=2))
        elif a.command == "explain":
            print(introspect.explain(where(df, a.filter))["plan"])
        else:
            rows = page(where(df, a.filter), a.sort.split(",") if a.sort else [], a.offset, a.limit)
            print(text_io.json_string(rows.select(*a.select.split(",")) if a.select else rows, pretty=True))


if __name__ == "__main__":
    main()
