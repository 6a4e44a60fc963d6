"""python -m tidemark pack ROOT TABLE [--target N] | info ROOT"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.engine import Engine


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("pack", help="rewrite a table into files of --target rows")
    pack.add_argument("root")
    pack.add_argument("table")
    pack.add_argument("--target", type=int, default=8192)
    info = commands.add_parser("info", help="show tables, sizes and counters")
    info.add_argument("root")
    given = parser.parse_args(arguments)
    try:
        engine = Engine(SparkSession.builder.getOrCreate(), given.root)
        if given.command == "pack":
            size = lambda: sum(c.stored_bytes for c in engine.catalog.table(given.table).commits)
            before = size()
            engine.pack_table(given.table, given.target)
            print(f"packed {given.table}: target={given.target} size={before} -> {size()} bytes")
        else:
            found = engine.diagnostics()
            print(f"path: {given.root}\nlast_seq: {engine.last_seq}\nretention_ms: {engine.retention_ms}")
            for name, value in found.items():
                if name not in ("tables", "maintenance"):
                    print(f"{name}: {value}")
            for name, value in found["maintenance"].items():
                print(f"maintenance_{name}: {value}")
            for t in found["tables"]:
                print(f"- {t['table']}: rows={t['rows']} segments={t['segments']} ratio={t['total_compression_ratio']}")
                for c in t["columns"]:
                    print(f"    {c['column']} ({c['type']}): logical={c['logical_bytes']} stored={c['stored_bytes']} nulls={c['nulls']}")
    except (KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
