"""python -m tesselar fuse|reshard: re-shard a checkpoint folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tesselar.operators.reshard import fuse, reshard
from tesselar.plans.layout import MAX_SHARD_BYTES


def main(argv: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="tesselar", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("fuse", "write everything into one file"), ("reshard", "split over ranks")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("--input-dir", required=True)
        sub.add_argument("--output-dir", "-o", required=True)
        if name == "reshard":
            sub.add_argument("--target-world-size", "-t", type=int, required=True)
            sub.add_argument("--max-shard-bytes", type=int, default=MAX_SHARD_BYTES)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tesselar").getOrCreate()
    if args.command == "fuse":
        files = fuse(spark, args.input_dir, args.output_dir)
    else:
        files = reshard(spark, args.input_dir, args.output_dir, args.target_world_size, args.max_shard_bytes)
    print("\n".join(files))
    return files


if __name__ == "__main__":
    main()
