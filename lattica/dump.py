"""Bytes of a file as rows of hex and text: ``python -m lattica.dump [-offset N] [-length N] FILE``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F

from lattica.functions.strings import hex_rows
from lattica.session import session


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica.dump")
    parser.add_argument("-offset", type=int, default=0)
    parser.add_argument("-length", type=int, default=256)
    parser.add_argument("file")
    a = parser.parse_args(arguments)
    if a.offset < 0 or a.length < 0:
        parser.error("offset and length are not negative")
    spark = session("local[1]", "dump")
    rows = spark.read.format("binaryFile").load(a.file).select(F.explode(hex_rows(F.col("content"), a.offset, a.length)).alias("r")).select("r.*")
    for row in rows.orderBy("at").toLocalIterator():
        pairs = " ".join(row["hex"][k : k + 2] for k in range(0, len(row["hex"]), 2))
        print(f"{row['at']:08x}  {pairs:<47}  {row['ascii']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
