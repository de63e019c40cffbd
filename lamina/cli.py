"""``python -m lamina.cli convert | info | example | validate``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import ConversionError
from .plans import convert as C


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lamina")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("-i", "--input", required=True)
    one.add_argument("-o", "--output", required=True)
    one.add_argument("--from", dest="of", default="json", choices=C.FORMATS)
    one.add_argument("--to", default="striped", choices=C.FORMATS)
    commands.add_parser("info").add_argument("file")
    commands.add_parser("example").add_argument("-o", "--output", required=True)
    check = commands.add_parser("validate")
    check.add_argument("-d", "--data", required=True)
    check.add_argument("-s", "--schema", required=True)
    args = parser.parse_args(argv)
    if args.command == "example":
        print("\n".join(C.examples(args.output)))
        return 0
    spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if args.command == "convert":
            C.convert(spark, args.input, args.output, args.of, args.to)
        elif args.command == "info":
            print(json.dumps(C.info(spark, args.file), indent=2))
        else:
            got = C.validate_files(spark, args.data, args.schema)
            print("Validation: " + ("PASS" if got["valid"] else f"FAIL ({got['reason']})"))
            if got["roundtrip"] is not None:
                print("Roundtrip: " + ("PASS" if got["roundtrip"] else "FAIL"))
    except (ConversionError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
