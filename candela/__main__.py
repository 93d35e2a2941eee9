"""The engine's queries and calls from the command line.

    python -m candela list
    python -m candela query golden_cross --data /data/sf1 --rows 20
    python -m candela call screen_stocks --data /data/sf1 --args '{"top_n": 5}'
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="candela")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for command in ("query", "call"):
        sub = commands.add_parser(command)
        sub.add_argument("name")
        sub.add_argument("--data", required=True)
        sub.add_argument("--rows", type=int, default=20)
        sub.add_argument("--args", default="{}")
    given = parser.parse_args(argv)
    from candela import api, plans

    if given.command == "list":
        print("\n".join([*(f"query {k}" for k in sorted(plans.QUERIES)), *(f"call {k}" for k in sorted(api.CALLS))]))
        return 0
    from candela.session import session

    spark = session()
    if given.command == "query":
        if given.name not in plans.QUERIES:
            print(f"unknown query: {given.name}", file=sys.stderr)
            return 2
        for row in plans.QUERIES[given.name](spark, given.data).limit(given.rows).collect():
            print(json.dumps(row.asDict(True), default=str))
        return 0
    answer = api.call(spark, given.data, given.name, **json.loads(given.args))
    print(json.dumps(answer, default=str))
    return 0 if answer["error"] is None else 1


if __name__ == "__main__":
    raise SystemExit(main())
