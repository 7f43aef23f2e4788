"""``python -m tidemark.cli --site NAME --root DIR``: statements from standard input.

``.push``, ``.pull``, ``.sync``, ``.tables``, ``.dump`` (operations as JSON lines),
``.help`` and ``.quit`` are commands; anything else is a statement.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from tidemark.functions.display import table
from tidemark.plans.dialect import Select, parse
from tidemark.replica import Replica
from tidemark.sources.oplog import OpLog
from tidemark.sources.snapshots import SnapshotStore

HELP = ".push .pull .sync .tables .dump .help .quit, or a statement"


def run(replica: Replica, lines: Iterable[str]) -> Iterator[str]:
    """What each line of input gives."""
    for line in lines:
        text = line.strip()
        try:
            match text:
                case "":
                    continue
                case ".quit" | ".exit":
                    return
                case ".help":
                    yield HELP
                case ".push":
                    yield f"entry {replica.push()}"
                case ".pull":
                    yield f"{replica.pull()} entries"
                case ".sync":
                    yield f"{replica.sync()} entries"
                case ".tables":
                    yield "\n".join(sorted(replica.schemas())) or "no tables"
                case ".dump":
                    yield from replica.operations().toJSON().toLocalIterator()
                case _ if isinstance(parse(text), Select):
                    found = replica.query(text)
                    yield table(found.columns, [tuple(r) for r in found.toLocalIterator()])
                case _:
                    yield f"{replica.execute(text)} operations"
        except ValueError as e:
            yield f"error: {e}"


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--site", required=True)
    args.add_argument("--root", required=True)
    a = args.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    replica = Replica(spark, a.site, OpLog(f"{a.root}/log"), SnapshotStore(f"{a.root}/snapshots"), f"{a.root}/{a.site}.json")
    for out in run(replica, sys.stdin):
        print(out, flush=True)


if __name__ == "__main__":
    main()
