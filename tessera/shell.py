"""A shell: `python -m tessera.shell FOLDER` reads statements that end in a semicolon."""

from __future__ import annotations

import sys
from typing import TextIO

from tessera.api import Database
from tessera.session import build_session


def repl(db: Database, lines: TextIO, out: TextIO, rows: int = 100) -> None:
    """Run each statement and print its first rows; an error is printed, and the next one read."""
    held = ""
    for line in lines:
        if not held and line.strip().lower() in {"quit", "exit", "\\q"}:
            return
        held += line
        if not held.rstrip().endswith(";"):
            continue
        text, held = held.strip().rstrip(";"), ""
        try:
            try:
                found = db.ddl(text)
            except ValueError as e:
                if not str(e).startswith("not a schema statement"):
                    raise
                found = db.run(text)
            shown = found.take(rows)
            print(" | ".join(found.columns), file=out)
            for r in shown:
                print(" | ".join("null" if v is None else str(v) for v in r), file=out)
        except Exception as e:  # a shell goes on
            print(f"error: {e}", file=out)


if __name__ == "__main__":
    repl(Database(build_session("local[*]"), sys.argv[1]), sys.stdin, sys.stdout)
