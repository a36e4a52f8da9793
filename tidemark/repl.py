"""A prompt for the dialect: statements end with a semicolon; ``\\dt``, ``\\d table``, ``\\dump [file]`` and ``\\q``."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from tidemark.plans.lexer import SqlError
from tidemark.store.database import Database


def respond(db: Database, line: str) -> str | None:
    """The answer to one meta-command or statement; None to leave."""
    word, _, rest = line.strip().partition(" ")
    rest = rest.strip()
    if word == "\\q":
        return None
    if word == "\\dt":
        return _table(db.sql("SELECT table_name, table_type FROM information_schema.tables ORDER BY table_name"))
    if word == "\\d":
        return _table(db.sql("SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = $1 ORDER BY ordinal_position", [rest]))
    if word == "\\dump":
        script = db.dump().orderBy("step").select("statement")
        if rest:
            script.select("statement").coalesce(1).write.mode("overwrite").option("lineSep", ";\n").text(rest)
            return f"written to {rest}"
        return "\n".join(r[0] + ";" for r in script.toLocalIterator())
    if word.startswith("\\"):
        return f"unknown command {word}"
    out = db.execute(line)
    return _table(out.frame) if out.frame is not None else out.message or f"{out.count} rows"


#: Rows that are printed.
SHOWN = 1_000


def _table(frame) -> str:
    found = frame.limit(SHOWN + 1).collect()
    rows = [[str(x) if x is not None else "" for x in r] for r in found[:SHOWN]]
    count = f"(first {SHOWN} rows, there are more)" if len(found) > SHOWN else f"({len(rows)} rows)"
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(frame.columns)]
    show = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip()
    return "\n".join([show(frame.columns), "-+-".join("-" * w for w in widths), *map(show, rows), count])


def run(db: Database, lines: Iterable[str]) -> Iterator[str]:
    held = ""
    for line in lines:
        if not held and line.lstrip().startswith("\\"):
            command = line.strip()
        else:
            held += line
            if not line.rstrip().endswith(";"):
                continue
            command, held = held.strip(), ""
        try:
            answer = respond(db, command)
        except SqlError as e:
            answer = f"error: {e}"
        if answer is None:
            return
        yield answer


def main() -> None:
    from tidemark.session import get_session

    for answer in run(Database(get_session(), sys.argv[1]), sys.stdin):
        print(answer)


if __name__ == "__main__":
    main()
