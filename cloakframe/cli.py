"""Command line: protect, profile, validate."""

from __future__ import annotations

import argparse
import json

from cloakframe import session
from cloakframe.operators import compare, profile
from cloakframe.plans import protect
from cloakframe.sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cloakframe")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("protect")
    a.add_argument("source")
    a.add_argument("target")
    a.add_argument("--text")
    a.add_argument("--manifest")
    a.add_argument("--style", action="store_true")
    a.add_argument("--author", help="column; values that an author repeats are masked wherever they stand")
    a = sub.add_parser("profile")
    a.add_argument("source")
    a = sub.add_parser("validate")
    a.add_argument("source")
    a.add_argument("result")
    a.add_argument("--text", required=True, nargs="+")
    x = p.parse_args(argv)
    spark = session.build()
    if x.command == "protect":
        print(json.dumps(protect.run(spark, x.source, x.target, x.text, x.manifest, x.style, x.author)))
    elif x.command == "profile":
        df = files.read_csv(spark, x.source)
        for r in profile.columns(df, [c for c in df.columns if c != "row_index"]).collect():
            print(json.dumps(r.asDict()))
    else:
        rows = compare.validate_exact(files.read_csv(spark, x.source), files.read_csv(spark, x.result), "row_index", x.text).collect()
        print(json.dumps({r.code: r.n for r in rows}))
        return int(bool({r.code for r in rows} - {"text_changed"}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
