"""python -m lithoframe inspect DIR | register CONFIG | run CONFIG | validate DIR"""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lithoframe")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, what in (("inspect", "folder"), ("register", "config"), ("run", "config"), ("validate", "folder")):
        sub.add_parser(verb).add_argument(what)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from lithoframe.plans import pipeline
    from lithoframe.session import local_session
    from lithoframe.sources import envi

    spark = local_session("*")
    if a.verb == "inspect":
        envi.summary(spark, a.folder).show(truncate=False)
        return 0
    if a.verb == "validate":
        out = pipeline.validate(spark, a.folder)
        print(json.dumps(out, indent=2))
        return 0 if out["valid"] else 1
    c = pipeline.load_config(a.config)
    print(json.dumps((pipeline.run if a.verb == "run" else pipeline.register)(spark, c), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
