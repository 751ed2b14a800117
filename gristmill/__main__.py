"""Command line: `python -m gristmill run|gold|export --root FOLDER --run-id ID --now TIME`. Options given win over GRISTMILL_* variables, these over a JSON file."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from . import pipeline
from .sources.files import Store

OPTIONS = ("root", "run_id", "now")


def settings(given: dict[str, str | None], environ: dict[str, str], file: dict[str, str]) -> dict[str, str]:
    """Each option from the first place that names it."""
    out = {k: given.get(k) or environ.get(f"GRISTMILL_{k.upper()}") or file.get(k) for k in OPTIONS}
    missing = [k for k, v in out.items() if not v]
    if missing:
        raise SystemExit(f"not given: {', '.join(missing)}")
    return out  # type: ignore[return-value]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("command", choices=("run", "gold", "export"))
    parser.add_argument("--config", help="a JSON file of options")
    for k in OPTIONS:
        parser.add_argument("--" + k.replace("_", "-"))
    a = parser.parse_args(argv)
    file = json.load(open(a.config)) if a.config else {}
    cfg = pipeline.Config(**settings(vars(a), dict(os.environ), file))
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, f"{cfg.root}/state")
    if a.command == "run":
        pipeline.run(spark, store, cfg)
    elif a.command == "gold":
        for name, df in pipeline.views(store).items():
            print(name)
            df.show(20, truncate=60)
    else:
        pipeline.export(store, f"{cfg.root}/exports")


if __name__ == "__main__":
    main()
