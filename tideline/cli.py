"""python -m tideline run|migrate|schema|version"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from . import __version__
from .config import load

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()})


def logger(level: str, fmt: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"unknown log level {level!r}")
    if fmt not in ("text", "json"):
        raise ValueError(f"unknown log format {fmt!r}")
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if fmt == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    root = logging.getLogger("tideline")
    root.handlers, root.level = [handler], LEVELS[level]


def checkpoint_folder(spark, given: str) -> str:
    """The folder given, else one in spark.checkpoint.dir, else (local master only) one here."""
    shared = given or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return given or f"{shared.rstrip('/')}/streams"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("give --checkpoint or set spark.checkpoint.dir to a folder that all executors share")
    return "tideline-checkpoints"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline", description="change data capture on Spark")
    commands = p.add_subparsers(dest="command", metavar="COMMAND")
    r = commands.add_parser("run", help="run the configured pipelines")
    r.add_argument("-config", "--config", default="tideline.yaml")
    r.add_argument("-log-level", "--log-level", default="info")
    r.add_argument("-log-format", "--log-format", default="text")
    r.add_argument("--checkpoint", default="", help="folder for streaming state that all executors share; else that of spark.checkpoint.dir")
    m = commands.add_parser("migrate", help="create the control tables")
    m.add_argument("-config", "--config", default="tideline.yaml")
    commands.add_parser("schema", help="print the control tables")
    commands.add_parser("version", help="print the version")
    commands.add_parser("help", help="print this")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    try:
        args = p.parse_args(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    try:
        if args.command is None:
            p.print_usage(sys.stderr)
            raise ValueError("a command is required")
        if args.command == "help":
            p.print_help()
        elif args.command == "version":
            print(__version__)
        elif args.command == "schema":
            from .streaming.control import DDL

            print(DDL.strip())
        elif args.command == "migrate":
            from .streaming.service import open_store

            store = open_store(load(args.config).control_plane.dsn)
            store.migrate()
            store.close()
        else:
            logger(args.log_level, args.log_format)
            config = load(args.config)
            from pyspark.sql import SparkSession

            from .streaming.service import run

            spark = SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            run(spark, config, checkpoint_folder(spark, args.checkpoint))
    except Exception as e:  # noqa: BLE001  the user gets one line
        print(f"tideline: {e}", file=sys.stderr)
        return 1
    return 0
