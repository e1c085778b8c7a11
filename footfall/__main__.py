"""Runs a site's logs through enrichment and reports, for use with spark-submit.

    spark-submit ... run.py BASE WEB_MODEL DATA_MODEL DUMPS ACCESS_LOGS RUNTIME_LOGS OUTPUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from footfall.config import SESSION, Settings
from footfall.plans import pipeline


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="footfall", description="Enrich server logs and report on them.")
    parser.add_argument("base", help="URI all other paths are below")
    parser.add_argument("web_model", help="folder with the pages of the design model")
    parser.add_argument("data_model", help="folder with the entities of the design model")
    parser.add_argument("dumps", help="folder with one CSV file per database table")
    parser.add_argument("access_logs", help="folder with the HTTP access logs")
    parser.add_argument("runtime_logs", help="folder with the application's runtime logs")
    parser.add_argument("output", help="folder for the enriched log, the reports and the state")
    parser.add_argument("--tables", nargs="+", help="dumped tables, if not the usual ones")
    parser.add_argument("--merge-sessions", action="store_true", help="count equal events of one second once")
    parser.add_argument("--single-file", action="store_true", help="write each CSV and JSON report as one file")
    parser.add_argument("--reports-only", action="store_true", help="take in no logs")
    return parser.parse_args(words)


def settings_of(given: argparse.Namespace) -> Settings:
    more = {"dump_tables": tuple(given.tables)} if given.tables else {}
    return Settings.under(
        given.base,
        given.web_model,
        given.data_model,
        given.dumps,
        given.access_logs,
        given.runtime_logs,
        given.output,
        merge_sessions=given.merge_sessions,
        single_file=given.single_file,
        **more,
    )


def main(words: list[str] | None = None) -> None:
    given = arguments(words)
    spark = SparkSession.builder.appName("footfall").config(map=SESSION).getOrCreate()
    if given.reports_only:
        pipeline.write_reports(spark, settings_of(given))
    else:
        pipeline.run(spark, settings_of(given))


if __name__ == "__main__":
    main()
