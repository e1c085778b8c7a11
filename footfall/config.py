"""Settings of a run, passed as an argument to whatever needs them."""

from __future__ import annotations

from dataclasses import dataclass

# The dump tables a site exports, one CSV file each.
DUMP_TABLES = (
    "AUTHOR",
    "BOOK",
    "BOOK_AUTHOR",
    "BOOK_RELATED_BOOK",
    "CATEGORY",
    "CATEGORY_RELATED_CATEGORY",
    "COMMENT",
    "EDITORIAL_REVIEW",
    "GROUP",
    "GROUP_MODULE",
    "MODULE",
    "ORDER",
    "ORDER_ITEM",
    "USER",
    "USER_GROUP",
)


# What a session should have set. Log times are read as UTC. A stage of generated code that is
# too long for the JVM to compile (8000 bytes) is better run operator by operator.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


@dataclass(frozen=True)
class Limits:
    """When a lookup side is broadcast.

    A lookup is broadcast only if counting it shows at most ``broadcast_rows`` rows and
    ``broadcast_bytes`` bytes of values. Anything larger is joined by a shuffle.
    """

    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 * 1024 * 1024


@dataclass(frozen=True)
class Settings:
    """Where a site's inputs are and where results go. All paths are URIs Spark can read.

    ``web_model`` and ``data_model`` are lists of XML paths or globs; ``dumps`` is the folder
    with ``<TABLE>.csv`` files; ``access_logs`` and ``runtime_logs`` are lists of text paths or
    globs. ``output`` holds the enriched log, the reports and the state of incremental runs.
    ``merge_sessions`` leaves the session out of the keys by which repeated events of one second
    are collapsed, so that equal events of two sessions in the same second count once.
    ``single_file`` writes each CSV and JSON report as one file, by one task.

    ``files_per_batch`` is how many new log files a step of the intake reads. ``buckets`` is into how
    many parts at least a day's lines, and the dumped values, are divided by the keys they are joined on;
    more if the first run's files are large. The number holds from the first run on. A day whose lines lie in more than ``parts_per_day`` parts is folded into one.
    """

    web_model: tuple[str, ...]
    data_model: tuple[str, ...]
    dumps: str
    access_logs: tuple[str, ...]
    runtime_logs: tuple[str, ...]
    output: str
    dump_tables: tuple[str, ...] = DUMP_TABLES
    merge_sessions: bool = False
    single_file: bool = False
    limits: Limits = Limits()
    files_per_batch: int = 10_000
    buckets: int = 64
    parts_per_day: int = 4

    @property
    def logs(self) -> dict[str, tuple[str, ...]]:
        return {"access": self.access_logs, "runtime": self.runtime_logs}

    @property
    def enriched(self) -> str:
        return f"{self.output}/enriched"

    @property
    def parsed(self) -> str:
        return f"{self.output}/parsed"

    @property
    def extracts(self) -> str:
        return f"{self.output}/extracts"

    @property
    def staged(self) -> str:
        return f"{self.output}/staged"

    @property
    def quarantine(self) -> str:
        return f"{self.output}/quarantine"

    @property
    def aggregates(self) -> str:
        # Counts that keep sessions apart and counts that do not are not the same.
        return f"{self.output}/aggregates/{'merged' if self.merge_sessions else 'apart'}"

    @property
    def values(self) -> str:
        return f"{self.output}/values"

    @property
    def model(self) -> str:
        return f"{self.output}/model"

    @property
    def line_counts(self) -> str:
        return f"{self.output}/lines"

    @property
    def reports(self) -> str:
        return f"{self.output}/reports"

    @property
    def state(self) -> str:
        return f"{self.output}/state"

    @classmethod
    def under(cls, base: str, web_model: str, data_model: str, dumps: str, access_logs: str,
              runtime_logs: str, output: str, **more) -> Settings:
        """Settings for the usual folder layout below ``base``."""
        web = f"{base}/{web_model}"
        # File name patterns of the design model and of the two logs.
        return cls(
            web_model=(
                f"{web}/*/*/*/page*.wr",
                f"{web}/*/*/page*.wr",
                f"{web}/*/mpage*.wr",
                f"{web}/*/*/*/Properties.wr",
                f"{web}/*/*/Properties.wr",
            ),
            data_model=(f"{base}/{data_model}/Properties.wr",),
            dumps=f"{base}/{dumps}",
            access_logs=(f"{base}/{access_logs}/localhost*.txt",),
            runtime_logs=(f"{base}/{runtime_logs}/RTX.*",),
            output=f"{base}/{output}",
            **more,
        )
