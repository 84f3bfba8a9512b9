"""Live install commands: each is judged as it arrives, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkwarden.operators import commands as C


def stream_commands(commands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Block or allow decisions for a stream of commands against a static verdict table."""
    return C.judged_commands(commands, verdicts)


def stream_warnings(commands: DataFrame) -> DataFrame:
    """Warnings about risky installs in a stream of commands."""
    return C.risky_commands(commands)
