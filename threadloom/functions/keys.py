"""Keys that tell which calls repeat which, and read ranges, as column expressions over a call's name and raw JSON arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import command_category, trim

# How a test run's runner and target are found in its command.
RUNNER = r"(pytest|jest|vitest|mocha|go\s+test|cargo\s+test|npm\s+test|pnpm\s+test|yarn\s+test|npx\s+\S+)"
TARGET = r"\s((?:[A-Za-z0-9_.$-]+/)+[A-Za-z0-9_.$-]*|(?<![A-Za-z0-9_])tests?(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Za-z0-9_-]+(?![A-Za-z0-9_]))(?=\s|\z)"


TEXTS, NUMBERS = ("path", "file_path", "pattern", "glob", "command"), ("offset", "start_line", "line_start", "limit", "end_line")


def _text(doc: Column, name: str) -> Column:
    at = F.try_variant_get(doc, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))


def _number(doc: Column, name: str) -> Column:
    at = F.try_variant_get(doc, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(at).rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get(doc, f"$.{name}", "double"))


def argument(arguments: Column, name: str) -> Column:
    """A string argument; null if absent or of another type."""
    return _text(F.try_parse_json(arguments), name)


def with_arguments(rows: DataFrame, arguments: str = "call_arguments") -> DataFrame:
    """``rows`` with the arguments that keys use as columns a_path, ...: strings that are strings, numbers that are numbers. The JSON is parsed once."""
    rows = rows.withColumn("a_doc", F.try_parse_json(F.col(arguments)))
    return rows.withColumns({f"a_{n}": _text(F.col("a_doc"), n) for n in TEXTS} | {f"a_{n}": _number(F.col("a_doc"), n) for n in NUMBERS}).drop("a_doc")


def normalized_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"/+\z", ""))


def file_of() -> Column:
    """The call's path; an empty ``path`` hides ``file_path``."""
    path = F.coalesce("a_path", "a_file_path")
    return F.when(path != "", normalized_path(path))


def test_key(command: Column) -> Column:
    runner = F.regexp_extract(command, RUNNER, 1)
    runner = F.when(runner != "", runner).otherwise(F.element_at(F.split(command, r"\s+"), 1))
    target = F.regexp_extract(command, TARGET, 1)
    return F.lower(F.concat(F.lit("test:"), runner, F.lit(":"), F.when(target != "", target).otherwise("*")))


def normalized_command(command: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(command, F.lit("")), r"\s+", " ")))


def search_key(name: Column) -> Column:
    scope = lambda *names: F.coalesce(*(F.concat(F.lit("@"), F.nullif(F.lower(trim(F.col(n))), F.lit(""))) for n in names), F.lit(""))
    pattern = F.nullif(F.lower(trim(F.col("a_pattern"))), F.lit(""))
    return (
        F.when(name == "grep", F.concat(F.lit("grep:"), pattern, scope("a_path", "a_glob")))
        .when(name == "find", F.concat(F.lit("find:"), pattern, scope("a_path")))
        .when(name == "ls", F.concat(F.lit("ls:"), F.coalesce(F.nullif(F.lower(trim(F.col("a_path"))), F.lit("")), F.lit("."))))
    )


def group_key(name: Column) -> Column:
    """What later calls of the same key supersede, over the columns of ``with_arguments``; null for calls that stand alone."""
    command = F.coalesce("a_command", F.lit(""))
    run = F.when(command_category(command) == "test", test_key(command)).when(trim(command) != "", F.concat(F.lit("bash:"), normalized_command(command)))
    return (
        F.when(name == "read", F.concat(F.lit("read:"), file_of()))
        .when(name.isin("grep", "find", "ls"), search_key(name))
        .when(name == "bash", run)
    )


def read_range() -> Column:
    """(full, first, last): lines a read covers; the last is infinite without a limit."""
    offset, limit, end = F.coalesce("a_offset", "a_start_line", "a_line_start"), F.col("a_limit"), F.col("a_end_line")
    full = offset.isNull() & limit.isNull() & end.isNull()
    first = F.when(full, 0.0).otherwise(F.coalesce(offset, F.lit(1.0)))
    infinite = F.lit(float("inf"))
    last = F.when(full, infinite).when(limit.isNotNull(), first + F.greatest(F.lit(0.0), limit - 1)).otherwise(F.coalesce(end, infinite))
    return F.struct(full.alias("full"), first.alias("first"), last.alias("last"))
