"""Categories of commands and outputs, and display formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word boundaries, whatever the dialect's \b takes for a word character.
_END = r"(?![A-Za-z0-9_])"
_START = r"(?<![A-Za-z0-9_])"
#: White space as scripts count it: with no-break, byte-order and typographic spaces.
SPACE = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Patterns by category, tried in the order of ``command_category``.
INSTALL = rf"^(?:npm|pnpm|yarn|bun)\s+(?:install|i|add|dlx|create){_END}|^(?:pip3?|uv)\s+(?:install|sync|pip){_END}|^cargo\s+(?:fetch|install){_END}|^go\s+mod\s+(?:download|tidy){_END}|^make{_END}(?=.*-j)"
TEST = rf"(^|\s)(?:pytest|python\s+-m\s+pytest|python3\s+-m\s+pytest|jest|vitest|mocha|go\s+test|cargo\s+test|npm\s+test|pnpm\s+test|yarn\s+test|npx\s+(?:pytest|jest|vitest)|\./run-tests|test\.sh){_END}"
BUILD = rf"^docker\s+(?:build|pull|compose\s+(?:build|up)){_END}|^gradle{_END}|^mvn{_END}|^cmake{_END}|^ninja{_END}|^make{_END}|^cargo\s+(?:build|run){_END}|^(?:next|nuxt|vite|webpack|esbuild){_END}"
FETCH = rf"^wget{_END}|^curl\s+(?:-[A-Za-z]*[cof]|https?://)"
GIT_DIFF = rf"^git\s+diff{_END}(?!\s+--stat)"
TRIVIAL = rf"^(?:ls|ll|pwd|cd|echo|which|whoami|date|true|clear){_END}|^git\s+(?:status|st|branch|log\s+--oneline|diff\s+--stat|show\s+--stat|remote\s+-v|rev-parse){_END}"
FAILED = rf"(?i)(\d+\s+(?:failed|failing|errors?){_END})|{_START}FAILED{_END}|{_START}Traceback{_END}|{_START}panic(:| at)|AssertionError|Test{_END}.*{_START}failed{_END}"
PASSED = rf"(?i)(\d+\s+passed{_END})|{_START}OK{_END}.*\(\d+\s+tests?\)|all tests? (?:passed|ok)"
ERROR_LINE = r"^\s*(?:[A-Za-z_.]*[Ee]rror|[A-Za-z_.]*[Ee]xception|Traceback|FAIL|FAILED|failed|panic|warning|Warning|WARN)"
CONSTRAINT = rf"{_START}(don'?t|do not|never|must not){_END}|禁止|不要|不得|不能|无需"
REQUIREMENT = rf"{_START}(should|must|require|requires){_END}|需要|必须|要求"
FILE = r"(?i)^(\.|\./|/)?[\w.-]+(?:/[\w.-]+)*\.(py|ts|js|tsx|jsx|go|rs|java|c|cpp|sh|yml|yaml|json|nf|toml|md)(:\d+)?\z"
COMMAND = rf"{_START}(npm|pnpm|yarn|pip|uv|cargo|git|docker|make|pytest|jest){_END}"
BANDS = (("green", 0.55), ("yellow", 0.7), ("orange", 0.82), ("red", 0.9))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def command_category(command: Column) -> Column:
    """install, test, build, fetch, gitdiff, trivial or normal, by the first line; the first that matches."""
    line = trim(F.element_at(F.split(F.coalesce(command, F.lit("")), "\n", 2), 1))
    out = F.when(line.rlike(INSTALL), "install")
    for name, pattern in (("test", TEST), ("build", BUILD), ("fetch", FETCH), ("gitdiff", GIT_DIFF), ("trivial", TRIVIAL)):
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("normal")


def test_outcome(text: Column) -> Column:
    """fail (which wins), pass or unknown."""
    return F.when(text.rlike(FAILED), "fail").when(text.rlike(PASSED), "pass").otherwise("unknown")


def is_noise_command(command: Column, is_error: Column) -> Column:
    return ~is_error & command_category(command).isin("install", "fetch", "trivial", "build")


def is_error_line(line: Column) -> Column:
    return line.rlike(ERROR_LINE)


def pin_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(CONSTRAINT), "constraint").when(low.rlike(REQUIREMENT), "requirement")
        .when(trim(low).rlike(FILE), "file").when(low.rlike(COMMAND) & (F.length(low) < 120), "command").otherwise("note")
    )


def band_label(pressure: Column) -> Column:
    out = F.when(pressure < BANDS[0][1], BANDS[0][0])
    for name, below in BANDS[1:]:
        out = out.when(pressure < below, name)
    return out.otherwise("critical")


def one_decimal(n: Column) -> Column:
    """n / 1000 with one decimal, by the binary fraction's own value; the ties that are exact go up."""
    nudged = n + F.when(n % 1000 == 250, 1).otherwise(0)
    return F.replace(F.format_number(nudged / F.lit(1000.0), 1), F.lit(","), F.lit(""))


def short_count(n: Column) -> Column:
    """1.2K from a thousand on, else the whole number."""
    return F.when(n >= 1000, F.concat(one_decimal(n), F.lit("K"))).otherwise(F.round(n).cast("long").cast("string"))


def percent(x: Column, digits: int = 0) -> Column:
    """Rounded half up; scaled by one factor, as x * 100 * 10 is rounded twice and loses ties."""
    if digits:
        return F.concat(F.format_string(f"%.{digits}f", F.floor(x * 10 ** (digits + 2) + 0.5) / 10**digits), F.lit("%"))
    return F.concat(F.floor(x * 100 + 0.5).cast("long").cast("string"), F.lit("%"))
