"""Names: date-suffixed tables, connection strings, log positions, file names."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterable
from datetime import datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix patterns, tried in this order.
SUFFIXES = ("_\\d{6}$", "_\\d{8}$", "_\\d{4}$", "\\d{6}$", "\\d{8}$", "\\d+$")


def prefix(name: str) -> str:
    """A table name without its date suffix, by the first pattern that fits."""
    fitting = next((s for s in SUFFIXES if re.search(s, name)), None)
    return re.sub(fitting, "", name) if fitting else name


def prefix_column(name: Column) -> Column:
    out = name
    for s in reversed(SUFFIXES):
        out = F.when(name.rlike(s), F.regexp_replace(name, s, "")).otherwise(out)
    return out


def grouped(names: Iterable[str]) -> dict[str, list[str]]:
    """Names by prefix, in their order."""
    found: dict[str, list[str]] = {}
    for n in names:
        found.setdefault(prefix(n), []).append(n)
    return found


def year_month(text: str) -> tuple[datetime, datetime]:
    """The month of YYYYMM as a range whose end is its last second."""
    if not re.fullmatch(r"\d{6}", text) or not 1 <= int(text[4:]) <= 12 or not 1900 <= int(text[:4]) <= 2100:
        raise ValueError(f"not a month: {text!r}")
    y, m = int(text[:4]), int(text[4:])
    return datetime(y, m, 1), datetime(y, m, calendar.monthrange(y, m)[1], 23, 59, 59)


def year(text: str) -> tuple[datetime, datetime]:
    if not re.fullmatch(r"\d{4}", text) or not 1900 <= int(text) <= 2100:
        raise ValueError(f"not a year: {text!r}")
    return datetime(int(text), 1, 1), datetime(int(text), 12, 31, 23, 59, 59)


def time_range(name: str) -> tuple[datetime, datetime] | None:
    """The day, month or year that a table's suffix names; None where it names none."""
    if m := re.search(r"_?(\d{8})$", name):
        try:
            day = datetime.strptime(m[1], "%Y%m%d")
        except ValueError:
            return None
        return day, day + timedelta(days=1) - timedelta(seconds=1)
    for pattern, parse in ((r"_?(\d{6})$", year_month), (r"_(\d{4})$", year)):
        if m := re.search(pattern, name):
            try:
                return parse(m[1])
            except ValueError:
                return None
    return None


def overlaps(a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> bool:
    """Ranges that share an instant, their ends among them."""
    return not (a[1] < b[0] or a[0] > b[1])


def prune(names: list[str], wanted: tuple[datetime, datetime] | None) -> list[str]:
    """Tables whose range meets the wanted one, and those without a range; if none is left, the first (its rows are filtered anyway)."""
    if wanted is None:
        return list(names)
    left = [n for n in names if (r := time_range(n)) is None or overlaps(r, wanted)]
    return left or list(names[:1])


def matching(names: Iterable[str], pattern: str) -> list[str]:
    """Names in which the pattern is found anywhere."""
    return [n for n in names if re.search(pattern, n)]


def file_name(pattern: str, table: str, as_of: datetime) -> str:
    """An export's file name: anchors dropped, yesterday's date and the table filled in, the table put first where it is missing."""
    from tidewater.functions.clock import fill_date

    name = fill_date(pattern.removeprefix("^").removesuffix("$"), as_of.date() - timedelta(days=1))
    name = name.replace("{table}", table).replace("{TABLE}", table)
    return name if table in name else f"{table}_{name}"


def partition_day(name: Column) -> Column:
    """The first day of a table's range, for pruning as a column: the suffix as a date, null where there is none."""
    digits = F.regexp_extract(name, "_?(\\d{4,8})$", 1)
    return F.coalesce(F.try_to_date(digits, "yyyyMMdd"), F.try_to_date(F.concat(digits, F.lit("01")), "yyyyMMdd"), F.try_to_date(F.concat(digits, F.lit("0101")), "yyyyMMdd"))


def lsn(text: str) -> int:
    """A log position HI/LO in hexadecimal as one number."""
    high, slash, low = text.partition("/")
    if not slash or not high or not low:
        raise ValueError(f"not a log position: {text!r}")
    return (int(high, 16) << 32) + int(low, 16)


def lsn_column(text: Column) -> Column:
    """The same as DECIMAL(20, 0); null where the form is wrong."""
    part = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("decimal(20,0)")
    value = (part(1) * F.lit(1 << 32).cast("decimal(10,0)") + part(2)).cast("decimal(20,0)")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), value)


def dsn(kind: str, user: str, password: str, host: str, port: int | str, database: str) -> str:
    """A connection string in the usual form of the engine."""
    u, p = quote(user, safe=""), quote(password, safe="")
    return {
        "mysql": f"{user}:{password}@tcp({host}:{port})/{database}", "mariadb": f"{user}:{password}@tcp({host}:{port})/{database}",
        "postgresql": f"postgres://{u}:{p}@{host}:{port}/{database}", "mongodb": f"mongodb://{u}:{p}@{host}:{port}/{database}",
        "redis": f"redis://:{p}@{host}:{port}/{database}",
    }[kind]


def dsn_parts(text: str) -> dict[str, str]:
    """User, password, host, port and database of a connection string of either form; what is missing is empty."""
    if m := re.fullmatch(r"(?:([^:@/]*)(?::(.*))?@)?tcp\(([^:)]*)(?::(\d+))?\)/([^?]*)(?:\?.*)?", text):
        return dict(zip(("user", "password", "host", "port", "database"), (x or "" for x in m.groups()), strict=True))
    u = urlsplit(text)
    return {"user": unquote(u.username or ""), "password": unquote(u.password or ""), "host": u.hostname or "", "port": str(u.port or ""), "database": u.path.lstrip("/").partition("?")[0]}


def database_of(text: str) -> str:
    return dsn_parts(text)["database"]


def hide_credentials(text: Column | str) -> Column | str:
    """Passwords in connection strings and -p options of a command, hidden for logs."""
    if isinstance(text, str):
        return re.sub(r"(^|\s)-p\S+", r"\1-p***", re.sub(r"://[^/@\s]*:[^@\s]*@", "://***:***@", text))
    return F.regexp_replace(F.regexp_replace(text, "://[^/@\\s]*:[^@\\s]*@", "://***:***@"), "(^|\\s)-p\\S+", "$1-p***")


def unescape_tsv(text: Column) -> Column:
    """The escapes of a database client's tab-separated output; \\N is null."""
    marked = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\0", "\u0000")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.when(text != "\\N", F.replace(marked, F.lit("\u0001"), F.lit("\\")))


def clean_quotes(value: object) -> object:
    """Conditions without one pair of double, then of single quotes, in nested values too."""
    if isinstance(value, dict):
        return {k: clean_quotes(v) for k, v in value.items()}
    if isinstance(value, list):
        return [clean_quotes(v) for v in value]
    if isinstance(value, str):
        for q in "\"'":
            if len(value) >= 2 and value[0] == value[-1] == q:
                value = value[1:-1]
    return value
