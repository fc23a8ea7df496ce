"""Task, mapping and export settings, checked when they are read."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

SECURITY_TYPES = ("masked", "encrypted")


@dataclass(frozen=True)
class PiiRule:
    """How one field is protected; a dotted field reaches into structs of any depth."""

    field: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in SECURITY_TYPES:
            raise ValueError(f"unknown security type {self.kind!r} for field {self.field!r}; known: {', '.join(SECURITY_TYPES)}")


@dataclass(frozen=True)
class CountCondition:
    """One predicate of a conditional count; `table` limits it to that table."""

    field: str
    operator: str
    value: str
    table: str = ""


@dataclass(frozen=True)
class TableMapping:
    source: str
    target: str
    keys: tuple[str, ...] = ()
    pii: tuple[PiiRule, ...] = ()
    conditions: tuple[CountCondition, ...] = ()
    ignore_deletes: bool = False
    sync_indexes: bool = False

    def __post_init__(self) -> None:
        hidden = {r.field for r in self.pii} & set(self.keys)
        if hidden:
            raise ValueError(f"fields of the merge key cannot be masked or encrypted: {', '.join(sorted(hidden))}")


@dataclass(frozen=True)
class Task:
    id: int
    kind: str
    name: str = ""
    enabled: bool = True
    secured: bool = False
    retry_delay_s: float = 5.0
    mappings: tuple[TableMapping, ...] = ()

    def mapping_of(self, table: str) -> TableMapping | None:
        """The first mapping whose source is the table; events of unmapped tables are dropped."""
        return next((m for m in self.mappings if m.source == table), None)

    def rules_of(self, table: str) -> tuple[PiiRule, ...]:
        """Rules of the first mapping that names the table as source or target, if the task is secured at all."""
        if not self.secured:
            return ()
        return next((m.pii for m in self.mappings if table in (m.source, m.target)), ())


def seconds(value: str | float | None, default: float = 5.0) -> float:
    """A delay given as seconds or as text such as 500ms, 5s, 2m, 1h."""
    if value is None or value == "":
        return default
    if isinstance(value, (int, float)):
        return float(value)
    for unit, factor in (("ms", 0.001), ("s", 1.0), ("m", 60.0), ("h", 3600.0)):
        if value.endswith(unit):
            return float(value[: -len(unit)]) * factor
    return float(value)


def _rules(items: list[dict[str, Any]]) -> tuple[PiiRule, ...]:
    """Entries without a field or type are left out; of several rules for a field the first holds."""
    found: dict[str, PiiRule] = {}
    for x in items:
        if x.get("field") and x.get("securityType"):
            found.setdefault(x["field"], PiiRule(x["field"], x["securityType"]))
    return tuple(found.values())


def task_from_json(task_id: int, text: str, enabled: bool = True) -> Task:
    """A task from its stored JSON; mappings of all databases in one list, the security switch from the task alone."""
    raw = json.loads(text)
    mappings = []
    for database in raw.get("mappings") or []:
        for t in database.get("tables") or []:
            extra = t.get("advancedSettings") or {}
            conditions = (t.get("countQuery") or {}).get("conditions") or []
            mappings.append(
                TableMapping(
                    t["sourceTable"], t.get("targetTable") or t["sourceTable"], tuple(t.get("keys") or ()), _rules(t.get("fieldSecurity") or []),
                    tuple(CountCondition(c.get("field", ""), c.get("operator", ""), str(c.get("value", "")), c.get("table", "")) for c in conditions),
                    bool(extra.get("ignoreDeleteOps")), bool(extra.get("syncIndexes")),
                )
            )
    return Task(task_id, raw.get("type", ""), raw.get("taskName", ""), enabled, bool(raw.get("securityEnabled")), seconds(raw.get("retryDelay")), tuple(mappings))


def tasks_from_rows(rows: Iterable[Mapping[str, Any]]) -> tuple[list[Task], dict[int, str]]:
    """Tasks by id from rows of id, enable and config_json; and why the settings of others could not be read. Empty settings are a task without mappings."""
    tasks, errors = [], {}
    for r in sorted(rows, key=lambda r: r["id"]):
        try:
            tasks.append(task_from_json(r["id"], r["config_json"] or "{}", bool(r["enable"])))
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            errors[r["id"]] = f"{type(error).__name__}: {error}"
    return tasks, errors


@dataclass(frozen=True)
class Settings:
    """What holds for all tasks."""

    monitor_rows: bool = False
    log_level: str = "info"
    monitor_interval_s: float = 60.0
    webhook: str = ""
    channel: str = ""


def settings_from_rows(rows: Iterable[Mapping[str, Any]]) -> Settings:
    """The settings of the row of id 1; texts without value are empty."""
    found = next((r for r in rows if r["id"] == 1), None)
    if found is None:
        raise ValueError("there is no row of id 1")
    return Settings(bool(found["monitor_rows"]), found["log_level"], float(found["monitor_interval"]), found["webhook"] or "", found["channel"] or "")


@dataclass(frozen=True)
class BackupSpec:
    """An export: tables or name patterns, conditions and fields by table, format and target folder."""

    tables: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    query: dict[str, dict[str, Any]] = field(default_factory=dict)
    fields: dict[str, list[str]] = field(default_factory=dict)
    format: str = "json"
    compression: str = "gzip"

    def __post_init__(self) -> None:
        if self.format not in ("json", "csv", "sql"):
            raise ValueError(f"unknown export format {self.format!r}")
