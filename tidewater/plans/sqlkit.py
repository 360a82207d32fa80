"""Small DuckDB-SQL snippets shared by the oracle strings.

These restate the *expected* semantics in plain SQL over relational columns; they
never see the rendered documents."""

from __future__ import annotations


def strip(x: str) -> str:
    """Python str.strip()."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def truthy(x: str) -> str:
    return f"nullif({x}, '')"


def first_truthy(*xs: str, default: str | None = None) -> str:
    parts = [truthy(x) for x in xs]
    if default is not None:
        parts.append(default)
    return "coalesce(" + ", ".join(parts) + ")"


def map_domain(x: str) -> str:
    s = strip(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown_domain' "
            f"WHEN lower({s}) = 'tech' THEN 'technology' "
            f"WHEN lower({s}) IN ('sale', 'sales') THEN 'sales' ELSE {s} END")


def clean_nb_path(x: str) -> str:
    """F01 restated: //repo/rest -> rest, append .py, empty -> null."""
    stripped = (f"CASE WHEN starts_with({x}, '//') AND len(string_split({x}, '/')) > 3 "
                f"THEN array_to_string(string_split({x}, '/')[4:], '/') ELSE {x} END")
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"WHEN ends_with({stripped}, '.py') THEN {stripped} ELSE {stripped} || '.py' END")
