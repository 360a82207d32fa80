"""Column-expression helpers.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  The helpers encode the two kinds of default
the source artifacts use and must never be mixed:

* ``truthy`` / ``first_truthy`` — Python ``a or b``: null *and* empty skip;
* ``key_or_default`` — ``dict.get(k, d)``: only an *absent* key takes the default,
  an explicit null survives (and renders as ``None`` in text forms).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace (Spark
    ``trim`` only removes spaces).  ``btrim`` with the whitespace set is a
    character scan, much cheaper than a regular expression."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def truthy(c: Column | str) -> Column:
    """A string value that Python treats as true: null and ``''`` become null."""
    return F.nullif(col_(c), F.lit(""))


def first_truthy(*cols: Column | str, default: str | Column | None = None) -> Column:
    """``a or b or ... or default`` over strings."""
    parts = [truthy(c) for c in cols]
    if default is not None:
        parts.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*parts)


def key_or_default(m: Column | str, key: str, default: str) -> Column:
    """``d.get(key, default)`` rendered as text: absent -> default, present null -> 'None'."""
    m = col_(m)
    return (
        F.when(m.isNull() | ~F.map_contains_key(m, F.lit(key)), F.lit(default))
        .otherwise(F.coalesce(m[key], F.lit("None")))
    )


# ---------------------------------------------------------------------------
# Fixed values that must equal the source behaviour.
# Domain aliases (lower-cased key -> canonical domain):
#   tech -> technology, sale -> sales, sales -> sales
DOMAIN_ALIASES = {"tech": "technology", "sale": "sales", "sales": "sales"}
# Default for an unknown / empty domain: unknown_domain
# ---------------------------------------------------------------------------


def map_domain(c: Column | str) -> Column:
    """trim, case-insensitive alias lookup, else the trimmed value; null/'' ->
    ``unknown_domain``.  A whitespace-only value strips to ``''`` and stays ``''``."""
    c = col_(c)
    cleaned = pystrip(c)
    alias = F.lit(None).cast("string")
    for key, value in DOMAIN_ALIASES.items():
        alias = F.when(F.lower(cleaned) == key, F.lit(value)).otherwise(alias)
    return F.when(truthy(c).isNull(), F.lit("unknown_domain")).otherwise(
        F.coalesce(alias, cleaned)
    )


# //<repo>/ prefix (text up to the third slash), the rest, and an optional .py
_NB_PATH = r"(?s)^(?://[^/]*/)?(.*?)(?:\.py)?$"


def clean_notebook_path(c: Column | str) -> Column:
    """``//repo/a/b`` -> ``a/b.py``; append ``.py`` when absent; null/'' -> null;
    ``//repo`` (no path part) -> ``//repo.py``.

    One regular-expression rewrite (``str.split('/', 3)[3]`` is the text after
    the third slash, then ``.py`` is normalised); the input is referenced only
    twice because map lookups are re-inlined at every use."""
    c = col_(c)
    return F.when(truthy(c).isNotNull(), F.regexp_replace(c, _NB_PATH, "$1.py"))


def layer_from_name(c: Column | str) -> Column:
    """brz / slv / gld detected in a table or pipeline name (first hit), else null."""
    return F.nullif(F.regexp_extract(F.lower(col_(c)), r"(brz|slv|gld)", 1), F.lit(""))


def framework_from_env(c: Column | str) -> Column:
    """brz/slv -> hopsflow, gld -> brewtiful, else unknown."""
    c = col_(c)
    return (
        F.when(c.isin("brz", "slv"), F.lit("hopsflow"))
        .when(c == "gld", F.lit("brewtiful"))
        .otherwise(F.lit("unknown"))
    )


def normalize_path(c: Column | str) -> Column:
    """strip whitespace, then surrounding backticks/quotes; ``//x`` -> ``/x``."""
    p = F.regexp_replace(pystrip(col_(c)), r"^[`'\"]+|[`'\"]+$", "")
    return F.when(p.startswith("//"), F.substring(p, 2, 1 << 30)).otherwise(p)


def file_type(c: Column | str) -> Column:
    """yaml / py / ipynb / unknown by (case-insensitive) extension."""
    low = F.lower(col_(c))
    return (
        F.when(low.endswith(".yaml") | low.endswith(".yml"), F.lit("yaml"))
        .when(low.endswith(".py"), F.lit("py"))
        .when(low.endswith(".ipynb"), F.lit("ipynb"))
        .otherwise(F.lit("unknown"))
    )


def field_after_last_colon(line: Column | str) -> Column:
    """text after the last colon, stripped; empty -> null; no colon -> null."""
    line = col_(line)
    return F.when(
        F.instr(line, ":") > 0, truthy(pystrip(F.substring_index(line, ":", -1)))
    )


def text_after_first_colon(line: Column | str) -> Column:
    """F20 helper: text after the first colon, stripped; empty -> null."""
    line = col_(line)
    pos = F.instr(line, ":")
    return F.when(pos > 0, truthy(pystrip(F.substr(line, pos + F.lit(1)))))


def combine_output(out: Column | str, err: Column | str) -> Column:
    """F16: ``stdout + '\\n' + stderr`` when both are non-empty, else whichever is."""
    out, err = col_(out), col_(err)
    return F.coalesce(F.concat_ws("\n", truthy(out), truthy(err)), F.lit(""))
