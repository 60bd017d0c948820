"""The function library.

Every function is a SQL template over Catalyst built-ins, by name and number of
arguments, so that calls stay inside whole-stage code generation and keep the
types of their arguments.  ``$1``, ``$2`` ... stand for the arguments.  The SQL
dialect expands the same templates that :func:`call` offers to DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelorus.functions import arrays, datetimes, decimals, fts, jsons, maths, strings, system

#: name -> number of arguments -> template; -1 takes any number, joined in ``$*``.
TEMPLATES: dict[str, dict[int, str]] = {}
for _module in (strings, maths, decimals, datetimes, arrays, jsons, fts, system):
    for _name, _forms in _module.TEMPLATES.items():
        TEMPLATES.setdefault(_name, {}).update(_forms)


def expand(name: str, args: list[str]) -> str | None:
    """The call as Spark SQL, or None where Spark's own function of that name serves."""
    forms = TEMPLATES.get(name.lower(), {})
    template = forms.get(len(args), forms.get(-1))
    if template is None:
        return None
    text = re.sub(r"\$(\d+|\*)", lambda m: ", ".join(args) if m[1] == "*" else f"{args[int(m[1]) - 1]}", template)
    return f"({text})"


def call(name: str, *args: str | int | float) -> Column:
    """A function applied to column names, SQL expressions (text) or numbers."""
    shown = [str(a) for a in args]
    return F.expr(expand(name, shown) or f"{name}({', '.join(shown)})")
