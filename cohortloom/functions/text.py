"""Names, descriptions and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(share: Column, signed: bool = False) -> Column:
    """A share as text with one decimal, as 12.3%, or +12.3%."""
    return F.format_string("%+.1f%%" if signed else "%.1f%%", share * 100)


def share(value: float) -> float:
    """A parameter given as a percentage or a fraction, as a fraction."""
    return value / 100 if value >= 1 else value


def described(node: Column, names: dict[str, str], prefix: str = "CCSR_") -> Column:
    """A node in words: its description, or its code without one; recurrence and absence are told. Bundles are two codes with the prefix."""
    table = F.create_map(*(F.lit(x) for kv in (names or {"": ""}).items() for x in kv))
    word = lambda code: F.coalesce(F.try_element_at(table, code), code)
    plain = F.regexp_replace(F.regexp_replace(node, r"_\[NODE_\d+_DOSE\]", ""), "^NOT_", "")
    code = F.regexp_replace(plain, f"^{prefix}", "")
    base = F.regexp_replace(code, r"_R\d*$", "")
    text = F.concat(word(base), F.when(code != base, " (Recurrence)").otherwise(""))
    pair = F.split(F.regexp_replace(plain, f"^BUNDLE_{prefix}", ""), f"_{prefix}")
    both = F.concat(F.lit("Concurrent ["), word(pair[0]), F.lit(" & "), word(F.get(pair, F.lit(1))), F.lit("]"))
    known = F.when(node.startswith("NOT_"), F.concat(F.lit("Absence of "), text)).otherwise(text)
    return F.when(plain.startswith("BUNDLE_"), both).when(plain.startswith(prefix), known).otherwise(node)


def narrative(nodes: Column, names: dict[str, str], prefix: str = "CCSR_") -> Column:
    """A sequence in words."""
    return F.array_join(F.transform(nodes, lambda n: described(n, names, prefix)), "  --->  ")


def thousands(number: Column) -> Column:
    """A whole number with separators, as 1,234."""
    return F.format_number(number, 0)


def escalation(first: Column, then: Column, outcome: str, before: Column, after: Column, between: Column | None = None) -> Column:
    """How the risk of an outcome grows from the first node of a sequence to all of them: `between` tells the nodes in the middle, if any."""
    start = F.concat(first, F.lit(f": {outcome} risk "), percent(before), F.lit(". "))
    middle = F.lit("") if between is None else F.coalesce(F.concat(F.lit("After "), between, F.lit(", ")), F.lit(""))
    return F.concat(start, middle, F.lit("with "), then, F.lit(", the risk is "), percent(after), F.lit(" ("), percent(after - before, True), F.lit(")."))
