"""Routing patterns as regular expressions, and which messages a consumer group receives."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_META = set("\\.+*?()|[]{}^$")


def _quote(text: str) -> str:
    return "".join(f"[{c}]" if c in _META - set("\\^[]") else "\\" + c if c in _META else c for c in text)


def wildcard(pattern: str) -> str:
    """``*`` stands for any characters, dots too; everything else for itself. The whole key must match: (?s) and \\z, as ``$`` would allow a trailing line feed."""
    return "(?s)^" + ".*".join(map(_quote, pattern.split("*"))) + "\\z"


def segments(pattern: str) -> str:
    """``*`` stands for one segment between dots, a last ``>`` for one or more. Empty segments, and ``>`` elsewhere, are refused."""
    parts = pattern.split(".")
    if any(p == "" for p in parts) or ">" in parts[:-1]:
        raise ValueError(f"not a routing pattern: {pattern!r}")
    return "(?s)^" + "[.]".join({"*": "[^.]+", ">": ".+"}.get(p) or _quote(p) for p in parts) + "\\z"


def any_of(key: Column, patterns: list[str]) -> Column:
    """Whether a key matches one of the regular expressions, in a single scan-side test without a join; a null key matches none."""
    return F.coalesce(key.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(True)


def routed(log: DataFrame, bindings: dict[int, list[str]], group_id: int) -> DataFrame:
    """The messages that a group receives: all without bindings, else those whose key matches one of them."""
    return log.where(any_of(F.col("routing_key"), bindings.get(group_id, [])))


def by_group(log: DataFrame, groups: list[int], bindings: dict[int, list[str]]) -> DataFrame:
    """``log`` with a row for each group that receives the message. The groups are literals: one pass, no join."""
    hit = F.array_compact(F.array(*[F.when(any_of(F.col("routing_key"), bindings.get(g, [])), F.lit(g).cast("long")) for g in groups]))
    return log.withColumn("group_id", F.explode(hit))


def header_contains(headers: Column, wanted: dict[str, Any]) -> Column:
    """Whether a JSON object contains all of the wanted entries, with their types: objects by their entries, all the way down; strings, numbers, booleans and null by value; of lists, each wanted scalar among the elements (compared as text). An empty wish is refused."""
    if not wanted:
        raise ValueError("an empty header pattern would match everything")
    return F.coalesce(_contains(F.try_parse_json(headers), "$", wanted), F.lit(False))


def _contains(json: Column, path: str, wanted: Any) -> Column:
    there = F.schema_of_variant(F.try_variant_get(json, path, "variant"))
    if isinstance(wanted, dict):
        out = F.coalesce(there.startswith("OBJECT"), F.lit(False))
        for k, v in wanted.items():
            quote = '"' if "'" in k else "'"
            if quote in k:
                raise ValueError(f"a header name with both kinds of quotes: {k!r}")
            out = out & _contains(json, f"{path}[{quote}{k}{quote}]", v)
        return out
    if wanted is None:
        hit = there == "VOID"
    elif isinstance(wanted, list):
        hit = F.lit(True)
        for x in wanted:
            hit = hit & F.array_contains(F.try_variant_get(json, path, "array<string>"), str(x).lower() if isinstance(x, bool) else str(x))
    elif isinstance(wanted, bool):
        hit = (there == "BOOLEAN") & (F.try_variant_get(json, path, "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        hit = ~there.isin("STRING", "BOOLEAN", "VOID") & (F.try_variant_get(json, path, "double") == float(wanted))
    else:
        hit = (there == "STRING") & (F.try_variant_get(json, path, "string") == wanted)
    return F.coalesce(hit, F.lit(False))
