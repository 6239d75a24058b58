"""Column expressions over payloads and changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CHANGE_CATEGORIES


def payload_text(payload: Column) -> Column:
    """Binary payload as UTF-8 text; a cast never fails on bad bytes."""
    return payload.cast("string")


def payload_contains(payloads: list[Column], search: str) -> Column:
    """Case-sensitive literal substring in any of the payloads; a null one never matches."""
    found = F.lit(False)
    for payload in payloads:
        found = found | F.coalesce(
            F.contains(payload_text(payload), F.lit(search)), F.lit(False))
    return found


def list_text(values: Column) -> Column:
    """Array as text, ``[a, b]``."""
    return values.cast("string")


def root_keys(payload: Column) -> Column:
    """Root keys of a JSON object, ascending; empty for a null payload or another root."""
    keys = F.json_object_keys(payload_text(payload))
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))


def any_of(values: Column, wanted: list[str]) -> Column:
    """True when the array holds any wanted value; false for a null array."""
    return F.coalesce(
        F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def _type_name(text: str) -> str:
    """SQL for the type name of a JSON text, as the change document reports it."""
    return f"""
        CASE WHEN {text} LIKE '"%' THEN 'str' WHEN {text} LIKE '{{%' THEN 'dict'
             WHEN {text} LIKE '[%' THEN 'list' WHEN {text} IN ('true', 'false') THEN 'bool'
             WHEN {text} = 'null' THEN 'NoneType'
             WHEN {text} RLIKE '[.eEIN]' THEN 'float' ELSE 'int' END"""


_PATH = "trim(BOTH '[]' FROM to_json(array(c.path)))"  # ends at the quotes of the text

# JSON text of one change, by kind
_ENTRIES = {
    "changed": f"""concat({_PATH}, ':{{"new_value":', c.new, ',"old_value":', c.old, '}}')""",
    "type_changed": f"""concat(
        {_PATH}, ':{{"old_type":"', {_type_name('c.old')},
        '","new_type":"', {_type_name('c.new')},
        '","old_value":', c.old, ',"new_value":', c.new, '}}')""",
    "added": _PATH,
    "removed": _PATH,
    "item_added": f"concat({_PATH}, ':', c.new)",
    "item_removed": f"concat({_PATH}, ':', c.old)",
    "repetition_changed": f"""concat(
        {_PATH}, ':{{"old_repeat":', size(c.old_indexes),
        ',"new_repeat":', size(c.new_indexes),
        ',"old_indexes":[', array_join(c.old_indexes, ','),
        '],"new_indexes":[', array_join(c.new_indexes, ','),
        '],"value":', c.old, '}}')""",
}


def change_document(changes: str) -> Column:
    """Change document as JSON by category; ``{}`` when there is no change. The entries of a kind
    are only looked for in records that have it."""
    parts = []
    for kind, category in CHANGE_CATEGORIES.items():
        opening, closing = ("[", "]") if kind in ("added", "removed") else ("{", "}")
        entries = (f"transform(filter({changes}, c -> c.kind = '{kind}'), "
                   f"c -> {_ENTRIES[kind]})")
        parts.append(
            f"""CASE WHEN array_contains(({changes}).kind, '{kind}') THEN """
            f"""'"{category}":{opening}' || nullif(array_join({entries}, ','), '')"""
            f" || '{closing}' END")
    body = f"array_join(array({', '.join(parts)}), ',')"
    return F.expr(f"CASE WHEN size({changes}) = 0 THEN '{{}}' ELSE '{{' || {body} || '}}' END")
