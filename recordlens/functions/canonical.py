"""The one Python step: structural changes between two JSON payloads.

Spark has no expression that compares JSON values regardless of array order at every
depth while keeping ``1``, ``1.0``, ``"1"`` and ``true`` apart. This module holds the
per-record helper for that and the Arrow function around it. Everything else in the
package is column expressions.
"""

from __future__ import annotations

import json
import marshal
import sys
from collections import defaultdict
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE_TYPE = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("old", T.StringType()),
    T.StructField("new", T.StringType()),
    T.StructField("old_indexes", T.ArrayType(T.IntegerType())),
    T.StructField("new_indexes", T.ArrayType(T.IntegerType())),
])
DELTA_TYPE = T.StructType([
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("changes", T.ArrayType(CHANGE_TYPE)),
])
_ARROW_CHANGE = [
    pa.field("field", pa.string()), pa.field("path", pa.string()),
    pa.field("kind", pa.string()), pa.field("old", pa.string()), pa.field("new", pa.string()),
    pa.field("old_indexes", pa.list_(pa.int32())),
    pa.field("new_indexes", pa.list_(pa.int32())),
]
#: Unequal items of two arrays are paired up to this product of their numbers; beyond it they
#: are removed and added ones.
MOST_PAIRS = 4096
#: Records of a batch that are Python objects at the same time.
RECORDS_AT_ONCE = 128
_SCALARS = (str, int, float, bool, type(None))
_ATOMS = (str, int, bool, type(None))
_ATOM_SET = frozenset(_ATOMS)

_encode = json.JSONEncoder(
    sort_keys=True, ensure_ascii=False, separators=(",", ":")
).encode


def _utf8(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, go back to their JSON escape."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode("utf-8")


def _text(value) -> str:
    return str(value) if type(value) is int else _utf8(_encode(value))


def _parser():
    """``json.loads``, with less work around an object whose first bytes tell that it is UTF-8."""
    read = json.JSONDecoder().raw_decode

    def parsed(payload):
        if type(payload) is bytes and payload.startswith(b'{"'):
            payload = payload.decode("utf-8", "surrogatepass")
            value, end = read(payload)
            if end == len(payload):
                return value
        return json.loads(payload)

    return parsed


def _plain(value, ignore_order: bool):
    """Value in a form whose JSON text is equal exactly for equal values."""
    if isinstance(value, float):
        return value + 0.0  # -0.0 and 0.0 are one number
    if isinstance(value, dict):
        return {key: _plain(item, ignore_order) for key, item in value.items()}
    if isinstance(value, list):
        items = [_plain(item, ignore_order) for item in value]
        return sorted(items, key=_encode) if ignore_order else items
    return value


def canonical_text(value, ignore_order: bool = True) -> str:
    return _encode(_plain(value, ignore_order))


def _bytes(value) -> bytes:
    return marshal.dumps(value, 2)


def _ordered(value, ignore_order: bool):
    """Value in a form whose serialised bytes are equal exactly for equal values."""
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, dict):
        names = sorted(value)
        if names == list(value) and _ATOM_SET.issuperset(map(type, value.values())):
            return value
        return {key: value[key] if type(value[key]) in _ATOMS else
                _ordered(value[key], ignore_order) for key in names}
    if isinstance(value, list):
        items = [item if type(item) in _ATOMS else _ordered(item, ignore_order)
                 for item in value]
        return sorted(items, key=_bytes) if ignore_order else items
    return value


def _key(value, ignore_order: bool) -> bytes:
    """Equal for the values whose canonical texts are equal, at a fraction of their cost."""
    return _bytes(_ordered(value, ignore_order))


def _differs(old, new, ignore_order: bool) -> bool:
    if type(old) is not type(new):
        return True
    if type(old) in _SCALARS:
        return old != new and not (old != old and new != new)  # NaN equals NaN
    # The usual case, without building texts. Python's own equality takes 1, 1.0 and True for
    # the same value; equal serialised bytes rule that out, unequal ones decide nothing.
    if old == new and _bytes(old) == _bytes(new):
        return False
    return _key(old, ignore_order) != _key(new, ignore_order)


def _same_atom(old: dict, new: dict, key: str) -> bool:
    """Whether a key has the same single value in both, but for numbers with a fraction."""
    a = old.get(key)
    return type(a) in _ATOMS and key in old and key in new and type(new[key]) is type(a) \
        and a == new[key]


def _positions(items: list, known: dict[bytes, bytes]) -> dict[str | bytes, list[int]]:
    """Places of each value. ``known`` keeps the keys of values by the bytes they have as they
    stand, as the other array holds most of them too."""
    found = defaultdict(list)
    for index, item in enumerate(items):
        if type(item) is str:
            found[item].append(index)
            continue
        raw = marshal.dumps(item, 2)
        key = known.get(raw)
        if key is None:
            plain = _ordered(item, True)
            key = known[raw] = raw if plain is item else marshal.dumps(plain, 2)
        found[key].append(index)
    return found


def _child(path: str, key: str) -> str:
    return f'{path}["{key}"]' if "'" in key else f"{path}['{key}']"


# A change is (path, kind, old text, new text, old indexes, new indexes).

def _member_changes(path: str, key: str, old: dict, new: dict, ignore_order: bool,
                    pair_limit: float):
    """Changes of one key that is not the same in two objects; none if it is."""
    if key not in new:
        yield _child(path, key), "removed", _text(old[key]), None, None, None
    elif key not in old:
        yield _child(path, key), "added", None, _text(new[key]), None, None
    elif ignore_order and type(old[key]) is type(new[key]) is list:
        # equal multisets have no changes
        yield from _multiset_changes(_child(path, key), old[key], new[key], pair_limit)
    elif _differs(old[key], new[key], ignore_order):
        yield from _changes(_child(path, key), old[key], new[key], ignore_order, pair_limit)


def _changes(path: str, old, new, ignore_order: bool, pair_limit: float = 0.0):
    """Changes between two unequal values."""
    if type(old) is not type(new):
        yield path, "type_changed", _text(old), _text(new), None, None
    elif isinstance(old, dict):
        for key in sorted(old.keys() | new.keys()):
            if not _same_atom(old, new, key):
                yield from _member_changes(path, key, old, new, ignore_order, pair_limit)
    elif isinstance(old, list) and ignore_order:
        yield from _multiset_changes(path, old, new, pair_limit)
    elif isinstance(old, list):
        for i in range(max(len(old), len(new))):
            child = f"{path}[{i}]"
            if i >= len(new):
                yield child, "item_removed", _text(old[i]), None, [i], None
            elif i >= len(old):
                yield child, "item_added", None, _text(new[i]), None, [i]
            elif _differs(old[i], new[i], False):
                yield from _changes(child, old[i], new[i], False)
    else:
        yield path, "changed", _text(old), _text(new), None, None


def _size(value) -> int:
    """Number of single values in a value; an empty object or array is one."""
    if isinstance(value, dict):
        if _ATOM_SET.issuperset(map(type, value.values())):
            return len(value) or 1
        return sum(map(_size, value.values())) or 1
    return sum(map(_size, value)) or 1 if isinstance(value, list) else 1


def _common(old, new) -> int:
    """Number of single values at the same place, or for arrays anywhere, in both."""
    if type(old) is not type(new):
        return 0
    if isinstance(old, dict):
        common = 0
        for key, value in old.items():
            if key in new:
                other = new[key]
                if type(value) in _ATOMS:
                    common += type(value) is type(other) and value == other
                else:
                    common += _common(value, other)
        return common or int(not old and not new)
    if isinstance(old, list):
        known = {}
        after = {text: len(at) for text, at in _positions(new, known).items()}
        return sum(_size(old[at[0]]) * min(len(at), after.get(text, 0))
                   for text, at in _positions(old, known).items()) or int(not old and not new)
    return int(not _differs(old, new, True))


def _distances(left: list, right: list) -> list[list[float]]:
    sizes = [_size(new) for new in right]
    return [[1 - 2 * _common(old, new) / (size + other) for new, other in zip(right, sizes)]
            for old, size in zip(left, map(_size, left))]


def distance(old, new) -> float:
    """0 for equal values, 1 for such that share nothing: the part of both that differs."""
    return _distances([old], [new])[0][0]


def least_cost_pairs(cost: list[list[float]], limit: float) -> list[tuple[int, int]]:
    """Row and column pairs below ``limit`` with the least sum of their costs, where a row and a
    column that stay alone cost half the limit each. Rows join one by one, each along a
    cheapest augmenting path; equal costs go to the first column."""
    near = [(i, j) for i, row in enumerate(cost) for j, c in enumerate(row) if c < limit]
    if len({i for i, _ in near}) == len(near) == len({j for _, j in near}):
        return near  # no row and no column has a choice
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    # a row's own last column stands for staying alone
    gain = [[min(c - limit, 0.0) for c in row] + [0.0] * n for row in cost]
    by_row, by_column, match = [0.0] * n, [0.0] * (m + n), [-1] * (m + n)
    for row in range(n):
        best, came, seen = [inf] * (m + n), [-1] * (m + n), [False] * (m + n)
        here, at = row, -1
        while True:
            if at >= 0:
                seen[at] = True
                here = match[at]
            step, nearest = inf, -1
            for j in range(m + n):
                if not seen[j]:
                    reduced = gain[here][j] - by_row[here] - by_column[j]
                    if reduced < best[j]:
                        best[j], came[j] = reduced, at
                    if best[j] < step:
                        step, nearest = best[j], j
            by_row[row] += step
            for j in range(m + n):
                if seen[j]:
                    by_row[match[j]] += step
                    by_column[j] -= step
                else:
                    best[j] -= step
            at = nearest
            if match[at] < 0:
                break
        while at >= 0:
            match[at] = match[came[at]] if came[at] >= 0 else row
            at = came[at]
    return sorted((match[j], j) for j in range(m) if match[j] >= 0 and cost[match[j]][j] < limit)


def _similar(old: list, new: list, gone: list[int], added: list[int],
             limit: float) -> dict[int, int]:
    """Places of edited items: objects with objects, arrays with arrays."""
    pairs = {}
    for kind in (dict, list):
        left = [i for i in gone if isinstance(old[i], kind)] if limit > 0 else []
        right = [j for j in added if isinstance(new[j], kind)]
        if left and right and len(left) * len(right) <= MOST_PAIRS:
            cost = _distances([old[i] for i in left], [new[j] for j in right])
            pairs.update((left[i], right[j]) for i, j in least_cost_pairs(cost, limit))
    return pairs


def _multiset_changes(path: str, old: list, new: list, pair_limit: float = 0.0):
    if old == new and _bytes(old) == _bytes(new):
        return
    known = {}
    before, after = _positions(old, known), _positions(new, known)
    gone = [i for text, indexes in before.items() if text not in after for i in indexes]
    added = [j for text, indexes in after.items() if text not in before for j in indexes]
    pairs = _similar(old, new, gone, added, pair_limit)
    for text, indexes in before.items():
        others = after.get(text)
        if others is None:
            for i in indexes:
                if i in pairs:
                    yield from _changes(f"{path}[{i}]", old[i], new[pairs[i]], True, pair_limit)
                else:
                    yield f"{path}[{i}]", "item_removed", _text(old[i]), None, [i], None
        elif len(others) != len(indexes):
            first = indexes[0]
            yield (f"{path}[{first}]", "repetition_changed", _text(old[first]),
                   _text(new[others[0]]), indexes, others)
    paired = set(pairs.values())
    for i in added:
        if i not in paired:
            yield f"{path}[{i}]", "item_added", None, _text(new[i]), None, [i]


def record_delta(old, new, ignore_order: bool = True, root_overlap_threshold: float = 0.0,
                 pair_limit: float = 0.0):
    """Changed root fields and changes (root field first) of one record.

    None if the record did not change. Items of arrays that compare as multisets are paired if
    they differ in less than ``pair_limit``, and then their own changes are told.
    """
    if not (isinstance(old, dict) and isinstance(new, dict)):
        if not _differs(old, new, ignore_order):
            return None
        keys = sorted(key for side in (old, new) if isinstance(side, dict) for key in side)
        return keys, [(None, *change) for change in _changes(
            "root", old, new, ignore_order, pair_limit)]
    keys = sorted(old.keys() | new.keys())
    if keys and len(old.keys() & new.keys()) / len(keys) < root_overlap_threshold:
        return keys, [(None, "root", "changed", _text(old), _text(new), None, None)]
    changes = []
    for key in keys:
        if key in old and key in new and type(old[key]) is type(new[key]) in _SCALARS:
            a, b = old[key], new[key]  # the usual case of flat records
            if a != b and (a == a or b == b):
                changes.append((key, _child("root", key), "changed", _text(a), _text(b), None, None))
        else:
            changes.extend((key, *change) for change in _member_changes(
                "root", key, old, new, ignore_order, pair_limit))
    return (list(dict.fromkeys(c[0] for c in changes)), changes) if changes else None


def _offsets(groups) -> pa.Array:
    return pa.array([0, *accumulate(map(len, groups))], pa.int32())


def _strings(texts: list) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:
        return pa.array([text if text is None else _utf8(text) for text in texts], pa.string())


def _delta_array(deltas: list) -> pa.Array:
    """Arrow array of ``record_delta`` results, built column by column."""
    fields = [d[0] if d else () for d in deltas]
    groups = [d[1] if d else () for d in deltas]
    columns = zip(*chain.from_iterable(groups)) if any(groups) else [()] * len(_ARROW_CHANGE)
    names, paths, *others = map(list, columns)
    changes = pa.StructArray.from_arrays(
        [_strings(names), _strings(paths), *[pa.array(values, field.type) for values, field in zip(
            others, _ARROW_CHANGE[2:])]],
        fields=_ARROW_CHANGE)
    flat = _strings(list(chain.from_iterable(fields)))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(_offsets(fields), flat),
         pa.ListArray.from_arrays(_offsets(groups), changes)],
        names=["fields", "changes"], mask=pa.array([d is None for d in deltas], pa.bool_()))


def record_deltas(
    a: Column, b: Column, ignore_order: bool = True, root_overlap_threshold: float = 0.0,
    pair_limit: float = 0.0,
) -> Column:
    """Arrow-batched ``record_delta``. Null on either side gives null, without parsing."""

    @F.arrow_udf(DELTA_TYPE)
    def deltas(left: pa.Array, right: pa.Array) -> pa.Array:
        parsed, parts = _parser(), []
        for at in range(0, len(left), RECORDS_AT_ONCE):
            sides = (side.slice(at, RECORDS_AT_ONCE).to_pylist() for side in (left, right))
            parts.append(_delta_array([
                None if old is None or new is None else
                record_delta(parsed(old), parsed(new), ignore_order, root_overlap_threshold,
                             pair_limit)
                for old, new in zip(*sides)]))
        found = pa.concat_arrays(parts) if parts else _delta_array([])
        del parts
        pa.default_memory_pool().release_unused()
        return found

    return deltas(a, b)


def root_sorted(payload: Column) -> Column:
    """JSON text of a record with its root keys in ascending order."""

    @F.arrow_udf(T.StringType())
    def sort_roots(records: pa.Array) -> pa.Array:
        out = []
        for record in records.to_pylist():
            value = None if record is None else json.loads(record)
            if isinstance(value, dict):
                value = {key: value[key] for key in sorted(value)}
            out.append(None if record is None else _utf8(json.dumps(value, ensure_ascii=False)))
        return pa.array(out, type=pa.string())

    return sort_roots(payload)
