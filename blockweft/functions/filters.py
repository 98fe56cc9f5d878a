"""The filter language: a JSON expression over a decoded row becomes a postfix program, which is data of its monitor."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .abi import Signature, dynamic, number_key

# Limits of an expression.
MOST_BYTES, MOST_NODES, MOST_DEPTH, ARITY = 16 * 1024, 128, 16, (2, 32)
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte")


class FilterError(ValueError):
    def __init__(self, path: str, message: str) -> None:
        super().__init__(f"{path}: {message}")
        self.path = path


def field_type(signature: Signature, field: str, path: str) -> tuple[str, str]:
    """(column, type) of a field name; row columns are block_number, tx_hash, from_addr, to_addr, address, log_index."""
    both = {"block.number": ("block_number", "long"), "tx.hash": ("tx_hash", "bytes32")}
    own = {"call": {"tx.from": ("from_addr", "address"), "tx.to": ("to_addr", "address")}, "event": {"event.emitter": ("address", "address"), "event.log_index": ("log_index", "long")}}
    if found := both.get(field) or own[signature.kind].get(field):
        return found
    for p in signature.params:
        if field == f"params.{p.name}":
            return p.name, ("bytes32" if p.indexed and dynamic(p.type) else "bytes24" if p.type == "function" else p.type)
    raise FilterError(path, f"unknown field {field!r}")


def literal(kind: str, value: object, path: str) -> tuple[object, object]:
    """(comparable, canonical JSON) of a literal of a type."""
    if kind == "bool":
        if not isinstance(value, bool):
            raise FilterError(path, "expected a boolean")
        return value, value
    if not isinstance(value, str):
        raise FilterError(path, "expected a string")
    if kind == "string":
        return value, value
    if kind == "long" or kind.startswith(("uint", "int")):
        bits = 64 if kind == "long" else int(re.sub(r"\D", "", kind))
        signed = kind.startswith("int")
        if not re.fullmatch(r"-?\d+" if signed else r"\d+", value):
            raise FilterError(path, "expected a decimal string")
        n = int(value)
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        if not low <= n <= high:
            raise FilterError(path, f"out of range for {kind}")
        return n, str(n)
    if not re.fullmatch(r"0x(?:[0-9a-fA-F]{2})*", value):
        raise FilterError(path, "expected 0x and an even number of hex digits")
    size = 20 if kind == "address" else int(kind[5:]) if kind != "bytes" else None
    if size is not None and len(value) != 2 + 2 * size:
        raise FilterError(path, f"expected {size} bytes")
    return bytes.fromhex(value[2:]), value.lower()


#: Columns of a row that a filter may name; a program counts them before the parameters.
ROW_FIELDS = ("block_number", "tx_hash", "from_addr", "to_addr", "address", "log_index")
#: A step of a program: a comparison pushes its outcome, and/or take two, not takes one.
STEP = "struct<op: string, field: int, value: binary>"


def program(expression: dict | None, signature: Signature, path: str = "/filter") -> list[tuple[str, int | None, bytes | None]]:
    """An expression in postfix order: comparisons of a field (by its place among ROW_FIELDS and parameters) with bytes
    that compare as the values do. No filter is no steps."""
    if expression is None:
        return []
    if len(json.dumps(expression, separators=(",", ":")).encode()) > MOST_BYTES:
        raise FilterError(path, "longer than a filter may be")
    nodes = [0]
    places = {name: k for k, name in enumerate((*ROW_FIELDS, *(p.name for p in signature.params)))}

    def walk(e: object, depth: int, at: str) -> list[tuple[str, int | None, bytes | None]]:
        nodes[0] += 1
        if nodes[0] > MOST_NODES or depth > MOST_DEPTH:
            raise FilterError(at, "too many parts" if nodes[0] > MOST_NODES else "nested too deeply")
        if not isinstance(e, dict):
            raise FilterError(at, "not an object")
        if set(e) in ({"and"}, {"or"}):
            key = next(iter(e))
            if not isinstance(e[key], list) or not ARITY[0] <= len(e[key]) <= ARITY[1]:
                raise FilterError(f"{at}/{key}", f"needs from {ARITY[0]} to {ARITY[1]} parts")
            first, *rest = [walk(x, depth + 1, f"{at}/{key}/{k}") for k, x in enumerate(e[key])]
            return first + [step for part in rest for step in (*part, (key, None, None))]
        if set(e) == {"not"}:
            return [*walk(e["not"], depth + 1, f"{at}/not"), ("not", None, None)]
        if set(e) != {"field", "op", "value"}:
            raise FilterError(at, "keys of no known form")
        if e["op"] not in OPERATORS:
            raise FilterError(f"{at}/op", "no such comparison")
        name, kind = field_type(signature, e["field"], f"{at}/field")
        numeric = kind == "long" or kind.startswith(("uint", "int"))
        if e["op"] not in ("eq", "ne") and not numeric:
            raise FilterError(f"{at}/op", f"only integers can be compared by {e['op']}")
        value, _ = literal(kind, e["value"], f"{at}/value")
        key = number_key(value, kind.startswith("int")) if numeric else bytes([value]) if kind == "bool" else value.encode() if kind == "string" else value
        column = places[name] if e["field"].startswith("params.") else ROW_FIELDS.index(name)
        return [(e["op"], column, key)]

    return walk(expression, 1, path)


def row_keys(columns: dict[str, Column], params: Column) -> Column:
    """The keys of a row's fields in the order programs count them; ``params`` has those of the parameters."""
    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 64, "0"))
    own = [F.lit(None).cast("binary") if name not in columns else number(columns[name]) if name in ("block_number", "log_index") else columns[name] for name in ROW_FIELDS]
    return F.concat(F.array(*own), params)


def passes(steps: Column, keys: Column) -> Column:
    """Whether a row passes a program that is data (an array of STEP). A comparison with null is neither true nor false,
    and so may be the whole, which then counts as false; without steps all pass."""

    def compared(t: Column) -> Column:
        left, right, op = F.get(keys, t["field"]), t["value"], t["op"]
        told = F.when(op == "eq", left == right).when(op == "ne", left != right).when(op == "gt", left > right).when(op == "gte", left >= right).when(op == "lt", left < right).when(op == "lte", left <= right)
        return F.struct(op.alias("op"), told.alias("told"))

    def fold(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        last, before = F.get(stack, n - 1), F.get(stack, n - 2)
        return (
            F.when(t["op"] == "and", F.concat(F.slice(stack, F.lit(1), n - 2), F.array(before & last)))
            .when(t["op"] == "or", F.concat(F.slice(stack, F.lit(1), n - 2), F.array(before | last)))
            .when(t["op"] == "not", F.concat(F.slice(stack, F.lit(1), n - 1), F.array(~last)))
            .otherwise(F.concat(stack, F.array(t["told"])))
        )

    folded = F.aggregate(F.transform(steps, compared), F.expr("CAST(array() AS array<boolean>)"), fold, lambda stack: F.get(stack, F.lit(0)))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, F.lit(True)).otherwise(F.coalesce(folded, F.lit(False)))
