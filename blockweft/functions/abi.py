"""ABI signatures, and decoders and encoders made of native Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The round constants' generator taps and rotation offsets follow the published Keccak rules.
MASK = (1 << 64) - 1


def _rotated(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & MASK if n else x


def _round_constants() -> list[int]:
    out, lfsr = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if lfsr & 1:
                value |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        out.append(value)
    return out


_CONSTANTS = _round_constants()


@lru_cache(maxsize=10_000)
def keccak256(data: bytes) -> bytes:
    """Keccak-256 of a signature text; used at definition time, never on rows."""
    rate, state = 136, [0] * 25
    padded = bytearray(data) + b"\x01"
    padded += bytes(-len(padded) % rate)
    padded[-1] |= 0x80
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            state[k] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        for constant in _CONSTANTS:
            parity = [state[x] ^ state[x + 5] ^ state[x + 10] ^ state[x + 15] ^ state[x + 20] for x in range(5)]
            state = [lane ^ parity[(k % 5 - 1) % 5] ^ _rotated(parity[(k % 5 + 1) % 5], 1) for k, lane in enumerate(state)]
            x, y, moved = 1, 0, [0] * 25
            moved[0] = state[0]
            for t in range(24):
                moved[y + 5 * ((2 * x + 3 * y) % 5)] = _rotated(state[x + 5 * y], (t + 1) * (t + 2) // 2 % 64)
                x, y = y, (2 * x + 3 * y) % 5
            state = [moved[k] ^ (~moved[k - k % 5 + (k + 1) % 5] & MASK & moved[k - k % 5 + (k + 2) % 5]) for k in range(25)]
            state[0] ^= constant
    return b"".join(lane.to_bytes(8, "little") for lane in state[:4])


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    indexed: bool = False


@dataclass(frozen=True)
class Signature:
    kind: str  # call or event
    name: str
    params: tuple[Param, ...]

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(p.type for p in self.params)})"

    @property
    def hash(self) -> bytes:
        full = keccak256(self.canonical.encode())
        return full[:4] if self.kind == "call" else full

    @property
    def layout(self) -> str:
        """What decoding depends on: types in order, with indexed flags. Names don't count."""
        return self.kind + ":" + ",".join(p.type + ("*" if p.indexed else "") for p in self.params)


def canonical_type(text: str) -> str:
    text = {"uint": "uint256", "int": "int256", "address payable": "address"}.get(text, text)
    if text in ("bool", "address", "string", "bytes", "function"):
        return text
    if (m := re.fullmatch(r"u?int(\d{1,3})", text)) and int(m[1]) % 8 == 0 and 8 <= int(m[1]) <= 256:
        return text
    if (m := re.fullmatch(r"bytes(\d{1,2})", text)) and 1 <= int(m[1]) <= 32:
        return text
    raise ValueError(f"unsupported type {text!r}")


def parse_signature(text: str) -> Signature:
    """A human-readable `function ...` or `event ...` of scalar parameters."""
    m = re.fullmatch(r"\s*(function|event)\s+([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*([^;]*?);?\s*", text)
    if not m:
        raise ValueError("not a function or event of scalar parameters")
    kind, name, inside, rest = m.groups()
    if kind == "event" and rest:
        raise ValueError("anonymous events are not supported")
    params = []
    for k, part in enumerate(p.strip() for p in inside.split(",") if inside.strip()):
        words = [w for w in part.split() if w not in ("memory", "calldata", "storage")]
        if not words:
            raise ValueError("empty parameter")
        indexed = "indexed" in words[1:]
        words = [w for w in words if w != "indexed"]
        sol = " ".join(words[:2]) if words[:2] == ["address", "payable"] else words[0]
        left = words[len(sol.split()) :]
        if len(left) > 1 or (indexed and kind == "function"):
            raise ValueError(f"can't read parameter {part!r}")
        params.append(Param(left[0] if left else f"arg{k}", canonical_type(sol), indexed))
    if len({p.name for p in params}) < len(params):
        raise ValueError("parameter names repeat")
    if sum(p.indexed for p in params) > 3:
        raise ValueError("more than three indexed parameters")
    if kind == "function" and not params:
        raise ValueError("a function without inputs has nothing to decode")
    return Signature("call" if kind == "function" else "event", name, tuple(params))


def dynamic(sol: str) -> bool:
    return sol in ("string", "bytes")


def word(data: Column, at: Column | int) -> Column:
    """The 32 bytes at a byte offset; fewer at the end of the data."""
    return F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(32))


def small(w: Column) -> Column:
    """An offset or length as int; null if it is no whole word or beyond what binary data can hold (2^31 - 1 bytes)."""
    fits = (F.length(w) == 32) & (F.hex(F.substring(w, 1, 28)) == "00" * 28) & (F.hex(F.substring(w, 29, 1)) < "80")
    return F.when(fits, F.conv(F.hex(F.substring(w, 29, 4)), 16, 10).cast("long"))


def hex0x(b: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def sort_key(w: Column, signed: bool) -> Column:
    """Bytes that sort as the numbers do: the sign bit flipped for signed ones."""
    if not signed:
        return w
    flipped = F.conv(F.hex(F.substring(w, 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(128))
    return F.concat(F.unhex(F.lpad(F.hex(flipped), 2, "0")), F.substring(w, 2, 31))


def number_key(value: int, signed: bool) -> bytes:
    return ((value + (1 << 255)) if signed else value).to_bytes(32, "big")


def decimal_string(w: Column, signed: bool = False) -> Column:
    """Decimal text of a 32-byte number; of its last 8 bytes alone where they tell it."""
    upper, tail = F.substring(w, 1, 24), F.hex(F.substring(w, 25, 8))
    near = F.when(upper == F.lit(bytes(24)), F.conv(tail, 16, 10))
    if signed:
        # below zero, a base below zero reads the digits as two's complement
        return near.when((upper == F.lit(b"\xff" * 24)) & (tail >= "8"), F.conv(tail, 16, -10)).otherwise(_wide_decimal(w, signed))
    return near.otherwise(_wide_decimal(w, signed))


def _wide_decimal(w: Column, signed: bool) -> Column:
    if signed:
        negative = F.hex(F.substring(w, 1, 1)) >= "80"
        # -x is the complement plus one
        inverted = F.translate(F.hex(w), "0123456789ABCDEF", "FEDCBA9876543210")
        text = _hex_decimal(F.when(negative, _plus_one(inverted)).otherwise(F.hex(w)))
        return F.when(negative, F.concat(F.lit("-"), text)).otherwise(text)
    return _hex_decimal(F.hex(w))


def _plus_one(digits: Column) -> Column:
    """Hex digits of the number plus one: trailing Fs turn to 0 and the digit before them goes up."""
    head = F.regexp_replace(digits, "F+$", "")
    last = F.substring(head, -1, 1)
    up = F.translate(last, "0123456789ABCDE", "123456789ABCDEF")
    return F.when(F.length(head) == 0, F.lit("0" * 64)).otherwise(F.rpad(F.concat(F.left(head, F.length(head) - 1), up), 64, "0"))


#: Digits of a decimal limb: four products of a 64-bit number and a limb still fit 38 digits.
LIMB = 18


def _hex_decimal(digits: Column) -> Column:
    """Decimal text of 64 hex digits: of the last 16 alone where the others are zero, else by limbs of LIMB digits.

    The number is the sum of its four 64-bit parts times powers of 2^64, whose limbs are constants; carries then go from
    limb to limb.
    """
    low = F.conv(F.substring(digits, 49, 16), 16, 10)
    parts = [F.conv(F.substring(digits, 49 - 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = []
    for k in range(5):
        terms = [(p, (1 << 64 * p) // 10 ** (LIMB * k) % 10**LIMB) for p in range(4)]
        products = [(parts[p] * F.lit(f).cast(f"decimal({LIMB},0)")).cast("decimal(38,0)") for p, f in terms if f]
        sums.append(reduce(lambda a, b: (a + b).cast("decimal(38,0)"), products, F.lit(0).cast("decimal(38,0)")))
    base = F.lit(10**LIMB).cast("decimal(19,0)")

    def step(acc: Column, x: Column) -> Column:
        total = (acc["carry"] + x).cast("decimal(38,0)")
        rest = (total % base).cast(f"decimal({LIMB},0)")
        # the difference is a multiple of the base, so the quotient is exact
        return F.struct(((total - rest) / base).cast("decimal(38,0)").alias("carry"), F.concat(F.lpad(rest.cast("string"), LIMB, "0"), acc["text"]).alias("text"))

    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.lit("").alias("text"))
    wide = F.ltrim(F.aggregate(F.array(*sums), start, step, lambda acc: acc["text"]), F.lit("0"))
    return F.when(F.substring(digits, 1, 48) == "0" * 48, low).otherwise(wide)


def decode_values(params: tuple[Param, ...], data: Column, topics: Column | None = None) -> tuple[Column, list[Column]]:
    """(decodable, raw value of each parameter): words for numbers and bool, bytes for all else.

    Values are meaningful only where the first column is true. Data may be longer than the head; offsets and lengths
    must lie inside it. Upper bytes of short types are not checked.
    """
    head, topic, oks, out = 0, 1, [], []
    for p in params:
        if p.indexed:
            topic += 1
            out.append(_fixed(p.type, F.try_element_at(topics, F.lit(topic)), raw=dynamic(p.type)))
            continue
        w = word(data, head)
        head += 32
        if dynamic(p.type):
            offset = small(w)
            size = F.when(offset.isNotNull() & (offset < F.length(data)), small(word(data, offset.cast("int"))))
            oks.append(F.coalesce(size.isNotNull() & (offset + 32 + size <= F.length(data)), F.lit(False)))
            # where the bounds hold both are ints
            out.append(F.when(oks[-1], F.substring(data, (offset + 33).cast("int"), size.cast("int"))))
        else:
            out.append(_fixed(p.type, w))
    ok = F.length(data) >= head
    if topics is not None:
        ok = ok & (F.size(topics) == topic)
    for x in oks:
        ok = ok & x
    return F.coalesce(ok, F.lit(False)), out


def _fixed(sol: str, w: Column, raw: bool = False) -> Column:
    if raw:
        return w
    if sol == "address":
        return F.substring(w, 13, 20)
    if sol == "function":
        return F.substring(w, 1, 24)
    if sol.startswith("bytes") and sol != "bytes":
        return F.substring(w, 1, int(sol[5:]))
    return w


def canonical(p: Param, value: Column) -> Column:
    """The JSON value of a parameter: numbers as decimal text, bool, text, all else as 0x hex."""
    if p.type.startswith(("uint", "int")):
        return decimal_string(value, p.type.startswith("int"))
    if p.type == "bool":
        return F.hex(value) != "00" * 32
    if p.type == "string" and not p.indexed:
        return F.make_valid_utf8(value.cast("string"))
    return hex0x(value)


def canonical_params(params: tuple[Param, ...], values: list[Column]) -> Column:
    if len(params) != len(values):
        raise ValueError("parameters and values differ in number")
    if not params:
        return F.lit("{}")
    return F.to_json(F.struct(*[canonical(p, v).alias(p.name) for p, v in zip(params, values, strict=True)]))


def typed(p: Param, value: Column) -> Column:
    """A parameter as a value of its own type: numbers of up to 63 bits as long, of up to 126 as decimal(38,0), others as
    decimal text; bool; text; all else as binary."""
    if p.type.startswith(("uint", "int")):
        text, bits = decimal_string(value, p.type.startswith("int")), int(re.sub(r"\D", "", p.type))
        return text.try_cast("long") if bits < 64 else text.try_cast("decimal(38,0)") if bits <= 120 else text
    if p.type == "bool":
        return F.hex(value) != "00" * 32
    if p.type == "string" and not p.indexed:
        return F.make_valid_utf8(value.cast("string"))
    return value


#: A parameter as data: how its value is found and shown. ``at`` is a byte offset of the head, or the number of a topic.
DESCRIPTOR = "struct<name: string, kind: string, at: int, indexed: boolean, skip: int, size: int>"


def descriptors(signature: Signature) -> list[tuple[str, str, int, bool, int, int]]:
    """The parameters as rows of DESCRIPTOR. Kinds are uint, int, bool, text and data (of any length), and fixed (a part of a word)."""
    head, topic, out = 0, 1, []
    for p in signature.params:
        if p.indexed:
            topic += 1
        at = topic if p.indexed else head
        head += 0 if p.indexed else 32
        if dynamic(p.type):
            kind, skip, size = ("fixed", 0, 32) if p.indexed else ("text" if p.type == "string" else "data", 0, 0)
        elif p.type.startswith("uint") or p.type.startswith("int"):
            kind, skip, size = p.type.rstrip("0123456789"), 0, 32
        elif p.type == "bool":
            kind, skip, size = "bool", 0, 32
        else:
            kind, skip, size = "fixed", *{"address": (12, 20), "function": (0, 24)}.get(p.type, (0, int(p.type[5:]) if p.type[5:].isdigit() else 32))
        out.append((p.name, kind, at, p.indexed, skip, size))
    return out


def decode_by(params: Column, data: Column, topics: Column | None = None) -> Column:
    """(ok, values): what ``decode_values`` gives, for parameters that are data (an array of DESCRIPTOR) of each row.

    One expression reads rows of all signatures, so plans don't grow with their number. Each step is an array of its
    own, so that offsets and lengths are worked out once.
    """
    varies = lambda x: x["kind"].isin("text", "data")
    keep = lambda x: (x["kind"].alias("kind"), x["skip"].alias("skip"), x["size"].alias("size"))

    def place(p: Column) -> Column:
        w = F.substring(data, p["at"] + 1, F.lit(32))
        return F.struct(*keep(p), (w if topics is None else F.when(p["indexed"], F.try_element_at(topics, p["at"])).otherwise(w)).alias("w"))

    words = F.transform(params, place)
    offsets = F.transform(words, lambda x: F.struct(*keep(x), x["w"].alias("w"), F.when(varies(x), small(x["w"])).alias("offset")))
    inside = lambda x: x["offset"] < F.length(data)
    sizes = F.transform(offsets, lambda x: F.struct(*keep(x), x["w"].alias("w"), x["offset"].alias("offset"), F.when(inside(x), small(word(data, x["offset"].cast("int")))).alias("length")))
    ends = lambda x: x["offset"] + 32 + x["length"]
    good = lambda x: ~varies(x) | F.coalesce(ends(x) <= F.length(data), F.lit(False))
    value = lambda x: F.when(~varies(x), F.substring(x["w"], x["skip"] + 1, x["size"])).when(good(x), F.substring(data, (x["offset"] + 33).cast("int"), x["length"].cast("int")))
    read = F.transform(sizes, lambda x: F.struct(good(x).alias("ok"), value(x).alias("value")))
    count = lambda indexed: F.size(F.filter(params, lambda p: p["indexed"] == indexed))
    whole = F.length(data) >= 32 * count(False)
    if topics is not None:
        whole = whole & (F.size(topics) == count(True) + 1)
    return F.struct(F.coalesce(whole & F.forall(read, lambda x: x["ok"]), F.lit(False)).alias("ok"), F.transform(read, lambda x: x["value"]).alias("_values"))


def text_by(params: Column, values: Column) -> Column:
    """What ``canonical_params`` gives, for parameters that are data."""
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))

    def shown(p: Column, v: Column) -> Column:
        json = F.to_json(F.struct(F.make_valid_utf8(v.cast("string")).alias("v")))  # {"v":...}
        text = (
            F.when(p["kind"] == "uint", quoted(decimal_string(v)))
            .when(p["kind"] == "int", quoted(decimal_string(v, signed=True)))
            .when(p["kind"] == "bool", (F.hex(v) != "00" * 32).cast("string"))
            .when(p["kind"] == "text", F.substring(json, F.lit(6), F.length(json) - 6))
            .otherwise(quoted(hex0x(v)))
        )
        return F.concat(quoted(p["name"]), F.lit(":"), text)

    return F.concat(F.lit("{"), F.array_join(F.zip_with(params, values, shown), ","), F.lit("}"))


def keys_by(params: Column, values: Column) -> Column:
    """The values as bytes that compare as they do: signed numbers shifted, bool as one byte, text as valid UTF-8."""

    def key(p: Column, v: Column) -> Column:
        return (
            F.when(p["kind"] == "int", sort_key(v, signed=True))
            .when(p["kind"] == "bool", F.unhex(F.when(F.hex(v) != "00" * 32, "01").otherwise("00")))
            .when(p["kind"] == "text", F.make_valid_utf8(v.cast("string")).cast("binary"))
            .otherwise(v)
        )

    return F.zip_with(params, values, key)


def decode_call(df: DataFrame, signature: str, data: str = "input", to: str = "decoded") -> DataFrame:
    """``df`` with a struct of the typed parameters of a `function ...`; null where the data is of another one, or broken."""
    target = parse_signature(signature)
    if target.kind != "call":
        raise ValueError("not a function")
    ok, values = decode_values(target.params, F.expr(f"substring(`{data}`, 5)"))
    return _with_decoded(df, target, (F.substring(F.col(data), 1, 4) == F.lit(target.hash)) & ok, values, to)


def decode_event(df: DataFrame, signature: str, topics: str = "topics", data: str = "data", to: str = "decoded") -> DataFrame:
    """``df`` with a struct of the typed parameters of an `event ...`; null where the log is of another one, or broken."""
    target = parse_signature(signature)
    if target.kind != "event":
        raise ValueError("not an event")
    ok, values = decode_values(target.params, F.col(data), F.col(topics))
    return _with_decoded(df, target, (F.try_element_at(F.col(topics), F.lit(1)) == F.lit(target.hash)) & ok, values, to)


def _with_decoded(df: DataFrame, target: Signature, ok: Column, values: list[Column], to: str) -> DataFrame:
    fields = [typed(p, v).alias(p.name) for p, v in zip(target.params, values, strict=True)]
    return df.withColumn(to, F.when(F.coalesce(ok, F.lit(False)), F.struct(*fields) if fields else F.struct()))


def encode_number(n: Column) -> Column:
    """Hex digits of a long as a 32-byte word, in two's complement."""
    return F.when(n < 0, F.lpad(F.hex(n), 64, "F")).otherwise(F.lpad(F.hex(n), 64, "0"))


def encode_text(t: Column) -> Column:
    """Hex digits of the tail of a string: length, then the bytes filled up to whole words."""
    size = F.octet_length(t)
    return F.concat(encode_number(size.cast("long")), F.rpad(F.hex(t), (64 * F.ceil(size / 32)).cast("int"), F.lit("0")))
