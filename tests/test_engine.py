"""The engine: signatures, decoding, filters, and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from blockweft import queries as chain
from blockweft import queries_more  # noqa: F401 - registers its queries with the others
from blockweft.functions import abi
from blockweft.functions.filters import FilterError, passes, program, row_keys
from blockweft.operators import match, registry, results
from blockweft.sources import chain as origin

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text,digest", [("transfer(address,uint256)", "a9059cbb"), ("approve(address,uint256)", "095ea7b3"), ("setStatus(string,bool)", "cba676d7"), ("adjust(int256,bytes32)", "b564b862"), ("store(bytes,bytes4,uint8)", "3fe6e876")])
def test_selectors(text, digest):
    assert abi.keccak256(text.encode())[:4].hex() == digest


def test_keccak_and_topics():
    assert abi.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert abi.parse_signature("event Activity(uint indexed actor, int amount, string props)").hash.hex().startswith("5d498a4d")


@pytest.mark.parametrize("bad", ["transfer(address)", "function f()", "function f(uint7 a)", "function f(uint[] a)", "function f(bool a, bool a)", "event E(bool a) anonymous", "event E(bool indexed a, bool indexed b, bool indexed c, bool indexed d)", "function f(bool indexed a)"])
def test_bad_signatures(bad):
    with pytest.raises(ValueError):
        abi.parse_signature(bad)


@pytest.mark.parametrize("n", [0, 1, 2**64 - 1, 2**64, 2**126, 2**256 - 1])
def test_unsigned_text(spark, n):
    row = spark.createDataFrame([(bytearray(n.to_bytes(32, "big")),)], "w binary").select(abi.decimal_string(F.col("w"))).first()
    assert row[0] == str(n)


@pytest.mark.parametrize("n", [0, 7, -1, -7, -256, -(2**64), -(2**255), 2**255 - 1])
def test_signed_text(spark, n):
    row = spark.createDataFrame([(bytearray((n % 2**256).to_bytes(32, "big")),)], "w binary").select(abi.decimal_string(F.col("w"), signed=True)).first()
    assert row[0] == str(n)


def word(n):
    return (n % 2**256).to_bytes(32, "big")


@pytest.mark.parametrize("body,ok", [(word(32) + word(3) + b"abc", True), (word(32) + word(4) + b"abc", False), (word(64) + word(3), False), (b"\1" + word(32)[1:] + word(3) + b"abc", False), (word(32)[:31], False), (word(32) + word(0), True), (word(32) + word(3) + b"abc" + b"tail", True)])
def test_dynamic_bounds(spark, body, ok):
    params = abi.parse_signature("function f(string s)").params
    good, values = abi.decode_values(params, F.col("d"))
    row = spark.createDataFrame([(bytearray(body),)], "d binary").select(good, values[0]).first()
    assert row[0] is ok
    assert not ok or bytes(row[1]) in (b"abc", b"")


@pytest.mark.parametrize("expression", [{"and": [{"field": "params.value", "op": "eq", "value": "1"}]}, {"field": "params.value", "op": "eq", "value": 1}, {"field": "params.nothing", "op": "eq", "value": "1"}, {"field": "params.to", "op": "gt", "value": "0x" + "00" * 20}, {"field": "event.emitter", "op": "eq", "value": "0x" + "00" * 20}, {"field": "params.value", "op": "eq", "value": str(2**256)}, {"field": "params.to", "op": "eq", "value": "0x00"}, {"other": 1}])
def test_bad_filters(spark, expression):
    signature = abi.parse_signature("function transfer(address to, uint256 value)")
    with pytest.raises(FilterError):
        program(expression, signature)


@pytest.mark.parametrize("name", sorted(chain.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events", "supplier", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = chain.QUERIES[name](spark, SF)
    cursor = con.execute(chain.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(ours.columns)
    shown = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert shown(ours.select(*columns).collect()) == shown(cursor.fetchall())


def test_receipts_are_one_a_call(spark):
    sent, told = origin.transactions(spark, SF), origin.receipts(spark, SF)
    monitors = match.registry(spark, chain.only(1))
    assert match.matched_calls(sent, told, monitors).count() > 0
    one = match.call_candidates(sent, monitors).select("tx_hash").limit(1)
    for bad, reason in ((told.unionByName(told.join(one, "tx_hash", "left_semi").select(*told.columns)), "several receipts"), (told.join(one, "tx_hash", "left_anti").select(*told.columns), "no receipt")):
        with pytest.raises(Exception, match=reason):
            match.matched_calls(sent, bad, monitors).collect()
        assert {r.reason for r in match.receipt_faults(sent, bad, monitors).collect()} == {reason}
        assert match.matched_calls(sent, bad, monitors, strict=False).where("fault IS NULL").count() == match.matched_calls(sent, told, monitors).join(one, "tx_hash", "left_anti").count()


def test_sink_needs_known_monitors(spark):
    found = match.indexed(origin.transactions(spark, SF), origin.receipts(spark, SF), origin.logs(spark, SF), chain.only(1, 9))
    with pytest.raises(Exception, match="unknown"):
        results.sink_batches(found, match.registry(spark, chain.only(9))).collect()


@pytest.mark.parametrize("row,problem", [((1, "12", "function f(bool a)", 1, None), "20 bytes"), ((1, "00" * 20, "function f()", 1, None), "nothing to decode"), ((9, "00" * 20, "function f(bool a)", 1, None), "unknown chain"), ((1, "00" * 20, "function f(bool a)", 5, 4), "before the start"), ((2, "00" * 20, "function f(bool a)", None, None), "no finalized head")])
def test_bad_definitions(spark, row, problem):
    wanted = spark.createDataFrame([row], "chain_id long, address string, signature string, start_block long, end_block long")
    chains = spark.createDataFrame([(1,), (2,)], "chain_id long")
    heads = spark.createDataFrame([(1, 7)], "chain_id long, finalized_head long")
    with pytest.raises(Exception, match=problem):
        registry.appended(match.registry(spark, chain.only(1)), wanted, chains, heads).collect()


def test_each_table_is_read_once(spark):
    plan = chain.QUERIES["results_all_monitors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # transactions and receipts come from orders
    assert plan.count("events.parquet") + plan.count("orders.parquet") + plan.count("Relation [") <= 3


def payload(kind, rng):
    """A random body of a parameter's kind, as (head word, tail)."""
    if kind in ("string", "bytes"):
        raw = bytes(rng.integers(32, 127, int(rng.integers(0, 40)), dtype="uint8"))
        return None, word(len(raw)) + raw + bytes(-len(raw) % 32), raw
    raw = bytes(rng.integers(0, 256, 32, dtype="uint8")) if rng.random() < 0.7 else word(int(rng.integers(-3, 3)))
    return raw, b"", raw


KINDS = ["uint256", "uint8", "int256", "int64", "bool", "address", "bytes4", "bytes32", "string", "bytes", "function"]


def test_parameters_as_data_read_like_those_of_a_plan(spark):
    """Random signatures, whole and broken payloads: values, texts and filters by data equal those by expressions."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(6):
        kinds = [KINDS[k] for k in rng.integers(0, len(KINDS), int(rng.integers(1, 6)))]
        signature = abi.parse_signature("function f(" + ", ".join(f"{t} p{k}" for k, t in enumerate(kinds)) + ")")
        rows = []
        for n in range(12):
            head, tail = b"", b""
            for t in kinds:
                fixed, more, _ = payload(t, rng)
                head += word(32 * len(kinds) + len(tail)) if fixed is None else fixed
                tail += more
            body = head + tail
            rows.append((bytearray(body if n % 4 else body[: int(rng.integers(0, len(body) + 1))]), abi.descriptors(signature)))
        df = spark.createDataFrame(rows, f"d binary, params array<{abi.DESCRIPTOR}>")
        ok, values = abi.decode_values(signature.params, F.col("d"))
        plain = df.select(ok.alias("ok"), F.when(ok, abi.canonical_params(signature.params, values)).alias("text")).collect()
        got = df.select("params", F.inline(F.array(abi.decode_by(F.col("params"), F.col("d"))))).select("ok", F.when(F.col("ok"), abi.text_by(F.col("params"), F.col("_values"))).alias("text")).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in plain]
        assert any(r.ok for r in got)


def test_programs_fold_like_nested_conditions(spark):
    import random

    rng = random.Random(2)
    signature = abi.parse_signature("function f(uint256 a, int256 b, bool c, string d)")
    tests = [("params.a", ["0", "5", str(2**255)]), ("params.b", ["-7", "0", "3"]), ("block.number", ["1", "9", str(2**64 - 1)])]

    def grown(depth):
        if depth and rng.random() < 0.7:
            kind = rng.choice(["and", "or", "not"])
            return {"not": grown(depth - 1)} if kind == "not" else {kind: [grown(depth - 1) for _ in range(rng.randint(2, 4))]}
        if rng.random() < 0.3:
            return rng.choice([{"field": "params.c", "op": "eq", "value": True}, {"field": "params.d", "op": "ne", "value": "x"}, {"field": "tx.hash", "op": "eq", "value": "0x" + "ab" * 32}])
        name, values = rng.choice(tests)
        return {"field": name, "op": rng.choice(["eq", "ne", "gt", "gte", "lt", "lte"]), "value": rng.choice(values)}

    def holds(e, row):
        """True, False, or None where a null is compared."""
        if "not" in e:
            inner = holds(e["not"], row)
            return None if inner is None else not inner
        for key, stop in (("and", False), ("or", True)):
            if key in e:
                parts = [holds(x, row) for x in e[key]]
                return stop if stop in parts else None if None in parts else not stop
        left, right = row[e["field"]], e["value"]
        if e["field"] in ("params.a", "params.b", "block.number"):
            right = int(right)
        elif e["field"] == "tx.hash":
            right = bytes.fromhex(right[2:])
        if left is None:
            return None
        return {"eq": left == right, "ne": left != right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[e["op"]] if e["op"] not in ("eq", "ne") else (left == right) == (e["op"] == "eq")

    facts = [{"params.a": a, "params.b": b, "params.c": c, "params.d": d, "block.number": n, "tx.hash": h} for a, b, c, d, n, h in [(0, -7, True, "x", 1, b"\xab" * 32), (5, 0, False, "y", 9, None), (2**255, 3, True, "", 2, b"\0" * 32)]]
    filters = [grown(4) for _ in range(25)]
    rows = [(k, j, bytearray(word(f["params.a"])), bytearray(word(f["params.b"])), bytearray(word(int(f["params.c"]))), bytearray(f["params.d"].encode()), f["block.number"], None if f["tx.hash"] is None else bytearray(f["tx.hash"]), program(e, signature), abi.descriptors(signature)) for k, e in enumerate(filters) for j, f in enumerate(facts)]
    df = spark.createDataFrame(rows, f"k int, j int, a binary, b binary, c binary, d binary, block_number long, tx_hash binary, steps array<{match.STEP}>, params array<{abi.DESCRIPTOR}>")
    keys = row_keys({"block_number": F.col("block_number"), "tx_hash": F.col("tx_hash")}, abi.keys_by(F.col("params"), F.array("a", "b", "c", "d")))
    got = {(r.k, r.j): r.fits for r in df.select("k", "j", passes(F.col("steps"), keys).alias("fits")).collect()}
    assert got == {(k, j): holds(e, f) is True for k, e in enumerate(filters) for j, f in enumerate(facts)}
    assert set(got.values()) == {True, False}


def test_ten_thousand_monitors_are_planned_at_once(spark):
    """The plan is the same for any number of monitors, signatures and filters."""
    import time

    def many(n):
        return [match.Monitor(k + 1, 1, f"{k:040x}", f"function f{k % 50}(uint256 value{k % 50}, string note)", filter={"field": f"params.value{k % 50}", "op": "gte", "value": str(k)}) for k in range(n)]

    told, sizes = (origin.transactions(spark, SF), origin.receipts(spark, SF), origin.logs(spark, SF)), []
    for n in (1, 10_000):
        monitors = many(n)
        began = time.time()
        plan = match.indexed(*told, monitors)._jdf.queryExecution().executedPlan().toString()
        took = time.time() - began
        sizes.append(plan.count("\n"))
    assert took < 10 and sizes[0] == sizes[1]


def test_monitors_of_one_target_share_a_row(spark):
    one = match.Monitor(1, 1, chain.contract(chain.URGENT), origin.TRANSFER)
    other = match.Monitor(2, 1, one.address, origin.TRANSFER, filter={"field": "params.value", "op": "gte", "value": "25000000"})
    renamed = match.Monitor(3, 1, one.address, "function transfer(address who, uint256 sum)", start_block=10**9)
    table = match.registry(spark, [one, other, renamed])
    assert match.targets(table, "call").count() == 2
    matched = match.matched_calls(origin.transactions(spark, SF), origin.receipts(spark, SF), table)
    found = {r.monitor_id: r.n for r in match.decoded(matched).where("ok").groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found[1] > found[2] > 0 and 3 not in found and matched.count() == 133


def test_decimal_texts_at_the_edges_of_words(spark):
    edges = {n + d for k in (0, 1, 63, 64, 65, 127, 128, 192, 255) for n in (1 << k, -(1 << k)) for d in (-1, 0, 1)}
    rows = [(n, (n % (1 << 256)).to_bytes(32, "big")) for n in sorted(edges) if -(1 << 255) <= n < 1 << 255]
    df = spark.createDataFrame([(str(n), w) for n, w in rows], "n string, w binary")
    got = df.select("n", "w", abi.decimal_string(F.col("w")).alias("u"), abi.decimal_string(F.col("w"), signed=True).alias("s")).collect()
    assert len(got) == len(rows) and all(r.s == r.n and r.u == str(int.from_bytes(r.w, "big")) for r in got)


def test_texts_that_nobody_reads_are_not_made(spark):
    table = match.registry(spark, chain.only(1, 9))
    found = match.outcomes(origin.transactions(spark, SF), origin.receipts(spark, SF), origin.logs(spark, SF), table).where("ok")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" in plan(found.select("params")).lower() or "structstojson" in plan(found.select("params")).lower()
    assert "to_json" not in plan(found.groupBy("monitor_id").count()).lower() and "structstojson" not in plan(found.groupBy("monitor_id").count()).lower()
