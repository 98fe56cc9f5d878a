"""Publication, streaming, registries and responses of providers, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from blockweft.operators import commitlog, match, publish, registry, reports
from blockweft.operators.match import Monitor
from blockweft.plans import blocks
from blockweft.queries import contract, only
from blockweft.sources import chain, rpc
from blockweft.streaming.index import index_step, run_stream

SF = "/root/testdata/sf0.001"
KEY = ["monitor_id", "kind", "block_number", "tx_hash", "log_index", "params"]


def tables(spark):
    return chain.transactions(spark, SF), chain.receipts(spark, SF), chain.logs(spark, SF)


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*KEY).collect())


def test_stream_equals_batch(spark, tmp_path):
    monitors = only(1, 9)
    for k, head in enumerate((40, 120, 300)):
        spark.createDataFrame([(1, head)], "chain_id long, finalized_head long").coalesce(1).write.parquet(f"{tmp_path}/heads", mode="append")
    heads = spark.readStream.schema("chain_id long, finalized_head long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/heads")
    root = f"{tmp_path}/store"
    run_stream(heads, index_step(root, tables, lambda: monitors, 10_000), f"{tmp_path}/check").awaitTermination()
    assert rows(publish.visible(spark, root)) == rows(match.indexed(*tables(spark), monitors).where("block_number <= 300"))
    assert {m.id: m.cursor for m in publish.progressed(spark, root, match.registry(spark, monitors)).collect()} == {1: 300, 9: 300}


def test_batches_are_repeatable_and_bounded(spark, tmp_path):
    heads = spark.createDataFrame([(1, 300)], "chain_id long, finalized_head long")
    root = str(tmp_path)
    assert publish.step(spark, root, 0, tables(spark), only(1), heads, 25)
    assert not publish.step(spark, root, 0, tables(spark), only(1), heads, 25)
    assert [m.cursor for m in publish.progressed(spark, root, match.registry(spark, only(1))).collect()] == [24]
    assert publish.visible(spark, root).agg(F.max("block_number")).first()[0] <= 24


def test_a_bad_block_stops_its_chain_only(spark, tmp_path):
    schema = "id long, chain_id long, first long, last long"
    monitors = match.registry(spark, [Monitor(1, 1, contract("x"), chain.TRANSFER, end_block=9), Monitor(2, 8453, contract("x"), chain.TRANSFER, end_block=9)])
    result = lambda c, m, b: (c, m, "call", b, bytes([m, b]), None, None, None, None, "{}")
    results = spark.createDataFrame([result(1, 1, 3), result(1, 1, 5), result(8453, 2, 5)], publish.RESULTS)
    faults = spark.createDataFrame([(1, 5, "removed log"), (1, 7, "no receipt")], "chain_id long, block_number long, reason string")
    planned = spark.createDataFrame([(1, 1, 0, 9), (2, 8453, 0, 9)], schema)
    assert publish.publish(spark, str(tmp_path), 4, planned, monitors, results, faults)
    assert {(r.monitor_id, r.cursor, r.completed, r.error) for r in publish.commits(spark, str(tmp_path)).collect()} == {(1, 4, False, "removed log"), (2, 9, True, None)}
    assert sorted((r.monitor_id, r.block_number) for r in publish.visible(spark, str(tmp_path)).collect()) == [(1, 3), (2, 5)]
    # an identity again, and a monitor of another chain
    none = faults.limit(0)
    with pytest.raises(publish.CommitError):
        publish.publish(spark, str(tmp_path), 5, planned, monitors, results.limit(1), none)
    with pytest.raises(publish.CommitError):
        publish.publish(spark, str(tmp_path), 6, spark.createDataFrame([(2, 1, 0, 9)], schema), monitors, results.limit(0), none)
    assert publish.commits(spark, str(tmp_path)).select("batch_id").distinct().count() == 1


def test_ranges_are_halved_until_they_fit(spark):
    def fetch(chain_id, low, high, addresses, topics):
        if high - low > 2:
            raise rpc.RangeLimit
        log = {"address": "0x" + addresses[0], "topics": ["0x" + topics[0]], "data": "0x", "transactionHash": "0x" + "ab" * 32, "logIndex": "0x0", "removed": False}
        return [json.dumps({"request": {"chain_id": chain_id}, "result": [log | {"blockNumber": hex(b)} for b in range(low, high + 1)]})]

    windows = spark.createDataFrame([(1, 10, 21)], "chain_id long, from_block long, to_block long")
    groups = blocks.log_groups(blocks.log_targets(match.registry(spark, only(9))))
    logs = rpc.logs_of(rpc.fetched_logs(windows, groups, fetch)).collect()
    assert sorted(r.block_number for r in logs) == list(range(10, 22))
    assert bytes(logs[0].address).hex() == contract("purchase") and len(logs[0].topics[0]) == 32


def test_responses_without_fields(spark):
    lines = [{"request": {"chain_id": 1}, "result": [{"address": "0x" + "00" * 20, "topics": [], "data": "0x12"}, {"address": "0x12", "blockNumber": "0xffffffffffffffff", "topics": ["0x1"], "data": "zz"}]}]
    dump = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("no json",), (None,)], "value string")
    found = rpc.logs_of(dump).collect()
    assert len(found) == 2 and found[0].block_number is None and bytes(found[0].data) == b"\x12"
    assert found[1].address is None and found[1].block_number is None and found[1].data is None
    blocks_dump = spark.createDataFrame([(json.dumps({"request": {"chain_id": 1, "number": 7}, "result": None}),), ("no json",), (None,)], "value string")
    assert sorted(r.reason for r in rpc.block_rejects(blocks_dump).collect()) == ["no such block", "unreadable response", "unreadable response"]
    assert rpc.transactions_of(blocks_dump).count() == 0


@pytest.mark.parametrize("change", [("insert", 1, "u", None), ("insert", 2, None, None), ("update", 2, "u", None), ("update", 1, None, None)])
def test_bad_changes(spark, change):
    chains = spark.createDataFrame([(1, "a", True)], "chain_id long, rpc_url string, enabled boolean")
    changes = spark.createDataFrame([change], "op string, chain_id long, rpc_url string, enabled boolean")
    with pytest.raises(Exception, match="chain"):
        registry.upserted_chains(chains, changes).collect()


def test_definitions_with_filters(spark):
    chains = spark.createDataFrame([(1,)], "chain_id long")
    heads = spark.createDataFrame([(1, 77)], "chain_id long, finalized_head long")
    schema = "chain_id long, address string, signature string, start_block long, end_block long, filter string, filter_version int"
    condition = json.dumps({"field": "params.value", "op": "gte", "value": "25000000"})
    add = lambda *rows: registry.appended(match.registry(spark, only(9)), spark.createDataFrame(list(rows), schema), chains, heads)
    good = (1, contract("x"), chain.TRANSFER, None, None, condition, 1)
    made = {r.id: r for r in add(good, good).collect()}
    assert {k: r.start_block for k, r in made.items()} == {9: 0, 10: 77, 11: 77}
    assert [(t.op, t.field) for t in made[10].program] == [("gte", 7)] and made[10].params[1].name == "value"
    for change, problem in (({"chain_id": 5}, "unknown chain"), ({"signature": "function f()"}, "nothing to decode"), ({"filter": "{"}, "Expecting"), ({"filter": '{"x": 1}'}, "no known form"), ({"filter_version": None}, "belong together"), ({"filter": None}, "belong together"), ({"filter_version": 2}, "belong together")):
        bad = tuple((dict(zip(schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), good)) | change).values())
        with pytest.raises(Exception, match=problem):
            add(good, bad).collect()


def test_a_stored_registry_has_one_writer_a_version(spark, tmp_path):
    root = str(tmp_path)
    assert registry.stored(spark, root).count() == 0
    assert registry.store(spark, root, match.registry(spark, only(1)), None) == 0
    assert registry.store(spark, root, match.registry(spark, only(1, 9)), 0) == 1
    with pytest.raises(ValueError, match="already"):
        registry.store(spark, root, match.registry(spark, only(9)), 0)
    assert registry.stored(spark, root).count() == 2 and registry.stored(spark, root, 0).count() == 1 and registry.versions(spark, root) == [0, 1]


def test_the_same_batch_at_once_counts_once(spark, tmp_path):
    heads = spark.createDataFrame([(1, 300)], "chain_id long, finalized_head long")
    root = str(tmp_path)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda _: publish.step(spark, root, 0, tables(spark), only(1), heads, 1000), range(3)))
    assert sorted(won) == [False, False, True]
    want = rows(match.indexed(*tables(spark), only(1)).where("block_number <= 300"))
    assert rows(publish.visible(spark, root)) == want and publish.commits(spark, root).count() == 1
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(lambda text: commitlog.claim(spark, f"{root}/claim", text), "ab")) == [False, True]


def test_readers_open_a_snapshot_and_a_short_tail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "COMPACT", 3)
    root, planned = str(tmp_path), "id long, chain_id long, first long, last long"
    monitors = match.registry(spark, [Monitor(1, 1, contract("x"), chain.TRANSFER)])
    none = spark.createDataFrame([], publish.RESULTS)
    faults = spark.createDataFrame([], "chain_id long, block_number long, reason string")
    for n in range(7):
        assert publish.publish(spark, root, n, spark.createDataFrame([(1, 1, 10 * n, 10 * n + 9)], planned), monitors, none, faults)
        publish.compact(spark, root)
        assert len(commitlog.tail(spark, root)[1]) < 3
        assert [(r.monitor_id, r.cursor) for r in publish.cursors(spark, root).collect()] == [(1, 10 * n + 9)]
    assert commitlog.tail(spark, root)[0] == 5 and commitlog.records(spark, root).count() == 7
    # a snapshot without its marker doesn't count
    (tmp_path / "snapshots" / "5" / "_SUCCESS").unlink()
    assert commitlog.tail(spark, root)[0] == 2 and publish.cursors(spark, root).first().cursor == 69


def test_scans_are_restricted_to_planned_blocks(spark, tmp_path):
    planned = spark.createDataFrame([(1, 1, 0, 9), (2, 1, 5, 14), (3, 1, 900, 909), (4, 1, 15, 20), (5, 8453, 7, 8)], publish.PLANNED)
    assert publish.spans(planned) == [(1, 0, 20), (1, 900, 909), (8453, 7, 8)]
    assert publish.spans(planned, 0) == [(1, 0, 909), (8453, 7, 8)]
    spark.range(1000).select(F.lit(1).cast("long").alias("chain_id"), F.col("id").alias("block_number")).repartitionByRange(10, "block_number").write.parquet(f"{tmp_path}/t")
    found = spark.read.parquet(f"{tmp_path}/t").where(publish.within(publish.spans(planned)))
    assert sorted(r.block_number for r in found.collect()) == [*range(21), *range(900, 910)]
    # of ten files of a hundred blocks two are read
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() == 200


def test_the_last_batch_is_tried_again_without_new_heads(spark, tmp_path):
    spark.createDataFrame([(1, 300)], "chain_id long, finalized_head long").coalesce(1).write.parquet(f"{tmp_path}/heads")
    heads = spark.readStream.schema("chain_id long, finalized_head long").parquet(f"{tmp_path}/heads")
    root, tried = f"{tmp_path}/store", []

    def failing_once(s):
        tried.append(1)
        if len(tried) == 1:
            raise OSError("no answer")
        return tables(s)

    run_stream(heads, index_step(root, failing_once, lambda: only(1), 10_000, pause=0.1), f"{tmp_path}/check").awaitTermination()
    assert len(tried) == 2 and rows(publish.visible(spark, root)) == rows(match.indexed(*tables(spark), only(1)).where("block_number <= 300"))
    assert [r.error for r in publish.polls(spark, root).collect()] == [None]


def test_registry_jobs(spark):
    table = match.registry(spark, only(1, 9))
    paused = registry.set_enabled(table, spark.createDataFrame([(9, False)], "id long, enabled boolean"))
    assert {r.id: r.enabled for r in paused.collect()} == {1: True, 9: False}
    views = {r.id: r for r in registry.monitor_view(table).collect()}
    assert views[1].selector == "0xa9059cbb" and views[1].topic0 is None and views[9].selector is None and len(views[9].topic0) == 66


def test_a_stream_outlives_a_failed_batch_and_publishes_after_commits(spark, tmp_path):
    for head in (40, 120, 300):
        spark.createDataFrame([(1, head)], "chain_id long, finalized_head long").coalesce(1).write.parquet(f"{tmp_path}/heads", mode="append")
    heads = spark.readStream.schema("chain_id long, finalized_head long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/heads")
    root, tried, sent = f"{tmp_path}/store", [], []

    def failing_once(s):
        tried.append(1)
        if len(tried) == 2:
            raise OSError("no answer")
        return tables(s)

    def sink(payloads, batch_id):
        if batch_id == 0:
            raise OSError("sink is away")
        sent.append((batch_id, payloads.agg(F.sum("n")).first()[0]))

    run_stream(heads, index_step(root, failing_once, lambda: only(1, 9), 10_000, sink, tries=1), f"{tmp_path}/check").awaitTermination()
    assert rows(publish.visible(spark, root)) == rows(match.indexed(*tables(spark), only(1, 9)).where("block_number <= 300"))
    polls = {r.batch_id: r for r in publish.polls(spark, root).collect()}
    assert polls[0].error == "publication: OSError: sink is away" and polls[0].decoded > 0
    assert polls[1].error == "OSError: no answer" and polls[1].decoded == 0
    assert polls[2].error is None and sent == [(2, polls[2].decoded)]
    assert sum(p.decoded for p in polls.values()) == publish.visible(spark, root).count()
    enabled = spark.createDataFrame([(1, True), (7, True)], "chain_id long, enabled boolean")
    state = {r.chain_id: r for r in reports.chain_status(publish.polls(spark, root), enabled, "batch_id").collect()}
    assert (state[1].state, state[1].finalized_head) == ("running", polls[2].finalized_head) and state[7].state == "starting"


def test_logs_outside_the_range_asked_for(spark):
    monitor = only(9)[0]
    line = lambda block, low, high: json.dumps({"request": {"chain_id": 1, "from_block": low, "to_block": high}, "result": [{"address": "0x" + monitor.address, "topics": ["0x" + monitor.target.hash.hex()], "data": "0x", "blockNumber": block, "transactionHash": "0x" + "ab" * 32, "logIndex": "0x0"}]})
    table = match.registry(spark, [Monitor(9, 1, monitor.address, monitor.signature, cursor=11)])
    faults = lambda *lines: [(r.block_number, r.reason) for r in match.log_faults(rpc.logs_of(spark.createDataFrame([(x,) for x in lines], "value string")), table).collect()]
    assert faults(line("0xf", 10, 19), line("0x13", 10, 19)) == []
    # beyond the range, and without a block: the first block of the range that the monitor still needs
    assert faults(line("0x14", 10, 19), line(None, 10, 19)) == [(12, "log outside the range asked for")]
    assert faults(line("0x14", 0, 11)) == []


def test_receipts_are_taken_for_candidates_only(spark, tmp_path, monkeypatch):
    sent, told = chain.transactions(spark, SF), chain.receipts(spark, SF)
    table = match.registry(spark, only(1, 8))
    match.called(sent, table).write.parquet(f"{tmp_path}/candidates")
    candidates = spark.read.parquet(f"{tmp_path}/candidates")
    count = candidates.count()
    one = candidates.select("tx_hash").orderBy("tx_hash").limit(1)
    lost = told.join(one, "tx_hash", "left_anti").select(*told.columns)
    twice = told.unionByName(told.join(one, "tx_hash", "left_semi").select(*told.columns))
    shown = lambda df: sorted((r.chain_id, r.block_number, bytes(r.tx_hash), r.fault) for r in df.collect())
    assert 0 < count < told.count() and match.sieved(told, candidates).count() == count
    for few in (50_000, 0):  # candidates are sent to the receipts, or their marks are
        monkeypatch.setattr(match, "BROADCAST_ROWS", few)
        for answers in (told, lost, twice):
            assert shown(match.settled(candidates, answers, False, count)) == shown(match.matched_calls(sent, answers, table, strict=False))
    assert match.settled(candidates.limit(0), told, True, 0).count() == 0


def test_a_sieve_keeps_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(match, "SIEVE_BITS", 17)
    rows = spark.range(40_000).select((F.col("id") % 3).alias("chain_id"), F.col("id").alias("block_number"), F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("tx_hash"), F.lit(True).alias("succeeded"))
    some = rows.where("block_number % 7 = 3")
    marks = {r[0] for r in some.select(match._mark()).collect()}
    want = {r.block_number for r in rows.select("block_number", match._mark().alias("m")).collect() if r.m in marks}
    got = [r.block_number for r in match.sieved(rows, some).collect()]
    assert len(got) == len(set(got)) and set(got) == want >= {r.block_number for r in some.collect()} and len(want) < 12_000
    assert match.sieved(rows, some.limit(0)).count() == 0


def test_monitors_are_looked_up_by_their_blocks(spark):
    sent, told, logs = chain.transactions(spark, SF), chain.receipts(spark, SF), chain.logs(spark, SF)
    call, event = only(1)[0], only(9)[0]
    reach = lambda k: None if k % 11 == 0 else 2 * k + (0, 0, 3, 20, 70, 5000)[k % 6]
    many = [Monitor(k, 1, m.address, m.signature, 2 * k, reach(k), cursor=2 * k + 1 if k % 7 == 0 else None) for k in range(1, 300) for m in (call if k % 2 else event,)]
    table = match.registry(spark, many)
    per_block = match.indexed(sent, told, logs, [Monitor(1, 1, call.address, call.signature), Monitor(2, 1, event.address, event.signature)]).groupBy("kind", "block_number").agg(F.count(F.lit(1)).alias("n")).collect()
    want = {}
    for m in many:
        low, high = max(m.start_block, (m.cursor or -1) + 1), 1 << 40 if m.end_block is None else m.end_block
        n = sum(r.n for r in per_block if r.kind == m.target.kind and low <= r.block_number <= high)
        want |= {m.id: n} if n else {}
    for small in (True, False):
        found = match.outcomes(sent, told, logs, table, strict=True, small=small).where("ok")
        assert {r.monitor_id: r["count"] for r in found.groupBy("monitor_id").count().collect()} == want
    # lists grow with the monitors that overlap, not with all of a target
    narrow = match.registry(spark, [Monitor(k, 1, call.address, call.signature, k, k + 3) for k in range(1, 300)])
    keyed = sent.where("to_addr IS NOT NULL").withColumn("hash", match.selector(F.col("input")))
    assert 0 < match.watched(keyed, "to_addr", narrow, "call", True).agg(F.max(F.size("wanted"))).first()[0] <= 7


def test_windows_of_ranges_are_those_of_blocks(spark):
    planned = [(1, 1, 0, 9), (2, 1, 5, 14), (3, 1, 17, 40), (4, 1, 15, 15), (5, 8453, 7, 8), (6, 1, 41, 41), (7, 1, 0, 3)]
    for most in (1, 4, 7, 100):
        blocks_of = {}
        for _, c, low, high in planned:
            blocks_of.setdefault(c, set()).update(range(low, high + 1))
        want = {}
        for c, all_blocks in blocks_of.items():
            window = []
            for b in sorted(all_blocks):
                if not window or b != window[-1] + 1 or len(window) == most:
                    window = []
                window.append(b)
                want[c, b] = window
        found = blocks.fetched(spark.createDataFrame(planned, publish.PLANNED), most).collect()
        assert {(r.id, r.fetch_first, r.fetch_last) for r in found} == {(i, want[c, low][0], want[c, high][-1]) for i, c, low, high in planned}
        assert all((r.fetch_first - r.run_first) % most == 0 and r.window == most for r in found)
    with pytest.raises(ValueError, match="a block"):
        blocks.fetched(spark.createDataFrame(planned, publish.PLANNED), 0)


def test_a_removed_log_voids_its_window(spark):
    one = only(9)[0]
    table = match.registry(spark, [Monitor(9, 1, one.address, one.signature, 10, 16), Monitor(3, 1, contract("x"), chain.TRANSFER, 4, 30)])
    planned = spark.createDataFrame([(9, 1, 10, 16), (3, 1, 4, 30)], publish.PLANNED)
    windowed = table.join(blocks.fetched(planned, 5).select("id", *match.FETCHED), "id")  # 4-8, 9-13, 14-18, ...
    schema = "block_number long, log_index long, removed boolean, has_hash boolean, first_block long, last_block long"

    def faults(registry_, *logs, ranged=False):
        rows = spark.createDataFrame(list(logs), schema).select(F.lit(1).cast("long").alias("chain_id"), "block_number", "log_index", "removed", F.when(F.col("has_hash"), F.lit(b"h" * 32)).alias("tx_hash"), F.lit(bytes.fromhex(one.address)).alias("address"), F.array(F.lit(one.target.hash)).alias("topics"), F.lit(b"").alias("data"), "first_block", "last_block")
        return sorted((r.block_number, r.reason) for r in match.log_faults(rows if ranged else rows.drop("first_block", "last_block"), registry_).collect())

    removed = lambda b: (b, 0, True, True, None, None)
    assert faults(windowed, removed(12), removed(13)) == [(9, "removed log")]
    assert faults(windowed, removed(9)) == [(9, "removed log")] and faults(windowed, removed(18)) == [(14, "removed log")]
    assert faults(windowed, removed(8), removed(19)) == []  # windows in which no event is looked for
    assert faults(windowed, (12, None, False, True, None, None), (11, 0, False, False, None, None), (9, 0, False, False, None, None)) == [(11, "log without transaction hash"), (12, "log without index")]
    assert faults(table, removed(12), removed(9)) == [(12, "removed log")]  # without windows, its block
    assert faults(windowed, (40, 0, False, True, 14, 18), (None, 0, False, True, 9, 13), ranged=True) == [(9, "log outside the range asked for"), (14, "log outside the range asked for")]
    assert faults(windowed, (40, 0, False, True, 19, 23), ranged=True) == []


def test_receipts_answer_their_requests(spark):
    one, two, three = ("0x" + c * 64 for c in "abc")
    told = lambda h, status="0x1": {"transactionHash": h, "status": status}
    line = lambda number, hashes, result: json.dumps({"request": {"chain_id": 1, "number": number, "hashes": hashes}, "result": result})
    bad = ["no json", None, json.dumps({"result": []}), json.dumps({"request": {"chain_id": 1, "number": 5}, "result": []})]

    def answers(by_place, *lines):
        rows = rpc.receipts_answered(spark.createDataFrame([(x,) for x in lines], "value string"), by_place).collect()
        return sorted(((r.block_number, r.tx_hash and "0x" + bytes(r.tx_hash).hex(), r.succeeded, r.reason) for r in rows), key=str)

    for by_place in (True, False):
        assert [a[3] for a in answers(by_place, *bad)] == ["unreadable response"] * 4
        assert answers(by_place, line(7, [one], None), line(8, [], [])) == [(7, one, None, "no answer")]
        assert answers(by_place, line(7, [one, two], [told(one), told(two, None)])) == [(7, one, True, None), (7, two, None, "receipt without status")]
        assert answers(by_place, line(7, [one, two], [told(one, "0x0")])) == [(7, one, False, None), (7, two, None, "no receipt")]
        assert [a[3] for a in answers(by_place, line(7, ["0x12", None], [told(one), told(two)]))] in (["no hash was asked for"] * 2, ["no hash was asked for"])
    mixed = line(7, [one, two, three], [told(two, "0x0"), None, told(three), told(three, "0x0")])
    assert answers(True, mixed) == [(7, one, None, "another receipt than asked for"), (7, two, None, "no receipt"), (7, three, True, None)]
    assert answers(False, mixed) == [(7, one, None, "no receipt"), (7, two, False, None), (7, three, False, None)]
    with pytest.raises(Exception, match="no receipt: BBBB"):
        rpc.receipts_of(spark.createDataFrame([(line(7, [one, two], [told(one)]),)], "value string"), True, True).collect()


def test_responses_with_receipts_are_read_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    for by_place in (True, False):
        plan = rpc.receipts_answered(lines, by_place)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("from_json(") + plan.count("jsontostructs(") == 1
    hexes = ["0x" + "aB" * 32, "0x" + "ab" * 31, "0x" + "ab" * 33, "0x" + "a" * 63, "ab" * 33, "0x" + "ag" * 32, "0x", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hexes)], "k int, h string")
    assert [r.k for r in df.where(rpc.data(F.col("h"), 32).isNotNull()).orderBy("k").collect()] == [0]
    assert [r.k for r in df.where(rpc.data(F.col("h")).isNotNull()).orderBy("k").collect()] == [0, 1, 2, 6]


def test_entries_of_chains(spark):
    schema = "chainId long, networkId long, testnet boolean, name string, tvl double, rpc array<struct<url: string>>, pos long"
    good = [("https://x",)]
    entries = [(1, 1, None, None, None, good, 0), (1, 1, None, "later", 1.0, good, 1), (2, 2, True, "test", 1.0, good, 2), (3, None, False, "no id", 1.0, good, 3), (0, 1, None, "zero", 1.0, good, 4), (-5, 1, None, "below", 1.0, good, 5),
               (None, 1, None, "null", 1.0, good, 6), (6, 6, None, "none", 1.0, None, 7), (7, 7, None, "empty", 1.0, [("wss://x",), (None,)], 8)]
    found = rpc.endpoint_list(spark.createDataFrame(entries, schema)).collect()
    assert [tuple(r) for r in found] == [(1, "chain-1", 0.0, ["https://x"], 1)]
    assert rpc.endpoint_list(spark.createDataFrame([], schema)).count() == 0


def test_nothing_behind_the_first_faulty_log_is_decoded(spark, tmp_path):
    def keep(name, table):
        table.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    sent, told, logs = tables(spark)
    monitors = match.registry(spark, only(1, 9))
    late = (F.col("block_number") > 20) & (F.col("block_number") % 3 == 0)
    found = match.outcomes(sent, told, logs.withColumn("removed", late), monitors, keep=keep).cache()
    bad = found.where("fault IS NOT NULL").agg(F.min("block_number")).first()[0]
    assert found.agg(F.max("block_number")).first()[0] == bad > 20
    below = match.outcomes(sent, told, logs, monitors).where(F.col("block_number") < bad)
    assert rows(found.where(F.col("block_number") < bad)) == rows(below) and below.select("kind").distinct().count() == 2


def test_filters_on_blocks_come_before_the_other_columns(spark):
    for table in (chain.transactions(spark, SF), chain.logs(spark, SF)):
        plan = table.where("chain_id = 1 AND block_number < 5")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate inline") < plan.index("Filter")  # the filter lies below
