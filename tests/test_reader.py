"""Data sources over a transport: ranges that are halved, filters that narrow them, heads as a stream."""

import json

import pytest

from blockweft.operators import match, publish
from blockweft.queries import only
from blockweft.sources import reader, rpc
from blockweft.streaming.index import index_step, run_stream
from tests.test_index import rows, tables

GROUPS = [{"chain_id": c, "addresses": ["ab" * 20], "topics": ["cd" * 32]} for c in (1, 2)]


def provider(longest, folder=None):
    """Three logs in every block; notes what it was asked for in ``folder``."""

    def fetch(chain_id, low, high, addresses, topics):
        if folder:
            open(f"{folder}/{chain_id}-{low}-{high}", "w").close()
        if high - low >= longest:
            raise rpc.RangeLimit
        log = {"address": "0x" + addresses[0], "topics": ["0x" + topics[0]], "data": "0x", "transactionHash": "0x" + "ab" * 32, "removed": False}
        return [json.dumps({"result": [log | {"blockNumber": hex(b), "logIndex": hex(k)} for b in range(low, high + 1) for k in range(3)]})]

    return fetch


def ranges(*each):
    return [{"chain_id": c, "from_block": a, "to_block": b} for c, a, b in each]


def test_the_source_equals_the_table_of_windows(spark):
    asked = [(1, 10, 99), (2, 0, 0), (2, 5, 41)]
    logs = rpc.logs_of(reader.ranged_logs(spark, provider(4), ranges(*asked), GROUPS, span=16))
    windows = spark.createDataFrame(asked, "chain_id long, from_block long, to_block long")
    groups = spark.createDataFrame([(c, [bytes.fromhex("ab" * 20)], [bytes.fromhex("cd" * 32)]) for c in (1, 2)], "chain_id long, addresses array<binary>, topics array<binary>")
    # the table's transport tells no range, so only the logs are compared
    key = ["block_number", "log_index", "tx_hash", "address", "topics", "data", "removed"]
    batch = rpc.logs_of(rpc.fetched_logs(windows, groups, provider(4)))
    assert logs.count() == 3 * (90 + 1 + 37)
    assert sorted(map(str, logs.select(*key).collect())) == sorted(map(str, batch.select(*key).collect()))
    assert logs.where("block_number NOT BETWEEN first_block AND last_block OR last_block - first_block > 3").count() == 0


def test_a_single_block_beyond_the_limit_is_an_error(spark):
    with pytest.raises(Exception, match="RangeLimit"):
        reader.ranged_logs(spark, provider(0), ranges((1, 0, 3)), GROUPS).collect()


def test_nothing_asked_for_and_broken_answers(spark):
    assert reader.ranged_logs(spark, provider(9), [], GROUPS).count() == 0
    assert reader.ranged_logs(spark, provider(9), ranges((1, 0, 3)), []).count() == 0
    assert reader.ranged_logs(spark, provider(9), ranges((1, 3, 2)), GROUPS).count() == 0
    odd = [None, "0x", "7", "0xzz", "0x8000000000000000", "0x7"]
    found = reader.ranged_logs(spark, lambda *a: [json.dumps({"result": [{"blockNumber": n} for n in odd] + [{}]})], ranges((1, 7, 7)), GROUPS)
    assert sorted(str(r.block_number) for r in found.collect()) == ["7"] + ["None"] * 6
    with pytest.raises(Exception, match="KeyError"):
        reader.ranged_logs(spark, lambda *a: [json.dumps({"error": "busy"})], ranges((1, 7, 7)), GROUPS).collect()
    with pytest.raises(Exception, match="span"):
        reader.ranged_logs(spark, provider(9), [], GROUPS, span=0).collect()


def test_filters_narrow_what_is_asked_for(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        logs = reader.ranged_logs(spark, provider(99, str(tmp_path)), ranges((1, 0, 999), (2, 0, 999)), GROUPS, span=10)
        found = logs.where("chain_id = 1 AND block_number >= 15 AND block_number < 38")
        assert found.count() == 3 * 23
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1-15-24", "1-25-34", "1-35-37"]


def told(path):
    """Heads that a file holds; a chain that it lacks doesn't answer."""

    def head(chain_id):
        with open(path) as f:
            heads = json.load(f)
        if str(chain_id) not in heads:
            raise reader.NoAnswer
        return heads[str(chain_id)]

    return head


def test_heads_drive_the_step(spark, tmp_path):
    path, monitors, root = tmp_path / "heads.json", only(1, 9), f"{tmp_path}/store"
    seen = []

    def run(heads):
        path.write_text(json.dumps(heads))
        step = index_step(root, tables, lambda: monitors, 10_000)

        def both(df, n):
            seen.append((n, sorted(tuple(r) for r in df.collect())))
            step(df, n)

        run_stream(reader.finalized_heads(spark, told(str(path)), [1, 8453]), both, f"{tmp_path}/check").awaitTermination()

    run({1: 40, 8453: 7})
    run({1: 120})  # the other chain doesn't answer
    run({1: 90, 8453: 9})  # this one lags
    run({1: 300, 8453: 9})
    assert [new for _, new in seen if (1, 120) in new or (1, 300) in new] == [[(1, 120)], [(1, 300)]]
    assert {c: max(h for _, new in seen for k, h in new if k == c) for c in (1, 8453)} == {1: 300, 8453: 9}
    assert rows(publish.visible(spark, root)) == rows(match.indexed(*tables(spark), monitors).where("block_number <= 300"))


def test_a_replayed_batch_has_the_same_heads():
    stream = reader.HeadReader(lambda c: 5, [1, 2])
    first = stream.latestOffset()
    assert first == {"1": 5, "2": 5}
    later = reader.HeadReader(lambda c: 3, [1, 2])
    parts = later.partitions({"1": 5}, {"1": 5, "2": 5})
    assert [(p.chain_id, p.finalized_head) for p in parts] == [(2, 5)] and list(later.read(parts[0])) == [(2, 5)]
    assert later.latestOffset() == {"1": 5, "2": 5}
