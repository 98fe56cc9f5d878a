"""Data sources over an injected transport: logs of block ranges as a batch, finalized heads as a stream.

``spark.dataSource.register(log_source(fetch))``, then ``spark.read.format("ranged_logs")``; likewise ``head_source`` and
``spark.readStream.format("finalized_heads")``. A transport is pickled and called in tasks (of heads: beside the driver).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from blockweft.sources.rpc import Fetch, halved

SPAN = 1024


class NoAnswer(Exception):
    """The source of one chain doesn't answer; other chains go on."""


@dataclass
class Request(InputPartition):
    chain_id: int
    low: int
    high: int
    addresses: list[str]
    topics: list[str]


class LogReader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict[str, str]) -> None:
        self.fetch, self.span = fetch, int(options.get("span", SPAN))
        self.ranges, self.groups = json.loads(options["ranges"]), json.loads(options["groups"])
        if self.span < 1:
            raise ValueError("span must be 1 or more")
        self.low, self.high, self.chains = None, None, None

    def partitions(self) -> list[Request]:
        out = []
        for r in self.ranges:
            if self.chains is not None and r["chain_id"] not in self.chains:
                continue
            low = r["from_block"] if self.low is None else max(r["from_block"], self.low)
            high = r["to_block"] if self.high is None else min(r["to_block"], self.high)
            for g in self.groups:
                if g["chain_id"] == r["chain_id"]:
                    out += [Request(r["chain_id"], k, min(k + self.span - 1, high), g["addresses"], g["topics"]) for k in range(low, high + 1, self.span)]
        return out

    def read(self, partition: Request | InputPartition) -> Iterator[tuple[int, int | None, str]]:
        if not isinstance(partition, Request):  # Spark plans one part of its own where there is none
            return
        for low, high, lines in halved(self.fetch, partition.chain_id, partition.low, partition.high, partition.addresses, partition.topics):
            request = {"chain_id": partition.chain_id, "from_block": low, "to_block": high}
            for line in lines:
                for log in json.loads(line)["result"]:
                    yield partition.chain_id, _number(log.get("blockNumber")), json.dumps({"request": request, "result": [log]})


class NarrowedReader(LogReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; elsewhere Spark takes no reader that narrows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of chain_id and block_number narrow what is asked for. All filters are returned, so Spark applies
        them too: an answer may hold logs of other blocks than asked for."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("chain_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chains = wanted if self.chains is None else self.chains & wanted
            elif column == ("block_number",):
                if isinstance(f, EqualTo):
                    self._narrow(f.value, f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self._narrow(f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self._narrow(None, f.value - isinstance(f, LessThan))
            yield f

    def _narrow(self, low: int | None, high: int | None) -> None:
        self.low = low if self.low is None else self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)


def _number(text: object) -> int | None:
    """A hex quantity below 2^63, or None."""
    try:
        n = int(text, 16) if isinstance(text, str) and text.startswith("0x") else -1
    except ValueError:
        return None
    return n if 0 <= n < 1 << 63 else None


def log_source(fetch: Fetch, narrowed: bool = False) -> type[DataSource]:
    """The format ``ranged_logs``: (chain_id, block_number, value), a row a log, whose value is for ``rpc.logs_of``.

    Options: ``ranges`` (JSON list of chain_id, from_block, to_block), ``groups`` (JSON list of chain_id, addresses,
    topics; hex without 0x) and ``span``, the most blocks of a first request. Each range of that length of each group is
    one task, repeated whole when its executor is lost. No ranges or groups: no rows. A response without a result is an
    error. ``narrowed``: filters of chain_id and block_number narrow the ranges (see NarrowedReader). Options come from
    the driver, so this fits plans of bounded size; ``rpc.fetched_logs`` takes tables.
    """

    class Logs(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ranged_logs"

        def schema(self) -> str:
            return "chain_id long, block_number long, value string"

        def reader(self, schema: object) -> DataSourceReader:
            return (NarrowedReader if narrowed else LogReader)(fetch, self.options)

    return Logs


def ranged_logs(spark: SparkSession, fetch: Fetch, ranges: list[dict], groups: list[dict], span: int = SPAN) -> DataFrame:
    """The rows of ``log_source(fetch)`` for ranges and groups."""
    narrowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(log_source(fetch, narrowed))
    return spark.read.format("ranged_logs").options(ranges=json.dumps(ranges), groups=json.dumps(groups), span=str(span)).load()


@dataclass
class Head(InputPartition):
    chain_id: int
    finalized_head: int


class HeadReader(DataSourceStreamReader):
    """Offsets are the heads themselves, so a batch that is replayed has the same rows whatever the sources say by then."""

    def __init__(self, head: Callable[[int], int], chains: list[int]) -> None:
        self.head, self.chains = head, chains
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for c in self.chains:
            try:
                self._learn({str(c): int(self.head(c))})
            except NoAnswer:
                continue
        return dict(self.known)

    def _learn(self, heads: dict[str, int]) -> None:
        # a source that lags behind another doesn't take a finalized head back
        for c, n in heads.items():
            self.known[c] = max(n, self.known.get(c, n))

    def partitions(self, start: dict, end: dict) -> list[Head]:
        self._learn(start)
        self._learn(end)
        return [Head(int(c), n) for c, n in sorted(end.items()) if n > start.get(c, -1)]

    def read(self, partition: Head) -> Iterator[tuple[int, int]]:
        yield partition.chain_id, partition.finalized_head


def head_source(head: Callable[[int], int]) -> type[DataSource]:
    """The stream format ``finalized_heads``: (chain_id, finalized_head), a row for each chain whose head moved on.

    Option ``chains``: a JSON list of chain ids. ``head(chain_id)`` gives a number or raises NoAnswer, which leaves the
    chain out until it answers; any other error fails the query.
    """

    class Heads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "finalized_heads"

        def schema(self) -> str:
            return "chain_id long, finalized_head long"

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return HeadReader(head, json.loads(self.options["chains"]))

    return Heads


def finalized_heads(spark: SparkSession, head: Callable[[int], int], chains: list[int]) -> DataFrame:
    """The stream of ``head_source(head)`` for chains."""
    spark.dataSource.register(head_source(head))
    return spark.readStream.format("finalized_heads").option("chains", json.dumps(chains)).load()
