"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pin, read

# The base patterns, and the least length of what they must hold.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run below the least length can't contain a longer one, so these find the long runs at once
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs of the letters of common encodings, long enough to be tested.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order in which they are inferred: pattern, alphabet, and the chance that two characters of
#: structured text (identifiers, paths, dates) in these letters are equal.
ENCODINGS = (
    (r"^[0-9]+$", "0123456789", 0.12),
    (r"^[0-9a-f]+$", "0123456789abcdef", 0.12),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.12),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.07),
    (r"^[A-Za-z0-9]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.055),
    (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055),
    (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.055),
    (r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/", 0.055),
)
#: Lower ends of the length bands within which the false-discovery rate is held.
BANDS = (20, 24, 32, 48, 64, 128)
#: Share of false finds in a band; level at which a string counts as not random.
RATE, LEVEL = 0.05, 0.001


#: Elements that one fold of a running sum takes.
BLOCK = 128
NONE = "CAST(array() AS array<struct<start:int,end:int,hit:string,value:string>>)"


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """The array ``made(value)``, for which ``value`` is computed once, however often it is used."""
    return F.flatten(F.transform(F.array(value), made))


def running(numbers: Column) -> Column:
    """Running sums of an array<int>. A fold copies what it has at each step, so it runs over blocks and over their sums."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.expr("CAST(array() AS array<int>)"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def last(acc: Column) -> Column:
        return F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs), F.lit(1)) - 1, F.lit(BLOCK)), lambda at: sums(F.slice(xs, at + 1, BLOCK)))

    def whole(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), sums(F.transform(parts, last)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda part, at: F.transform(part, lambda x: x + at)))

    return bound(bound(numbers, blocks), whole)


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches as array<struct<start, end, hit, value>>; code points, end exclusive.

    The gaps between matches and the matches, in turn, give the offsets. Text without a match is not split.
    """
    groups = 2 if pattern == ASSIGN else 0
    hits, value, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)), F.split(text, pattern)
    met = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("value")), lambda x: x["hit"].isNotNull())

    def placed(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return F.zip_with(all_, ends, lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value")))

    return F.when(F.rlike(text, F.lit(pattern)), bound(met, placed)).otherwise(F.expr(NONE))


def spans_of(text: Column, kind: str) -> Column:
    """Base spans of one kind: matches of the pattern that are long enough."""
    hits = F.filter(found(text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX}[kind]), lambda x: F.length(x["value"]) >= LEAST[kind])
    rank = KINDS.index(kind)
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    if kind != "assign":
        return spans
    # most texts hold none of the words, which is quicker to see than a failed match at each character
    low = F.lower(text)
    worth = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return F.when(worth, spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int>>)"))


def joined(spans: Column) -> Column:
    named = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(named, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by a rational approximation (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-a * a / 2) / (2 * 3.141592653589793) ** 0.5
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(strings: DataFrame) -> DataFrame:
    """``strings`` (token, ...) with encoding, letters, p_uniform, p_runs, p_serial (random until shown otherwise) and p_structured.

    p_uniform: chi-squared test of uniformity over the alphabet of the inferred encoding. p_runs: Wald-Wolfowitz test of
    the halves of the alphabet. p_serial: correlation of neighbours. p_structured: how likely structured text of this
    length and encoding comes as near to uniformity; its spread narrows with length, which makes it length-aware.
    """
    pick = lambda what: F.coalesce(*[F.when(F.rlike("token", F.lit(e[0])), F.lit(what(e))) for e in ENCODINGS])
    x = pin(strings, encoding=pick(ENCODINGS.index), alphabet=pick(lambda e: e[1]), same=pick(lambda e: e[2]), body=F.regexp_replace("token", "=+$", ""))
    x = pin(x, n=F.length("body").cast("double"), k=F.length("alphabet").cast("double"), chars=F.expr("filter(split(body, ''), c -> c <> '')"))
    x = pin(x, at=F.expr("transform(chars, c -> instr(alphabet, c) - 1)"), squares=F.expr("aggregate(array_distinct(chars), 0D, (s, c) -> s + pow(length(body) - length(replace(body, c, '')), 2))"))
    x = pin(
        x,
        chi2=F.col("k") / F.col("n") * F.col("squares") - F.col("n"),
        high=F.expr("aggregate(at, 0D, (s, v) -> s + if(2 * v >= k, 1, 0))"),
        runs=F.expr("1D + size(filter(sequence(1, size(at) - 1), i -> (2 * at[i] >= k) <> (2 * at[i - 1] >= k)))"),
        mean_at=F.expr("aggregate(at, 0D, (s, v) -> s + v) / n"),
    )
    low = F.col("n") - F.col("high")
    x = pin(
        x,
        spread=F.expr("aggregate(at, 0D, (s, v) -> s + pow(v - mean_at, 2))"),
        joint=F.expr("aggregate(sequence(1, size(at) - 1), 0D, (s, i) -> s + (at[i] - mean_at) * (at[i - 1] - mean_at))"),
        mean_runs=2 * F.col("high") * low / F.col("n") + 1,
    )
    df = F.col("k") - 1
    x = pin(
        x,
        var_runs=(F.col("mean_runs") - 1) * (F.col("mean_runs") - 2) / (F.col("n") - 1),
        z_uniform=(F.pow(F.greatest(F.col("chi2"), F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        z_serial=F.when(F.col("spread") > 0, F.abs(F.col("joint") / F.col("spread")) * F.sqrt("n")),
    )
    x = pin(x, z_runs=F.when(F.col("var_runs") > 0, F.abs(F.col("runs") - F.col("mean_runs")) / F.sqrt("var_runs")))
    excess = F.col("k") * F.col("same") - 1
    mean = F.col("k") + F.col("k") * (F.col("n") - 1) * F.col("same") - F.col("n")
    x = pin(x, z_structured=(mean - F.col("chi2")) / F.sqrt(2 * df + 4 * (F.col("n") - 1) * excess))
    two_sided = lambda z: F.when(F.col(z).isNull(), 0.0).otherwise(2 * upper_tail(F.col(z)))
    return x.select(
        *strings.columns, "encoding", "chi2", upper_tail(F.col("z_uniform")).alias("p_uniform"), two_sided("z_runs").alias("p_runs"), two_sided("z_serial").alias("p_serial"), upper_tail(F.col("z_structured")).alias("p_structured")
    )


def controlled(tested: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """The rows of ``tested`` (length, p_*) that count as random: Benjamini-Hochberg on p_structured within each length band.

    All candidates of a band count as tests. Ranks come from a histogram of -log10 p (bins of 0.05, at most 400 a
    band), so no sort of the candidates is needed; a bin passes by its upper edge, which only errs to the safe side.
    """
    band = F.coalesce(*[F.when(F.col("length") >= b, F.lit(b)) for b in reversed(BANDS)], F.lit(0))
    binned = tested.withColumn("band", band).withColumn("p_bin", F.least(F.lit(400), F.floor(-F.log10(F.greatest("p_structured", F.lit(1e-20))) * 20)).cast("int"))
    hist = binned.groupBy("band", "p_bin").agg(F.count(F.lit(1)).alias("m"))
    above = W.partitionBy("band").orderBy(F.desc("p_bin"))
    cuts = hist.withColumn("rank", F.sum("m").over(above)).withColumn("all", F.sum("m").over(W.partitionBy("band")))
    cuts = cuts.where(F.pow(F.lit(10.0), -F.col("p_bin") / 20) <= rate * F.col("rank") / F.col("all")).groupBy("band").agg(F.min("p_bin").alias("least_bin"))
    # at most one row for each band
    kept = binned.join(F.broadcast(cuts), "band").where(F.col("p_bin") >= F.col("least_bin"))
    return kept.where(F.least("p_uniform", "p_runs", "p_serial") >= level / 3)


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Offsets are code points, ends exclusive. A random string that overlaps a base span adds none. Every run of CANDIDATE
    is tested, and the false-discovery control alone decides. Null and empty texts have no spans; repeated rows are
    scanned each for itself; an empty table gives an empty result; other columns are ignored. Texts of any length are
    scanned whole, in time that grows with their length (running sums in blocks: n * BLOCK + (n / BLOCK)^2 copies for n
    matches of a text).
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scanned = rows.select(
        "doc_id",
        *[spans_of(F.col("text"), k).alias(k) for k in KINDS[:3]],
        F.transform(found(F.col("text"), CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("token"))).alias("worth"),
    ).withColumn("row_id", F.monotonically_increasing_id())
    scanned = cut(scanned, "secrets-scanned")  # texts are read once; row ids are fixed from here on
    base = F.concat("assign", "access", "hex")
    worth = scanned.where(F.size("worth") > 0)
    plain = worth.where(F.size(base) == 0).select("row_id", F.explode("worth").alias("c")).select("row_id", "c.*")
    tested = cut(randomness(plain.unionByName(apart(worth.where(F.size(base) > 0), base))).withColumn("length", F.length("token")).drop("token"), "secrets-tested")
    more = controlled(tested, rate).groupBy("row_id").agg(F.collect_list(F.struct(F.col("start"), F.lit(3).alias("rank"), F.col("end"))).alias("random"))
    out = scanned.drop("worth").join(more, "row_id", "left").withColumn("random", F.coalesce("random", F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int>>)")))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("random"))).alias("spans"),
    )


def apart(rows: DataFrame, base: Column) -> DataFrame:
    """(row_id, start, end, token): the candidates of ``rows`` that no base span overlaps.

    Of the base spans that begin before a candidate ends, the furthest end decides: one pass over both in order.
    """
    bases = rows.select("row_id", F.explode(base).alias("b")).select("row_id", F.col("b.start").alias("at"), F.lit(1).alias("later"), F.col("b.end").alias("reach"), F.expr("CAST(NULL AS struct<start:int,end:int,token:string>)").alias("c"))
    asked = rows.select("row_id", F.explode("worth").alias("c")).select("row_id", F.col("c.end").alias("at"), F.lit(0).alias("later"), F.lit(0).alias("reach"), "c")
    order = W.partitionBy("row_id").orderBy("at", "later").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = bases.unionByName(asked).withColumn("furthest", F.max("reach").over(order))
    return both.where("c IS NOT NULL AND furthest <= c.start").select("row_id", "c.*")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
