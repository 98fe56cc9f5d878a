"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, pin, read

#: Template words in a window; every window of a document is looked up.
WINDOW = 6
#: Share of an item's windows that a leak contains, and the share of slots that may contradict the others.
COVERAGE, CONFLICT = 0.5, 0.2
#: Items of fewer words can't be told from ordinary text and are not looked for.
SHORTEST = 4

# Marks of the typed placeholders (private use characters), numbers, units after a number.
NUM, NAME, UNIT = "", "", ""
NUMBER = r"(?<![\p{L}\p{N}.,:/+-])[+-]?\p{Nd}+(?:[.,:/]\p{Nd}+)*"
UNITS = r"(?:km|cm|mm|m|mi|miles?|metres?|meters?|feet|ft|inch(?:es)?|kg|g|mg|grams?|lbs?|pounds?|tons?|l|ml|lit(?:re|er)s?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?|kwh|kw|w|v|hz|mb|gb|tb|mph|kmh)"
#: All words that UNITS has.
UNIT_WORDS = frozenset("km cm mm m mi mile miles metre metres meter meters foot feet ft inch inches kg g mg gram grams lb lbs pound pounds ton tons l ml liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees kwh kw w v hz mb gb tb mph kmh".split())
#: A capitalised word, or up to seven, within a sentence: after a lower case letter or comma and a space.
PROPER = r"(?<=[\p{Ll},;] )\p{Lu}\p{L}*(?: \p{Lu}\p{L}*){0,6}"
#: A capitalised word elsewhere, as at the start of a sentence, line or quotation, and the capitalised words behind it;
#: marks of such a word, and of one with others behind it; words that no name is.
OPENER = r"(?<![\p{L}\p{N}])(?<![\p{Ll},;] )(\p{Lu}\p{Ll}+)((?: \p{Lu}\p{L}*){0,6})"
OPEN, REST = "\ue0f0", "\ue0f1"
COMMON = frozenset(
    "a about after all also although an and any are as at because before both but by can could did do does during each either every first find for from given had has have he her here his how i if in is it its let many most my no not now of on once one only or our over please same second she should since so some such than that the their then there these they this those three to two under until was we were what when where which while who whose why will with would yes you your "
    "als auch auf aus bei das dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist man mit nach nicht nun ob oder sie sind so und von vor wann warum was welche welcher welches wenn wer wie wir wo zu zum zur "
    "au aux avec ce cela ces cet cette chaque comment comme dans de des donc du elle elles en est et il ils je la le les leur lorsque mais nous on ou où par pour pourquoi quand que quel quelle quelles quels qui sa ses si son sont sur tous toutes un une vous "
    "al cada como con cuando cuál cuáles cuántas cuántos cuánto cómo cuándo del donde dónde el ella ellos en es esta este esto están está la las lo los más no nos o para pero por porque qué que quién se según si sin sobre son su sus todos un una unas unos y yo".split()
)


def vocabulary(items: DataFrame) -> tuple[list[str], list[str]]:
    """Words that open sentences of ``items`` (text) and count as names, and all other words of the items, lower case.

    An opening word is a name unless the items have it in lower case or it is one of COMMON. Both lists are no longer
    than the benchmark's vocabulary.
    """
    words = {r[0] for r in items.select(F.explode(F.split("text", r"[^\p{L}\p{N}]+"))).distinct().collect()} - {""}
    opening = {r[0].lower() for r in items.select(F.explode(F.regexp_extract_all("text", F.lit(OPENER), F.lit(1)))).distinct().collect()}
    names = opening - {w for w in words if w[0].islower()} - COMMON
    return sorted(names), sorted({w.lower() for w in words} - names | COMMON)


def marked_words(text: Column, names: tuple[list[str], list[str]] = ([], [])) -> Column:
    """Words of a text, lower case without punctuation; numbers, names and units carry their mark before the value.

    A value keeps its inner points and commas, so "3.5" is one word. Names of several words are one word. ``names`` is
    the items' ``vocabulary``: its names are names wherever they stand, in any case; of other words that open a sentence
    those that the items have are words, and all others names, as no item can have them as words.
    """
    t = F.translate(F.coalesce(text, F.lit("")), NUM + NAME + UNIT + OPEN + REST, "")
    t = F.regexp_replace(t, OPENER, f" {OPEN}$0{REST} ")
    t = F.regexp_replace(t, f" (?=\\p{{Lu}})(?<={OPEN}[\\p{{L}} ]{{1,400}})", ".")
    t = F.regexp_replace(t, PROPER, f"{NAME}$0{REST} ")
    t = F.regexp_replace(t, f"({NUMBER})\\s?(?i:({UNITS})(?![\\p{{L}}\\p{{N}}]))", f" {NUM}$1 {UNIT}$2 ")
    t = F.regexp_replace(t, f"(?<!{NUM})(?<![\\p{{L}}\\p{{N}}.,:/{NUM}{NAME}{UNIT}+-])({NUMBER[NUMBER.index('[+-]'):]})", f" {NUM}$1 ")
    # the words of a name stay together: a space between its capitals becomes a point
    t = F.regexp_replace(t, f" (?=\\p{{Lu}})(?<={NAME}[\\p{{L}} ]{{1,400}})", ".")
    words = F.split(F.lower(t), r"[^\p{L}\p{N}.,:/+\-" + NUM + NAME + UNIT + OPEN + "]+")

    def opened(w: Column) -> Column:
        value = F.regexp_replace(F.substring(w, 2, 1 << 30), r"[.,:/+\-]+$", "")
        head = F.substring_index(value, ".", 1)
        rest = F.substring(value, F.length(head) + 2, F.length(value))
        return F.when(~head.isin(names[1]), F.concat(F.lit(NAME), value)).when(rest == "", head).otherwise(F.concat(head, F.lit(f" {NAME}"), rest))

    words = F.transform(words, lambda w: F.when(w.startswith(OPEN), opened(w)).otherwise(w))
    words = F.flatten(F.transform(words, lambda w: F.split(w, " ")))
    words = F.transform(words, lambda w: F.when(F.rlike(w, F.lit(f"^[{NUM}{NAME}{UNIT}]")), F.regexp_replace(w, r"[.,:/+\-]+$", "")).otherwise(F.regexp_replace(w, r"[.,:/+\-]", " ")))
    words = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, " "))), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.isin(names[0]), F.concat(F.lit(NAME), w)).otherwise(w))


def template(words: Column) -> Column:
    """The placeholder in place of each marked word."""
    return F.transform(words, lambda w: F.when(F.rlike(w, F.lit(f"^[{NUM}{NAME}{UNIT}]")), F.substring(w, 1, 1)).otherwise(w))


def template_words(text: Column, names: tuple[list[str], list[str]] = ([], [])) -> Column:
    """The template's words, for whole corpora: like ``template(marked_words(text, names))`` without the values."""
    t = unmarked(text)
    t = F.regexp_replace(t, OPENER.replace("{0,6}", "{1,6}"), f" {OPEN}$1{REST} ")
    t = F.regexp_replace(t, f"(?<!{OPEN})" + OPENER, f" {OPEN}$1 ")
    t = F.regexp_replace(t, PROPER, f" {NAME} ")
    t = F.regexp_replace(t, NUMBER, f" {NUM} ")
    t = F.regexp_replace(t, f"{NUM} \\s?(?i:{UNITS})(?![\\p{{L}}\\p{{N}}])", f"{NUM} {UNIT} ")
    words = F.split(F.lower(t), r"[^a-z0-9\p{L}\p{N}" + NUM + NAME + UNIT + OPEN + REST + "]+")  # ASCII first, for speed

    def shown(w: Column) -> Column:
        head = F.translate(w, OPEN + REST, "")
        known, name = head.isin(names[1]), F.lit(NAME)
        return F.when(w.startswith(OPEN), F.when(~known, F.array(name)).when(w.endswith(REST), F.array(head, name)).otherwise(F.array(head))).when(w.isin(names[0]), F.array(name)).otherwise(F.array(w))

    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), shown))


def template_hashes(text: Column, names: tuple[list[str], list[str]] = ([], [])) -> Column:
    """Hashes of ``template_words``."""
    return F.transform(template_words(text, names), lambda w: F.xxhash64(w))


def unmarked(text: Column) -> Column:
    """A text, null as empty, without the marks of opening words."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(OPEN) | t.contains(REST), F.translate(t, OPEN + REST, "")).otherwise(t)


def thinned(text: Column, known: list[str], least: int) -> Column:
    """A text with the same windows of ``known`` words, of ``least`` words or more, and far fewer others.

    ``known`` are the lower case words that windows may have, besides placeholders, and those that become placeholders.
    Any other word of small letters alone is in no such window. It becomes a gap, a word that is not known either, with a
    point where it ends a sentence; of the words before and behind it that is all that names, numbers and units look
    at. Gaps with fewer than ``least`` words of one capital at most between them become one.
    """
    gap = next(g for n in count(1) if (g := "x" * n) not in known)
    ends = "[.,;:!?]"

    def kept(w: Column) -> Column:
        bare = F.regexp_replace(w, rf"{ends}+\z", "")
        other = F.rlike(w, F.lit(rf"^[a-z\p{{Ll}}]+{ends}+\z")) & ~bare.isin(known)
        return F.when(w.isin(known), w).when(F.rlike(w, F.lit(r"^[a-z\p{Ll}]+\z")), gap).when(other, F.when(F.rlike(w, F.lit(r"[,;]\z")), gap).otherwise(f"{gap}.")).otherwise(w)

    t = F.array_join(F.transform(F.split(unmarked(text), " "), kept), " ")
    # a capital that two characters are the small form of would make two words; possessive, as long runs are to take no stack
    between = rf"(?:[|\"'(\[]*[\p{{Lu}}&&[^İ]]?[a-z\p{{Ll}}]*[|\"')\].,;:!?]* ){{0,{least - 1}}}"
    return F.regexp_replace(t, rf"(?<![^ ]){gap}\.?(?: {between}({gap}\.?)(?![^ ]))++", "$1")


def windows(hashes: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` words at each position."""
    last = F.size(hashes) - width
    starts = F.when(last < 0, F.expr("CAST(array() AS array<int>)")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def compare(pairs: DataFrame, width: Column, coverage: float = COVERAGE, conflict: float = CONFLICT) -> DataFrame:
    """``pairs`` (item_words, doc_words, ...) with coverage, n_slots, n_changed and n_conflicts.

    coverage: share of the item's template windows that the document contains; a window of placeholders alone says
    nothing of the item, so such windows are met with their values. Slots are the marked words of matched windows, each
    with the value in the item and the one in the document; a conflict is an item value that maps to several document
    values of its type. A window that the document has several times is taken at its first place. If that gives
    conflicts, the alignment (document position minus item position) that most places have, the first of equal ones, is
    tried as well: windows are taken nearest to it, at most a window off, at most the item's length off, or anywhere. Of
    these readings the best counts: one that is a leak, then the largest coverage, then the fewest conflicts. The work
    is linear in the places.
    """
    x = pin(pairs.withColumn("_w", width), _item_t=template(F.col("item_words")), _doc_t=template(F.col("doc_words")))
    hashes = "transform({0}, w -> xxhash64(w))"
    x = pin(x, **{f"_{side}_{to}": F.expr(hashes.format(of)) for side in ("item", "doc") for to, of in (("h", f"_{side}_t"), ("v", f"{side}_words"))})
    flags = f"transform({{0}}, w -> if(w IN ('{NUM}', '{NAME}', '{UNIT}'), 0, 1))"
    x = pin(x, _item_f=F.expr(flags.format("_item_t")), _doc_f=F.expr(flags.format("_doc_t")))
    cells = "if(size({0}_h) < _w, CAST(array() AS array<bigint>), transform(sequence(0, greatest(size({0}_h) - _w, 0)), i -> if(array_contains(slice({0}_f, i + 1, _w), 1), xxhash64(slice({0}_h, i + 1, _w)), xxhash64(slice({0}_v, i + 1, _w), 1))))"
    x = pin(x, _item_win=F.expr(cells.format("_item")), _doc_win=F.expr(cells.format("_doc")))
    x = pin(x, _hits=F.expr("filter(transform(_doc_win, (h, p) -> struct(h AS h, p AS p)), x -> array_contains(_item_win, x.h))"))
    x = pin(x, _at=F.expr("filter(transform(_item_win, (h, i) -> struct(i AS i, transform(filter(_hits, x -> x.h = h), x -> x.p) AS ps)), m -> size(m.ps) > 0)"))
    slot = f"^[{NUM}{NAME}{UNIT}]"

    def read_as(x: DataFrame, name: str, met: str) -> DataFrame:
        """``x`` with column ``name``: the readings, best last in order, of the array ``met`` of arrays of places (i, p)."""
        slots = f"array_distinct(filter(flatten(transform(y, m -> transform(sequence(0, _w - 1), k -> struct(item_words[m.i + k] AS a, doc_words[m.p + k] AS b)))), s -> s.a rlike '{slot}'))"
        x = pin(x, _read=F.expr(f"transform({met}, y -> struct(size(y) / greatest(size(_item_win), 1) AS coverage, {slots} AS slots))"))
        x = pin(x, _read=F.expr("transform(_read, y -> struct(y.coverage AS coverage, size(array_distinct(transform(y.slots, s -> s.a))) AS n, size(y.slots) AS m, size(filter(y.slots, s -> s.a <> s.b)) AS changed))"))
        return pin(x, **{name: F.expr(f"array_max(transform(_read, y -> struct(y.coverage >= {coverage} AND y.m - y.n <= {conflict} * y.n AS leak, y.coverage AS coverage, y.n - y.m AS agreed, y.n AS n, -y.changed AS same)))")})

    x = read_as(x, "_first", "array(transform(_at, m -> struct(m.i AS i, m.ps[0] AS p)))")
    x = pin(x, _votes=F.expr("if(_first.agreed = 0, CAST(array() AS array<int>), array_sort(flatten(transform(_at, m -> transform(m.ps, p -> p - m.i)))))"))
    # equal ones stand together: the longest run wins
    run = "named_struct('a', v, 'n', if(s.a = v, s.n + 1, 1), 'best', if(if(s.a = v, s.n + 1, 1) > s.most, v, s.best), 'most', greatest(if(s.a = v, s.n + 1, 1), s.most))"
    start = "named_struct('a', CAST(NULL AS int), 'n', 0, 'best', CAST(NULL AS int), 'most', 0)"
    x = pin(x, _lines=F.expr(f"if(size(_votes) = 0, CAST(array() AS array<int>), array(aggregate(_votes, {start}, (s, v) -> {run}, s -> s.best)))"))
    near = "array_min(filter(transform(m.ps, p -> struct(abs(p - m.i - a) AS d, p AS p)), z -> z.d <= r))"
    taken = f"transform(filter(transform(_at, m -> struct(m.i AS i, {near} AS z)), m -> m.z IS NOT NULL), m -> struct(m.i AS i, m.z.p AS p))"
    x = read_as(x, "_other", f"flatten(transform(_lines, a -> transform(array(_w, size(item_words), {2**31 - 1}), r -> {taken})))")
    x = pin(x, _best=F.expr("greatest(_first, _other)"))
    x = x.select("*", F.col("_best.coverage").alias("coverage"), F.col("_best.n").alias("n_slots"), (-F.col("_best.same")).alias("n_changed"), (-F.col("_best.agreed")).alias("n_conflicts"))
    return x.drop(*[c for c in x.columns if c.startswith("_")])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, conflict: float = CONFLICT) -> DataFrame:
    """The leaked items: doc_id, item_id, coverage, n_slots, n_changed, one row for each document and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. A document leaks an item if it contains ``coverage``
    of the item's template windows (``compare``) and at most ``conflict`` of the item's slots contradict: so both the literal
    question and the question with other numbers, names or units are found. Items shorter than ``window`` are windows
    of their own length; those below SHORTEST words, null or empty are not looked for. Null and empty documents leak
    nothing; rows that repeat a doc_id count as one document, found if one of them leaks; equal items are each
    reported; an empty table gives an empty result; texts of any length are read whole; other columns are ignored.

    Words of small letters that no item has are gaps, which no window spans (``thinned``), so patterns and windows are
    worked out for what is left of a text. Every window of that meets the different windows of all items, at most once
    each, so what comes of it is no more than the documents' windows. A document that holds ``coverage`` of an item's windows holds one of its rarest
    as well, counted in the documents, once more than 1 - coverage of them are taken; only these lead to candidates, so
    windows of placeholders that many items and documents share are hardly ever followed. Items of one template are
    one for this search.
    """
    names = vocabulary(benchmark)
    items = benchmark.select("item_id", "text", marked_words(F.col("text"), names).alias("item_words"))
    items = pin(items, shown=template_words(F.col("text"), names))
    items = pin(items, h=F.transform("shown", lambda w: F.xxhash64(w))).where((F.size("h") >= SHORTEST) & (F.size("item_words") >= SHORTEST)).drop("text")
    # short items have a width of their own
    items = items.withColumn("width", F.least(F.size("h"), F.size("item_words"), F.lit(window)))
    items = cut(items.withColumn("template", F.xxhash64("width", "h")), "leak-items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``window``
    if not widths:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, n_slots int, n_changed int")
    each = [items.where(F.col("width") == w).dropDuplicates(["template"]).select("template", F.explode(windows(F.col("h"), w)).alias("window")) for w in widths]
    held = cut(reduce(DataFrame.unionByName, each).groupBy("template", "window").agg(F.count(F.lit(1)).alias("m")), "leak-windows")
    known = {r[0] for r in items.select(F.explode("shown")).distinct().collect()} | set(names[0]) | UNIT_WORDS
    thin = pin(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), thin=thinned(F.col("text"), sorted(known), widths[0])).drop("text")
    base = pin(thin, h=template_hashes(F.col("thin"), names)).drop("thin")
    seen = base.select("doc_id", F.explode(F.concat(*[windows(F.col("h"), w) for w in widths])).alias("window"))
    # the windows are a written table, whose size decides between a broadcast and a shuffle
    met = cut(seen.join(cut(held.select("window").distinct(), "leak-keys"), "window").distinct(), "leak-met")

    counts = met.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    ranked = W.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "window").rowsBetween(W.unboundedPreceding, -1)
    order = held.join(counts, "window", "left").withColumn("before", F.coalesce(F.sum("m").over(ranked), F.lit(0))).withColumn("all", F.sum("m").over(W.partitionBy("template")))
    rarest = cut(order.where((F.col("n") > 0) & (F.col("before") <= F.col("all") - F.ceil(F.col("all") * F.lit(float(coverage)) - 1e-9))).select("template", "window"), "leak-rarest")
    found = met.join(rarest, "window").select("doc_id", "template").distinct()
    candidates = cut(found.join(items.select("template", "item_id").distinct(), "template").select("doc_id", "item_id").distinct(), "leak-candidates")
    texts = docs.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id")
    texts = cut(texts.select("doc_id", marked_words(F.col("text"), names).alias("doc_words")), "leak-texts")
    pairs = texts.join(candidates, "doc_id").join(items.select("item_id", "item_words", "width"), "item_id")
    judged = compare(pairs, F.col("width"), coverage, conflict).where((F.col("coverage") >= coverage) & (F.col("n_conflicts") <= conflict * F.col("n_slots")))
    return judged.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """The documents that leak nothing, all columns; rows without a doc_id stay.

    Nulls, ties, repeated rows, empty tables and long texts are handled as in ``leaks``.
    """
    with Scratch() as held:
        found = cut(leaks(docs, benchmark, **how).select("doc_id").distinct(), "leak-found")
        held.keep(found)
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
