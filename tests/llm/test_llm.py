"""The training-data operators on small fixtures, against SQL or brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweft.llm import common, decontaminate, dedup_exact, html, jaccard, mixing, secrets, sharding, surrogates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long"


def documents(spark, texts):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, "x", 1) for k, t in enumerate(texts)], SCHEMA)


TEXTS = ["", None, "a", "a", "token = abcdef12", "the quick brown fox jumps over the lazy dog " * 4, "x " * 50_000, "été ñ", "a"]


def test_exact_dedup(spark):
    rows = {r.doc_id: r for r in dedup_exact.exact_dedup(documents(spark, TEXTS)).collect()}
    assert [rows[k].keep_id for k in range(9)] == [1, 1, 8, 8, 4, 5, 6, 7, 8]
    assert rows[2].group_size == 3 and not rows[2].kept and rows[8].kept
    assert rows[7].text_sha256 == hashlib.sha256("été ñ".encode()).hexdigest()


def test_exact_dedup_of_colliding_digests(spark):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))
    rows = {r.doc_id: r.keep_id for r in dedup_exact.exact_dedup(documents(spark, TEXTS), digest=weak).collect()}
    assert [rows[k] for k in range(9)] == [1, 1, 8, 8, 4, 5, 6, 7, 8]


def test_empty_tables(spark):
    none = documents(spark, ["a"]).limit(0)
    assert dedup_exact.exact_dedup(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert jaccard.similar_groups(none).count() == 0
    assert surrogates.pseudonymise(none).count() == 0
    assert sharding.place(none, sharding.shard_names()).count() == 0


def test_table_is_even_and_stable():
    before, after = sharding.fill(sharding.shard_names(16), 1009), sharding.fill(sharding.shard_names(15), 1009)
    shares = [before.count(k) for k in range(16)]
    assert max(shares) - min(shares) <= 1
    assert sum(a != b for a, b in zip(before, after)) < 1009 / 16 * 3


def test_secrets_and_random_strings(spark):
    key = hashlib.sha256(b"1").digest()
    import base64

    random_text = base64.b64encode(key).decode()
    texts = [f"x {random_text} y", "see /usr/share/documentation/html5/index/of/things2024 now", 'password: "hunter22"', None]
    rows = {r.doc_id: r for r in secrets.scan_secrets(documents(spark, texts)).collect()}
    assert rows[0].spans == f"random:2:{2 + len(random_text)}"
    assert rows[1].spans == "" and rows[3].spans == ""
    assert rows[2].spans == "assign:0:19" and rows[2].n_assign == 1


def test_leaks_and_other_numbers(spark):
    bench = spark.createDataFrame([(1, "A train travels 120 km in 3 hours and then stops for lunch near the old stone bridge of the town"), (2, None)], "item_id long, text string")
    texts = ["so: a train travels 95 km in 7 hours and then stops for lunch near the old stone bridge of the town. end", "a train stops for lunch", None, ""]
    found = decontaminate.leaks(documents(spark, texts), bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(0, 1)] and found[0].n_changed == 2


def test_edited_items_are_found_at_each_offset(spark):
    words = [f"{a}{b}" for a in ("lamp", "river", "stone") for b in ("er", "ing", "ed", "ly", "ness", "less")][:17]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join([*(f"pre{'abcdefgh'[n]}" for n in range(k)), *words[:8], *words[9:], *(f"post{c}" for c in "abcdefg")]) for k in range(8)]
    assert {r.doc_id: r.coverage for r in decontaminate.leaks(documents(spark, texts), bench).collect()} == dict.fromkeys(range(8), 0.5)


def test_a_fragment_before_the_copy_does_not_hide_it(spark):
    item = "a pump fills the old tank with 40 litres of water each hour until the keeper shuts it off"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    fragment = "we saw that it fills the old tank with 95 litres of oil. "
    texts = [item, fragment + item, fragment + "later on that day " * 60 + item, fragment]
    found = {r.doc_id: (r.coverage, r.n_changed) for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    assert found == dict.fromkeys(range(3), (1.0, 0))


def test_names_that_open_a_sentence(spark):
    items = [(1, "Alice has 12 apples. Bob takes 3 of them. Carol takes 2. How many are left?"), (2, "Nadia Brook waters the green garden every morning before work")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[0][1], "Dave has 9 apples. Erin takes 4 of them. Frank takes 1. How many are left?", 'so today "Dave has 9 apples. Erin takes 4 of them.\nFrank takes 1. How many are left?"', "we know Nadia Brook waters the green garden every morning", "alice has 12 apples. bob takes 3 of them. carol takes 2. how many are left?", "Rain has fallen. Nobody takes many of them."]
    found = {(r.doc_id, r.item_id): (r.coverage, r.n_changed) for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 1)}
    assert found[0, 1] == found[4, 1] == (1.0, 0) and found[1, 1] == (1.0, 6)


def test_similar_groups_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = [None, "", "one two", "One TWO", *(" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(0, 60, 3)), *(" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(1, 90))) for _ in range(40))]
    texts += [" ".join(t.split()[:-1]) for t in texts[-20:]]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    rows = {r.doc_id: r for r in jaccard.similar_groups(documents(spark, texts), 4, 85).collect()}
    assert [rows[k].component_id for k in range(len(texts))] == root
    assert [rows[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]


@pytest.mark.parametrize("percent,sizes", [(80, (4, 5)), (80, (5, 6)), (85, (6, 7))])
def test_sets_in_one_cell_share_a_key(percent, sizes):
    sketch, rng, none = jaccard.Sketch(percent), np.random.default_rng(5), np.zeros(0, np.uint64)
    small, large = sizes
    for band in sketch.bands(small):
        cells = int(jaccard.SPARE * (sketch.furthest(sketch.lows[band + 1] - 1) + 1)) + 1
        for _ in range(200):
            # all hashes fall in one cell, whose value then differs
            two = np.unique(rng.integers(0, 1 << 50, large).astype(np.uint64) * np.uint64(cells))
            one = np.delete(two, rng.integers(large))
            assert 100 * len(one) >= percent * len(two)
            shared = np.intersect1d(sketch.keys(one, none, none.view(np.int64)), sketch.keys(two, none, none.view(np.int64)))
            assert len(shared)
            # also if these are frequent, and so the last in the order of both
            m = np.full(len(shared), 20)
            assert len(np.intersect1d(sketch.keys(one, shared, m), sketch.keys(two, shared, m)))


def test_surrogates_are_consistent_and_distinct(spark):
    mails = [f"write to user{k}@mail{k % 5}.example.com or call +1 (743) 555-{3000 + k}" for k in range(200)]
    rows = surrogates.pseudonymise(documents(spark, [*mails, mails[0], None])).collect()
    by = {r.doc_id: r.text for r in rows}
    assert len({by[k] for k in range(200)}) == 200 and by[200] == by[0] and by[201] is None
    assert not any(m in by.values() for m in mails)
    card = "4785380592391139"
    assert surrogates.luhn(surrogates.surrogate("card", card, b"k")[:-1]) - int(surrogates.surrogate("card", card, b"k")[-1]) in (surrogates.luhn(card[:-1]) - int(card[-1]), surrogates.luhn(card[:-1]) - int(card[-1]) + 10, surrogates.luhn(card[:-1]) - int(card[-1]) - 10)


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in (("67108864b", f"{common.BATCH_BYTES}b"), ("8m", f"{common.BATCH_BYTES}b"), ("64k", "64k")):
            spark.conf.set(name, given)
            sizes = common.map_batches(spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t")), lambda parts: (p.iloc[:1].assign(t=str(len(p))) for p in parts), "t string").collect()
            assert spark.conf.get(name) == then and len(sizes) > 1 and sum(int(r.t) for r in sizes) == 3000
    finally:
        spark.conf.set(name, before)


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div><article><h1>Title</h1><p>One&amp;two\n three<script>var x="</p>";</script></p><p>Four five.</p></article><div class="comments"><p>First!</p></div><footer>c</footer></body></html>'
    assert html.main_text(page, html.trained()) == "Title\n\nOne&two three\n\nFour five."
    assert html.main_text(None, html.trained()) == ""


@pytest.mark.parametrize("tag", ["<svg-icon></svg-icon>", "<button-group>", "<title-bar x='1'>", '<svg class="i" />', "<math/>"])
def test_no_silent_element_begins(tag):
    page = f"<html><body><article><h1>Title</h1><p>One {tag} two three.</p><p>Four five.</p></article></body></html>"
    assert html.main_text(page, html.trained()) == "Title\n\nOne two three.\n\nFour five."


@pytest.mark.parametrize("name,sql", [("op9", dedup_exact.OP9_SQL), ("op6", mixing.OP6_SQL), ("op4", sharding.op4_sql())])
def test_equal_sql(spark, name, sql):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ours = {"op9": dedup_exact.op9_exact_dedup, "op6": mixing.op6_mixing, "op4": sharding.op4_sharding}[name](spark, sf)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(ours.select(*columns).collect()) == shown(cursor.fetchall())
