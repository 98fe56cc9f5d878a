"""The trained operators and surrogates, against enumeration, brute force or held-out truth on small fixtures."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweft.llm import common, crf, decontaminate, html, language, mixing, secrets, surrogates, toxicity

WORDS = {"en": "the and with house river green stone walk", "de": "und der mit haus fluss stein gehen schön", "fr": "le et avec maison rivière vert pierre marcher"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out string, score string, labels string, spans string, toxic int"


def rows(spark, items):
    """Documents (doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, lang, "s", 0, "x", "x", "x", "x", 1) for k, t, lang in items], SCHEMA)


def spoken(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang].split(), n))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths, n = [1, 5, 3], 3
    emit, move = rng.normal(size=(sum(lengths), n)), rng.normal(size=(n, n))
    first = np.concatenate(([0], np.cumsum(lengths)))
    before, crf.CHUNK = crf.CHUNK, 2
    try:
        gamma, pairs = crf.marginals(emit, first, move, pairs=True)
    finally:
        crf.CHUNK = before
    nodes, expected = np.zeros_like(gamma), np.zeros((n, n))
    for a, b in zip(first[:-1], first[1:]):
        paths = list(itertools.product(range(n), repeat=b - a))
        weight = np.array([np.exp(sum(emit[a + k, y] for k, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for k, y in enumerate(p):
                nodes[a + k, y] += w
            for x, y in zip(p, p[1:]):
                expected[x, y] += w
    assert np.allclose(gamma, nodes) and np.allclose(pairs, expected)


def test_languages_and_switches(spark):
    rng = np.random.default_rng(2)
    known = [(k, spoken(rng, lang), lang) for k, lang in zip(range(120), itertools.cycle(WORDS))]
    switched = spoken(rng, "en", 20) + " " + spoken(rng, "de", 20)
    odd = [(200, None, None), (201, "", "en"), (202, "12 34 !", None), (203, switched, None), (204, "x" * 3 + " the" * 60_000, None), (205, "İ " + known[0][1], None), (205, "İ " + known[0][1], None), (None, known[0][1], None)]
    docs = rows(spark, known + odd)
    found = language.predict_language(docs).collect()
    assert len(found) == len(known) + len(odd)
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == lang for k, _, lang in known)
    assert {by[k].lang_pred for k in (200, 201, 202)} == {"und"} and all(by[k].score == 0 and by[k].segments == "" for k in (200, 201, 202))
    assert [x.split(":")[0] for x in by[203].segments.split(",")] == ["en", "de"] and by[203].segments.endswith(f":{len(switched)}")
    assert by[204].lang_pred == "en" and all(0 <= r.score <= 1 for r in found)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(found) - 3
    assert language.predict_language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxic_spans_and_scores(spark):
    rng = np.random.default_rng(3)
    texts = [spoken(rng, "en", 40) for _ in range(160)]
    bad = {k for k in range(160) if k % 4 == 0}
    for k in bad:
        words = texts[k].split()
        for at in rng.choice(40, 3, replace=False):
            words[at] = str(rng.choice(["Vile", "rotten"]))
        texts[k] = " ".join(words)
    texts = ["İx " + t for t in texts]
    docs = rows(spark, [(k, t, None) for k, t in enumerate(texts)] + [(200, None, None), (201, "", None), (202, "word " * 50_000 + "vile", None), (202, "a", None), (None, "rotten vile", None)])
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(160)] + [(0, 0), (300, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in found if r.doc_id != 202}
    assert len(found) == 165 and all(by[k].predicted == int(k in bad) for k in range(160))
    for k in bad:
        for span in by[k].spans.split(","):
            a, b = map(int, span.split(":"))
            assert set(texts[k][a:b].lower().split()) <= {"vile", "rotten"}
    assert by[200].n_words == by[201].n_words == 0 and by[200].predicted == 0
    none = toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(r.n_words == 0 and r.spans == "" and r.score == 0 for r in none)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_coreference_of_names(spark):
    texts = ["Mr Smith met Mr John Smith and Dr. Anna Lee. John Smith left; Smith's dog too, said Anna.", "Mr O'Brien and Frau Maria von der Berg-Lee. Berg-Lee went.", "nothing here", None, "", "Mr Smith again, smith not"]
    out = {r.doc_id: r for r in surrogates.pseudonymise(rows(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    assert out[2].text == texts[2] and out[3].text is None and out[4].text == "" and out[2].n_entities == 0
    assert not re.search(r"Smith|John|Anna|Lee\b", out[0].text) and not re.search("O'Brien|Maria|Berg-Lee", out[1].text)
    family = re.match(r"Mr (\w+) met Mr (\w+) (\w+) and Dr\. (\w+) (\w+)\. (\w+) (\w+) left; (\w+)'s dog too, said (\w+)\.", out[0].text).groups()
    assert family[0] == family[2] == family[6] == family[7] and family[1] == family[5] and family[3] == family[8]
    assert family[1] in surrogates.GIVEN["man"] and family[3] in surrogates.GIVEN["woman"]
    assert out[5].text == f"Mr {family[0]} again, smith not"
    assert surrogates.pseudonymise(rows(spark, [(1, "plain", None), (2, "text", None)])).count() == 2


def test_check_digits_and_distinct_names():
    moved = surrogates.surrogate("iban", "DE89 3704 0044 0532 0130 00", b"k").replace(" ", "")
    assert int(moved[2:4]) == surrogates.iban_check(moved[:2], moved[4:]) and moved != "DE89370400440532013000"
    names = ["".join(x) for x in itertools.product("BKST", "aeiou", "lmn", "aeo", "rs")]
    for kind in ("family", "man"):
        assert len({surrogates.surrogate(kind, n, b"k") for n in names}) == len(names)
    assert all(surrogates.surrogate("man", n, b"k") != n for n in surrogates.GIVEN["man"])


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(((ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))) for m in p.finditer(text) if len(m[g]) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    many = " ".join(f"token = abcdef{k % 10}{hashlib.md5(str(k).encode()).hexdigest()[: k % 40]}" for k in range(20_000))
    docs = docs.unionByName(spark.createDataFrame([(-1, many), (-2, None), (-3, 'é password:"pass"word=sécret API_key = aaaaaa.bbb AKIA' + "A" * 30)], "doc_id long, text string"))
    found = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    for r in docs.collect():
        assert found[r.doc_id].base_sha256 == hashlib.sha256(base_spans(r.text or "").encode()).hexdigest(), r.doc_id
    assert found[-1].n_assign == 20_000


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_sums(spark, n):
    got = spark.range(1).select(F.expr(f"CAST(slice(sequence(0, {n}), 2, {max(n, 1)}) AS array<int>)").alias("x")).select(secrets.running(F.col("x"))).first()[0]
    assert got == list(itertools.accumulate(range(1, n + 1)))


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("bra", "cle", "dro", "fli", "gru", "plo") for b in ("nd", "st", "ver", "ling", "mer")]
    items = [list(rng.choice(vocabulary, 20)) for _ in range(12)]
    texts = []
    for k in range(60):
        words = list(items[k % 12])
        for at in rng.choice(20, k // 12, replace=False):
            words[at] = "zzz"
        texts.append(" ".join([*rng.choice(vocabulary, k % 7), *words, *rng.choice(vocabulary, 5)]))
    texts += [None, "", " ".join(["brand"] * 5000)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows(spark, [(k, t, None) for k, t in enumerate(texts)]), bench).collect()}
    grams = lambda w: [tuple(w[i : i + 6]) for i in range(len(w) - 5)]
    held = [set(grams((t or "").split())) for t in texts]
    assert found == {(d, i) for d in range(len(texts)) for i, x in enumerate(items) if sum(g in held[d] for g in grams(x)) >= 0.5 * 15}
    assert decontaminate.leaks(rows(spark, []), bench).count() == 0 and decontaminate.without_leaks(rows(spark, [(1, "a", None)]), bench.limit(0)).count() == 1


def test_look_up_and_comparison_have_one_template(spark):
    texts = ["de. Ciónos Dollga ñarie, Bob Tom Li says. The 3.5 km of Alice. Ñ. 1:30 x-2 end", 'Raque, lo. A b. "Quoted Man" said 5kg.', "Mr Juan Carlos Lopez Perez paid $12.50, 30 days late"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    names = decontaminate.vocabulary(docs.limit(1))
    for r in docs.select(decontaminate.template(decontaminate.marked_words(F.col("text"), names)).alias("t"), decontaminate.template_hashes(F.col("text"), names).alias("h")).withColumn("t", F.expr("transform(t, w -> xxhash64(w))")).collect():
        assert r.t == r.h


def test_pages_without_telling_names():
    tree, text = html.trained(), "some words of a story " * 12
    assert html.main_text(f"<body><a href=x>Home</a><p>{text}</p></body>", tree) == text.strip()
    assert html.main_text("<p><a>" + "linked " * 40 + f"</a></p><p>{text}</p>", tree) == text.strip()
    assert html.main_text(f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>{text}</p><div><a>About us</a> <a>Contact</a></div>", tree) == text.strip()
    assert html.main_text("<p>one line</p>", tree) == "one line"
    tests = set()

    def walk(t):
        if not isinstance(t, int):
            tests.add(t[0])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert tree[0] == 1 and {1, 5} <= tests  # link density of the block first, that of a neighbour below


def test_repeated_rows_fill_the_budget(spark):
    docs = rows(spark, [(k, f"w{k} " * (k % 9), None) for k in range(200)] + [(7, "same text here", None)] * 60 + [(None, f"null {k}", None) for k in range(20)])
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    assert out.where("doc_id IS NULL").count() > 0 and mixing.repeated(docs.limit(0)).count() == 0


def test_scratch_is_deleted(spark):
    with common.Scratch() as held:
        kept, gone = common.cut(spark.range(3), "kept"), common.cut(spark.range(4), "gone")
        held.keep(kept)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


SCRIPTS = ["Łuść", "Šůž", "王伟", "محمد", "Ñandú", "Ωμέγα", "Ёжиков", "Øst", "გიორგი", "राम", "김철수", "Žižek", "Đặng", "Ĳsbrand", "אברהם", "ひろし"]


@pytest.mark.parametrize("name", SCRIPTS)
def test_names_of_all_scripts_are_replaced(name):
    text, found = surrogates.replaced(f"Dr. {name} came. {name} went", b"k")
    words = [w for w in surrogates.IN_NAME.findall(name)]
    assert found and not any(w in text.replace("came", "").replace("went", "") for w in words)
    new = surrogates.surrogate("family", words[0], b"k")
    assert len(new) == len(words[0]) and text.count(new) == 2
    assert [c.isupper() for c in new] == [c.isupper() for c in words[0]] and [c.isalpha() for c in new] == [c.isalpha() for c in words[0]]


@pytest.mark.parametrize("text,kind", [("+٩٦٦ ٥٥ ١٢٣ ٤٥٦٧", "phone"), ("żółć@пример.com", "email"), ("a@b.co", "email"), ("१२३-४५-६७८९", "ssn"), ("127.0.0.1", "ip"), ("0.0.0.0", "ip"), ("4111 1111 1111 1111", "card"), ("DE89 3704 0044 0532 0130 00", "iban")])
def test_no_entity_stays_as_it_is(text, kind):
    for key in (b"k", b"another", b"third"):
        new, found = surrogates.replaced(f"see {text} there", key)
        assert [k for _, _, k in found] == [kind] and text not in new
        assert [c.isdecimal() for c in new[4:-6]] == [c.isdecimal() for c in text] or new[4] == "[" or kind == "ip"


def test_permutations_are_one_cycle():
    for sizes in ([2, 3], [3, 4, 5], [10, 10], [7]):
        total = int(np.prod(sizes))
        x = start = [0] * len(sizes)
        seen = set()
        for _ in range(total):
            x = surrogates.permuted(x, sizes, b"k", "t")
            seen.add(tuple(x))
        assert len(seen) == total and x == start


def test_surrogates_of_random_characters_differ():
    """No letter or digit of the first planes maps to itself in a word of two, and words keep distinct."""
    rng = np.random.default_rng(1)
    letters = [c for c in map(chr, rng.integers(0x41, 0x2FFFF, 6000)) if c.isalpha()][:1500]
    words = sorted({a + b for a, b in zip(letters, letters[1:])})
    out = [surrogates.hidden("family", w, b"k") for w in words]
    assert all(a != b for a, b in zip(words, out)) and len(set(out)) == len(words)


def test_numbers_alone_are_no_leak_and_long_texts_take_seconds(spark):
    import time

    rng = np.random.default_rng(0)
    values = [str(v) for v in rng.integers(1000, 9999, 13)]
    items = spark.createDataFrame([(1, "sort " + " ".join(values)), (2, "the train leaves at 9 and takes 45 minutes to reach Paris from Berlin")], "item_id long, text string")
    many = " ".join(str(v) for v in rng.integers(1000, 9999, 20_000))
    told = "the train leaves at 9 and takes 45 minutes to reach Paris from Berlin"
    texts = ["please " + many, "please sort " + " ".join(values) + " now", many + " " + told.replace("9", "7").replace("45", "30") + " " + many, "sort " + " ".join(str(v) for v in rng.integers(1000, 9999, 13)), (told + " . ") * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decontaminate.leaks(docs.limit(1), items).collect()
    began = time.time()
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 2), (4, 2)} and time.time() - began < 60
    assert found[2, 2].n_changed == 2 and found[4, 2].n_changed == 0


def test_gaps_keep_all_windows_of_known_words(spark):
    texts = [
        "Soon after qqa, Big Ben rang qqb. The red fox has 5 km of qqc and the red fox. McDonald donald has the red",
        "qqa qqb the red qqc fox The red qqd qqe. Zoe has the red fox has\n The red fox, qqf; Ann has the red",
        "\u0130zmir has qqa \u0130zmir has qqb the\ue0f1 red fox qqa! Ann qqb \"The\" red\tfox has 3rd (qqc) 7 qqd",
        "qqa\n The red qqb: The red 5 m. The red x x. the red qqc 5 x the red | qqd | Ann Ben Cid qqe qqf, 3.5 qqg",
        "",
        "qqa " * 30_000 + "the red fox has the red",
    ]
    names, known = (["ben"], ["the", "red", "fox", "has", "donald"]), ["ben", "donald", "fox", "has", "km", "m", "rd", "red", "the"]
    marks = "".join((decontaminate.NUM, decontaminate.NAME, decontaminate.UNIT))
    for least in (2, 4, 6):
        thin = decontaminate.thinned(F.col("text"), known, least)
        held = spark.createDataFrame([(t,) for t in texts], "text string").select(thin.alias("thin"), decontaminate.template_words(F.col("text"), names).alias("whole"), decontaminate.template_words(thin, names).alias("left")).collect()

        def seen(words):
            return {tuple(words[k : k + least]) for k in range(len(words) - least + 1) if all(w in known or w in marks for w in words[k : k + least])}

        assert [seen(r.left) for r in held] == [seen(r.whole) for r in held]
        assert len(held[-1].thin) < 40 and sum(len(seen(r.whole)) for r in held) > 10
