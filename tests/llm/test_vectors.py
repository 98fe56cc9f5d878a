"""Fingerprints, vector codes and clusters against brute force and SQL."""

import re

import duckdb
import numpy as np
import pytest
import xxhash

from blockweft.llm import centroids, codebooks, simhash

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, vec binary, near int, key string"


def plain_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64(" ".join(found[k : k + words]).encode(), seed=42).intdigest() for k in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps):
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    return simhash.rooted(len(fps), i, j)


def some_fingerprints(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(3) << rng.integers(0, 62, n, dtype=np.uint64))
    return np.unique(np.concatenate([base, near, near ^ np.uint64(0b11011), rng.integers(0, 1 << 14, n, dtype=np.uint64)]))


@pytest.mark.parametrize("n", [1, 2, 5, 40, 400])
def test_search_by_pairs_of_nodes_is_exact(n):
    x = some_fingerprints(n)
    x = x[np.argsort(simhash.gray_rank(x))]
    i, j = simhash.near_pairs(x, None, 4)
    assert set(zip(i, j)) == set(zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))))
    a, b = x[::3], x[1::2]
    i, j = simhash.near_pairs(a, b, 4)
    assert set(zip(i, j)) == set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)))


def test_gray_order_has_one_bit_between_neighbours():
    words = np.arange(64, dtype=np.uint64)
    ordered = words[np.argsort(simhash.gray_rank(words))]
    assert set(np.bitwise_count(ordered[1:] ^ ordered[:-1]).tolist()) == {1}


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_near_words_share_the_key_of_a_table(blocks):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    same = np.zeros(500, bool)
    for order, bits in simhash.tables(blocks, 4):
        assert sum(w for _, w in order) == 64 and len(np.unique(simhash.arranged(x, order))) == 500
        shift = np.uint64(64 - bits)
        same |= simhash.arranged(x, order) >> shift == simhash.arranged(y, order) >> shift
    assert same.all()
    assert simhash.blocks_for(10, 4) == 5 < simhash.blocks_for(1 << 30, 4)


def test_links_across_chunks_and_a_frequent_key(spark):
    rng = np.random.default_rng(5)
    # more than UPPER chunks would take too long here; a few chunks of one key, and keys of one chunk
    x = np.unique(np.concatenate([some_fingerprints(300), rng.integers(0, 1 << 24, 4000, dtype=np.uint64)])).view(np.int64)
    x.sort()
    table = spark.createDataFrame([(int(v),) for v in x], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.linked(table, len(x), 4)).collect()}
    assert [found.get(int(v), int(v)) for v in x] == x[plain_roots(x.view(np.uint64))].tolist()


def test_op11_equals_brute_force(spark):
    rows = simhash.op11_simhash(spark, SF).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = np.array([plain_fingerprint(t, 4) for _, t in docs], np.uint64)
    roots = plain_roots(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{int(fps[k]):016x}", docs[roots[k]][0]) for k, (d, _) in enumerate(docs)}
    assert len(rows) == len(docs) > len(set(roots.tolist()))


def test_similar_texts_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(3, None, "x"), (4, "", "x"), (5, " \t\n", "x"), (6, "One two", "x"), (7, "one  TWO", "x"), (7, "one two", "x"), (8, long, "x"), (9, "É é", "x"), (None, "one two", "x"), (None, "a b c d e f g h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id, r.copies) for r in simhash.similar_texts(docs, words=4).collect()]
    assert len(got) == len(rows)
    by = {}
    for d, f, c, n in got:
        by.setdefault(d, set()).add((f, c, n))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3, 3)}
    two = (f"{plain_fingerprint('one two', 4):016x}", 6, 4)
    assert by[6] == by[7] == {two} and two in by[None]
    assert by[8] == {(f"{plain_fingerprint(long, 4):016x}", 8, 1)} and by[9] == {(f"{plain_fingerprint('É é', 4):016x}", 9, 1)}
    assert (f"{plain_fingerprint('a b c d e f g h', 4):016x}", None, 1) in by[None]
    assert simhash.similar_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name,query,sql", [("op12", codebooks.op12_vector_codes, codebooks.op12_sql()), ("op13", centroids.op13_centroids, centroids.op13_sql())])
def test_vector_queries_equal_sql(spark, name, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    ours = query(spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(tuple(r) for r in ours.select(*columns).collect()) == sorted(cursor.fetchall())


def plain_codes(x, books, rounds):
    """Codes, errors and codebooks of integer parts by full comparisons."""
    books = books.copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        near = d.argmin(axis=2)
        if k < rounds:
            for p in range(x.shape[1]):
                for e in range(books.shape[1]):
                    mine = x[near[:, p] == e, p]
                    if len(mine):
                        books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    return near, d.min(axis=2).sum(axis=1), books


@pytest.mark.parametrize("span", [3, 40, 100_000])
def test_rounds_with_bounds_equal_full_comparisons(span):
    """Many ties and copies (3), few (40), and large numbers."""
    rng = np.random.default_rng(span)
    x = rng.integers(-span, span, (600, 4, 8))
    x[300:400] = x[:100]
    books = x[:16].transpose(1, 0, 2).copy()
    want, _, final = plain_codes(x, books, 6)
    b, shifts, state = 4, None, [None] * 4
    for k in range(7):
        depths, found, entries = {}, {}, []
        after = []
        for p in range(4):
            if shifts is None:
                after.append(codebooks.scanned(x[:, p], books[p], b))
            else:
                s, depth = codebooks.moved_on(x[:, p], books[p], shifts[p], tuple(a.copy() for a in state[p]), b)
                after.append(s)
                for d, n in zip(*np.unique(depth, return_counts=True)):
                    depths[int(d)] = depths.get(int(d), 0) + int(n)
            near = after[-1][0][:, 0]
            entries.append(near)
            for e in range(16):
                mine = x[near == e, p]
                if len(mine):
                    found[p, e] = (len(mine), mine.sum(axis=0).tolist())
        if k < 6:
            new = codebooks.updated(books, found)
            shifts, books, state = np.sqrt(((new - books) ** 2).sum(axis=2)), new, after
            b = codebooks.next_length(depths, b, 16)
    assert (np.stack(entries, axis=1) == want).all() and (books == final).all()
    # bounds spare work, and lists are adapted
    assert depths.get(0, 0) > 0


def test_lists_follow_the_depth_of_searches():
    assert codebooks.next_length({0: 90, 5: 10}, 4, 16) == 8
    assert codebooks.next_length({0: 90, 1: 8, 3: 2}, 8, 16) == 2
    assert codebooks.next_length({0: 50, 3: 50}, 8, 16) == 3
    assert codebooks.next_length({9: 10}, 8, 16) == 16


@pytest.mark.parametrize("span", [2, 50])
def test_bounds_on_summed_displacements_equal_full_comparisons(span):
    rng = np.random.default_rng(span)
    x = rng.integers(-span, span, (500, 6))
    history, state = [x[:16].copy()], None
    for _ in range(6):
        centres = history[-1]
        state = centroids.placed(x, centres, centroids.drifts(history), state if state is None else tuple(np.array(a) for a in state))
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        new = centres.copy()
        for e in range(16):
            if (state[0] == e).any():
                new[e] = [int(s) // int((state[0] == e).sum()) for s in x[state[0] == e].sum(axis=0)]
        history.append(new)
    assert (state[4] < 5).any()  # bounds of former rounds still serve


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(k, rng.normal(size=64).astype(float).tolist(), k % 2 or None, b"", 0, "x") for k in range(40)]
    odd = [(50, None, 1, b"", 0, "x"), (51, [None] * 64, 1, b"", 0, "x"), (52, [float("nan")] * 64, 1, b"", 0, "x"), (53, [float("inf")] + [0.0] * 63, 1, b"", 0, "x"), (54, [], 1, b"", 0, "x"), (55, [1.0] * 63, 1, b"", 0, "x"), (3, good[3][1], 1, b"", 0, "x"), (None, [0.0] * 64, None, b"", 0, "x")]
    table = spark.createDataFrame(good + odd, VECTORS)
    coded, books = codebooks.compressed(table)
    ids = sorted((str(r.vec_id) for r in coded.collect()))
    assert ids == sorted([str(k) for k in range(40)] + ["3", "None"]) and books.shape == (8, 16, 8)
    rows, centres, inertia = centroids.clustered(table)
    assert sorted(str(r.vec_id) for r in rows.collect()) == ids and centres.shape == (16, 64)
    assert sum(inertia.values()) == sum(r.distance for r in rows.collect())
    # fewer vectors than entries, none, and numbers too large
    coded, books = codebooks.compressed(table.where("vec_id < 3"))
    assert books.shape == (8, 3, 8) and all(r.error == 0 for r in coded.collect())
    assert codebooks.compressed(table.limit(0))[0].count() == 0 and centroids.clustered(table.limit(0))[0].count() == 0
    big = spark.createDataFrame([(1, [1e30] * 64, 1, b"", 0, "x")], VECTORS)
    with pytest.raises(Exception, match="lies beyond"):
        codebooks.compressed(big)
