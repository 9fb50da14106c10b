import random

import numpy as np
import pyarrow as pa

from entitylink.llm import minmax, text
from entitylink.llm.graph import components
from tests.llm.helpers import awkward, documents, groups, shingles


def test_words_and_shingles_are_exact():
    texts = [t or "" for _, t in awkward()] + ["a\x0bb\x0cc\rd\ne\tf g", "A" * 3_000_000, "é É"]
    col = pa.array(texts)
    counts, hashes = [], {}
    for i, values, bounds in text.row_shingles(col):
        for k in range(len(bounds) - 1):
            own = np.unique(values[bounds[k] : bounds[k + 1]])
            counts.append(len(own))
            hashes[i + k] = set(own.tolist())
    sets = [shingles(t) for t in texts]
    assert counts == [len(s) for s in sets]
    for a in range(0, len(texts), 3):
        for b in range(len(texts)):
            assert len(hashes[a] & hashes[b]) == len(sets[a] & sets[b])


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(None, 1), (7, 7)]
    links += [(200, k) for k in range(201, 260)]
    least = {}

    def root(x):
        least.setdefault(x, x)
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(least)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_all_pairs(spark):
    rows = awkward()
    got = minmax.near_groups(documents(spark, rows)).collect()
    want = groups(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            n, least = want[r["doc_id"]]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, least, r["doc_id"] == least)
    kept = minmax.deduplicated(documents(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({w[1] for w in want.values()}) and ids.count(None) == 1
    assert kept.columns == documents(spark, rows).columns


def test_links_that_only_rare_shingles_find(spark):
    """A chain of copies, each near its neighbour but not the smallest one: the bucket's
    smallest member links few, the rest is found between components."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(40):
        words = words[:]
        words[rng.randrange(80)] = f"n{k}"
        rows.append((1000 - k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_groups(documents(spark, rows)).collect()}
    assert got == {i: g for i, (_, g) in groups(rows).items()}


def test_repeated_rows_do_not_hide_links(spark, monkeypatch):
    """Two linked texts that stand three times each and meet no bucket without a smaller
    text that is linked with neither, on both sides of the broadcast bound."""
    rng = random.Random(8)
    parts = [" ".join(f"p{b}w{k}" for k in range(30)) for b in range(20)]
    rows = [(i, " ".join(parts[b] for b in sorted(rng.sample(range(20), 14)))) for i in range(150)]
    rows += [(1000 + t, " ".join(parts) + "".join(f" t{t}w{k}" for k in range(80))) for t in range(2)] * 3
    want = {i: g for i, (_, g) in groups(rows).items()}
    assert want[1001] == 1000
    for bound in (minmax.BROADCAST_IDS, 1):
        monkeypatch.setattr(minmax, "BROADCAST_IDS", bound)
        got = minmax.near_groups(documents(spark, rows)).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_id_with_several_texts(spark):
    """Texts under one doc_id are classes of their own; none hides the links of another."""
    rng = random.Random(9)
    chains = []
    for c in range(2):
        words, chain = [f"c{c}w{k}" for k in range(80)], []
        for k in range(20):
            words = words[:]
            words[rng.randrange(80)] = f"c{c}n{k}"
            chain.append(" ".join(words))
        chains.append(chain)
    rows = [(1000 - k, chains[0][k]) for k in range(20)] + [(1000 - k if k % 2 else 500 - k, chains[1][k]) for k in range(20)]
    own = [groups(rows[:20]), groups(rows[20:])]
    got = minmax.near_groups(documents(spark, rows)).collect()
    want = sorted((i, g[i][1]) for part, g in zip((rows[:20], rows[20:]), own) for i, _ in part)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def test_empty_table(spark):
    empty = documents(spark, [])
    assert minmax.near_groups(empty).count() == 0 and minmax.deduplicated(empty).count() == 0


def variants(seed, count, edits):
    """Texts of 60 words with some of them exchanged; ``edits`` at least and at most."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(count):
        own = base[:]
        for k in rng.sample(range(60), rng.randint(*edits)):
            own[k] = f"v{rng.randrange(10**9)}"
        rows.append((10_000 - i, " ".join(own)))
    return rows


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(4)
    for seed, count, edits in ((1, 300, (1, 3)), (2, 120, (2, 2)), (3, 60, (0, 1))):
        texts = variants(seed, count, edits)
        number = {}
        sets = [np.array(sorted(number.setdefault(x, len(number)) for x in shingles(t)), np.uint64) for _, t in texts]
        n, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
        for side in (None, rng.integers(0, 2, count)):
            links = minmax.linked_forest(np.arange(count), n, flat, 75, side)
            least = list(range(count))

            def root(x):
                while least[x] != x:
                    x = least[x]
                return x

            def joined(pairs):
                least[:] = range(count)
                for a, b in pairs:
                    x, y = sorted((root(a), root(b)))
                    least[y] = x
                return [root(k) for k in range(count)]

            every = [(a, b) for a in range(count) for b in range(a) if side is None or side[a] != side[b]]
            shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in every}
            every = [p for p in every if 100 * shared[p] >= 75 * (n[p[0]] + n[p[1]] - shared[p])]
            assert joined(links) == joined(every) and len(links) == count - len(set(joined(every)))
            assert all((max(p), min(p)) in every for p in links)


def test_large_families_of_near_copies(spark):
    """Near copies that are mostly not linked to each other, with a passage all share, some
    repeated; in one tile and in many."""
    for count, edits, tile in ((300, (1, 3), minmax.TILE), (900, (1, 2), minmax.TILE), (300, (2, 3), 2000)):
        rows = variants(count, count, edits) + [(i, f"{' '.join(f'p{k}' for k in range(40))} own{i} word{i}") for i in range(30)]
        rows += rows[::7]
        got = minmax.near_groups(documents(spark, rows), tile=tile).collect()
        want = groups(rows)
        assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
