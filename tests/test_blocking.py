import itertools

import pytest
from pyspark.sql import functions as F

from entitylink.functions import rules, tokens
from entitylink.operators import blocking as b
from entitylink.plans import linker


def sizes_of(spark, histogram):
    rows = [(f"{s}-{i}", s) for s, n in histogram.items() for i in range(n)]
    return spark.createDataFrame(rows, "token string, size long")


@pytest.mark.parametrize(
    "histogram,want",
    [({1: 10, 2: 5, 3: 2, 10: 1, 50: 1}, 50), ({1: 100, 2: 50, 3: 20, 4: 10, 5: 1, 200: 3, 400: 1}, 400), ({1: 3}, 1)],
)
def test_optimal_block_size(spark, histogram, want):
    assert [r.optimal for r in b.optimal_block_size(sizes_of(spark, histogram)).collect()] == [want]


def test_no_blocks_no_row(spark):
    assert b.optimal_block_size(spark.createDataFrame([], "token string, size long")).count() == 0


@pytest.fixture(scope="module")
def sides(spark):
    s = [(1, "red gear shop"), (2, "blue bolt"), (3, "red gear shop"), (4, None), (5, "cold widget of the year")]
    t = [(1, "red gear"), (2, "bolt blue big"), (3, "cold gadget of the year"), (9, "unrelated")]
    return spark.createDataFrame(s, "id long, v string"), spark.createDataFrame(t, "id long, v string")


def test_meta_blocking_matches_a_plain_loop(spark, sides):
    filtered = b.block_filtering(b.purge(t := b.token_blocking(b.tag(*sides, "id", "v")), b.block_sizes(t)), 3)
    lists = {}
    for r in filtered.collect():
        lists.setdefault((r.dataset, r.id), set()).add(r.token)
    weights = []
    for x, y in itertools.combinations(sorted(lists), 2):
        common = len(lists[x] & lists[y])
        if common:
            weights.append((x, y, common, common / len(lists[x] | lists[y])))
    mean = sum(k * w for *_, k, w in weights) / sum(k for *_, k, _ in weights)
    want = {(x, y) for x, y, _, w in weights if w >= mean - 1e-12}
    got = {((r.dataset_a, r.id_a), (r.dataset_b, r.id_b)) for r in b.meta_blocking(filtered).collect()}
    assert got == want and want


@pytest.mark.parametrize("purging", [True, False])
def test_token_links_equal_the_general_job(spark, sides, purging):
    """The pruned job and the job that lists every candidate agree."""
    bag = lambda c: tokens.block_tokens(F.col(c))
    o = F.size(F.array_intersect(bag("v_s"), bag("v_t")))
    rule = rules.atom(o / (F.size(bag("v_s")) + F.size(bag("v_t")) - o), 0.3)
    general = linker.link(*sides, "id", "v", rule, 0.3, purging)
    pruned = linker.link_by_tokens(*sides, "id", "v", 0.3, purging)
    want = {(r.source, r.target, round(r.sim, 9)) for r in general.collect()}
    assert want == {(r.source, r.target, round(r.sim, 9)) for r in pruned.collect()}
    assert {(1, 1), (3, 1)} <= {(s, t) for s, t, _ in want}


def test_purging_off_keeps_large_blocks(spark):
    tokens_ = spark.createDataFrame(
        [("big", "s", i) for i in range(30)] + [("big", "t", i) for i in range(30)] + [("small", "s", 1), ("small", "t", 1)],
        "token string, dataset string, id long",
    )
    kept = b.purge(tokens_, b.block_sizes(tokens_), purging=False)
    assert b.candidates(kept).count() == 900


def test_candidates_are_found_in_tiles(spark):
    """Each pair once, also of an entity without an id, and no list of pairs made distinct."""
    rows = [(f"w{(i * j) % 11}", d, i if i else None) for d in "st" for i in range(25) for j in range(1, 4)]
    tokens_ = spark.createDataFrame(sorted(set(rows), key=str), "token string, dataset string, id long")
    kept = b.purge(tokens_, b.block_sizes(tokens_), purging=False)
    pairs = b.candidates(kept)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan and "Aggregate" not in plan
    blocks = {d: {} for d in "st"}
    for token, d, i in rows:
        blocks[d].setdefault(i, set()).add(token)
    want = [(i, j) for i, x in blocks["s"].items() for j, y in blocks["t"].items() if x & y]
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)


def test_strip_literal(spark):
    df = spark.createDataFrame([('"a ""b"" c"^^xsd:string',), ("plain",)], "v string")
    assert [r.v for r in df.select(b.strip_literal(F.col("v")).alias("v")).collect()] == ["a b c", "plain"]


def test_counts_past_64_bits(spark):
    from decimal import Decimal

    big = 5 * 10**9
    sizes = spark.createDataFrame([("a", 2 * big, big, big), ("b", 4, 2, 2)], "token string, size long, n_s long, n_t long")
    assert b.comparison_count(sizes).collect()[0].comparisons == Decimal(big * big + 4)
    kept = sizes.withColumn("dataset", F.lit("s")).withColumn("id", F.lit(1))
    assert [r.token for r in b.block_filtering(kept, 1).collect()] == ["b"]
    product = F.col("n_s").cast("decimal(19,0)") * F.col("n_t").cast("decimal(19,0)")
    assert sizes.select(F.max(product)).collect()[0][0] == big * big


def test_entities_with_several_values_count_once(spark):
    s = spark.createDataFrame([(1, "red gear"), (1, "red bolt"), (1, "red bolt")], "id long, v string")
    t = spark.createDataFrame([(1, "red gear")], "id long, v string")
    sizes = {r.token: (r.size, r.n_s, r.n_t) for r in b.block_sizes(b.token_blocking(b.tag(s, t, "id", "v"))).collect()}
    assert sizes == {"red": (2, 1, 1), "gear": (2, 1, 1), "bolt": (1, 1, 0)}
    values = linker.set_values(s, t, "id", "v", lambda v: tokens.block_tokens(v))
    stats = linker._per_entity(linker.element_stats(values), s, t, "id", "v")
    assert {r.elem: r.entities for r in stats.collect()} == {"red": 2, "gear": 2, "bolt": 1}
