import itertools
import random
import zlib

from entitylink.llm.shards import minimax_cuts, sharded
from tests.llm.helpers import awkward, documents


def best_capacity(sizes, shards):
    n = len(sizes)
    places = itertools.combinations_with_replacement(range(n + 1), shards - 1)
    return min(max(sum(sizes[a:b]) for a, b in zip((0, *p), (*p, n))) for p in places)


def test_cuts_reach_the_smallest_capacity():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.choice([1, 5, 17, rng.randint(1, 400)]) for _ in range(rng.randint(1, 9))]
        shards = rng.randint(1, 4)
        cuts = [0, *minimax_cuts(sizes, shards), len(sizes)]
        assert len(cuts) == shards + 1 and cuts == sorted(cuts)
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == best_capacity(sizes, shards)
    assert minimax_cuts([], 3) == [0, 0]


def test_shards_hold_all_rows(spark):
    rows = awkward() + [(k, "same text") for k in range(100, 400)]
    got = sharded(documents(spark, rows), shards=7).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    of_text, slots = {}, {}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 7
        assert of_text.setdefault(raw, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharded(documents(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = sharded(documents(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
