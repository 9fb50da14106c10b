import hashlib

import numpy as np
import pyarrow as pa
import pytest

from entitylink.llm.sketch import containment, edited_fingerprints, fingerprints, merged, sketches, spelled
from entitylink.llm.text import row_shingles
from tests.llm.helpers import awkward, documents, shingles


def test_sketch_keeps_all_below_the_fraction():
    col = pa.array([t or "" for _, t in awkward()])
    kept = sketches(col, 8)
    for i, values, bounds in row_shingles(col):
        for k in range(len(bounds) - 1):
            own = np.unique(values[bounds[k] : bounds[k + 1]] >> np.uint64(16))
            below = own[own < np.uint64(2**48 // 8)]
            assert (kept[i + k] == (below if len(below) else own[:1])).all()
    long = kept[9]
    assert 0.1 < len(long) / len(shingles(awkward()[9][1])) < 0.15
    both = sketches(pa.array(["a b c d e f g h " * 3 + "i j k l m n o p"]))[0]
    parts = sketches(pa.array(["a b c d e f g h " * 3, "e f g h i j k l m n o p"]))
    assert (merged(*parts) == both).all()


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_next_documents_and_likeness(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [r for k, r in enumerate(awkward()) if r[0] is not None and k != 10]
        got = {r["doc_id"]: r for r in edited_fingerprints(documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        own, other, following = sketches(pa.array([t, edited, after]))
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spelled(own), spelled(other))
        assert r["near_edited"] == containment(own, other) and r["near_next"] == containment(own, following)


def test_awkward_rows(spark):
    rows = awkward()
    got = edited_fingerprints(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(documents(spark, rows)).collect()}
    assert plain[1] == plain[2] and plain[4] == plain[5] == plain[6] == "" and plain[7] == plain[8] != ""
    alone = edited_fingerprints(documents(spark, [(5, "abc def")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert edited_fingerprints(documents(spark, [])).count() == 0


def test_likeness_is_near_the_true_containment():
    a = " ".join(f"w{k}" for k in range(6000))
    b = " ".join(f"w{k}" for k in range(4000, 4800))
    assert containment(*sketches(pa.array([a, b]))) == 1.0
    c = " ".join(f"w{k}" for k in range(3000, 9000))
    assert abs(containment(*sketches(pa.array([a, c]))) - 0.5) < 0.06
