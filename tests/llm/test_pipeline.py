"""Each stage of the pipeline against its operator's brute force."""

import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from entitylink.llm import secrets, toxicity  # noqa: E402
from entitylink.session import materialize  # noqa: E402
from tests.llm.helpers import groups  # noqa: E402
from tests.llm.test_tokens import check_pieces  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~toxicity.held_out())
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    score = dict(r[:2] for r in toxicity.scored(docs, model).collect())
    rows = [r for r in rows if score[r[0]] < 0.3]
    least = groups(rows)
    rows = [r for r in rows if least[r[0]][1] == r[0]]

    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "minmax dedup", "secrets"):
        before = kept
        kept = materialize(stages[name](spark, kept, sf), "stage")
        assert kept.dtypes == docs.dtypes
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert sorted(texts) == sorted(i for i, _ in rows)
    field = secrets.trained(before)
    for (i, t), spans in zip(rows, secrets.found(pa.array([t for _, t in rows]), field)):
        assert (texts[i]["text"] == t) == (not spans) and len(texts[i]["text"]) == texts[i]["n_chars"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    streams = {i: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in texts.items()}
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert {p[0] for p in pieces} == set(streams)
    assert check_pieces(pieces, streams, 1024) == 0


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
