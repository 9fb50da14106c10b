from entitylink.llm.catalog import query, table
from entitylink.llm.toxicity import held_out, scored, trained


@query("op5_toxicity_grammar")
def op5(spark, sf):
    docs = table(spark, sf, "documents")
    model = trained(docs, table(spark, sf, "labels"), ~held_out())
    return scored(docs, model, threshold=0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")
