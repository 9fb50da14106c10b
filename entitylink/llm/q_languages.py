from pyspark.sql import functions as F

from entitylink.llm.catalog import query, table
from entitylink.llm.languages import identified, trained
from entitylink.llm.toxicity import held_out


@query("op11_mixture_languages")
def op11(spark, sf):
    docs, out = table(spark, sf, "documents"), held_out(parts=3, part=1)
    # lang, source and doc_id never reach the prediction; rows without doc_id are in no part and teach nothing
    model = trained(docs, ~out & F.col("doc_id").isNotNull())
    return identified(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))
