from entitylink.llm.catalog import query, table
from entitylink.llm.sketch import edited_fingerprints


@query("op8_threshold_sketch")
def op8(spark, sf):
    return edited_fingerprints(table(spark, sf, "documents"))
