from entitylink.llm.catalog import query, table
from entitylink.llm.secrets import scanned, trained


@query("op3_secret_crf")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    return scanned(docs, trained(docs))
