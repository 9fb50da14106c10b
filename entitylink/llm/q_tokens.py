import public_tokenizers

from entitylink.llm.catalog import query, table
from entitylink.llm.tokens import encoded_digests


@query("op6_bpe_merge_rounds")
def op6(spark, sf):
    return encoded_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
