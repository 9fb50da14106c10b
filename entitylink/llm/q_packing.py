import public_tokenizers

from entitylink.llm.catalog import query, table
from entitylink.llm.packing import packed


@query("op10_sum_of_squares_packing")
def op10(spark, sf):
    return packed(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
