from entitylink.llm.catalog import query, table
from entitylink.llm.html import extracted, trained


@query("op4_best_region_html")
def op4(spark, sf):
    pages = table(spark, sf, "pages")
    return extracted(pages, trained(pages))
