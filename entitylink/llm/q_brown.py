from entitylink.llm.brown import scored
from entitylink.llm.catalog import query, table
from entitylink.llm.toxicity import held_out


@query("op2_brown_classes")
def op2(spark, sf):
    return scored(table(spark, sf, "documents"), held_out(parts=7, part=2))
