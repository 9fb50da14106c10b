"""From triples to entities: filters, assembly, property transforms, samples.

triples: subject, predicate, object. props (long entities): id, prop, value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions import prep
from entitylink.operators.blocking import strip_literal
from entitylink.operators.skew import attach
from entitylink.session import materialize

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PART_SIZE = 1000


def filter_config(triples: DataFrame, predicates: Sequence[str], wanted_class: str) -> DataFrame:
    """Triples of configured predicates, and type triples of the wanted class."""
    of_class = (F.col("predicate") == RDF_TYPE) & (F.col("object") == wanted_class)
    return triples.where(F.col("predicate").isin(*predicates) | of_class)


def normalize_dois(triples: DataFrame, predicate: str) -> DataFrame:
    """Normalise identifier objects; identifiers that hold no DOI are dropped."""
    doi = F.when(F.col("predicate") == predicate, prep.normalize_doi(F.col("object"))).otherwise(F.col("object"))
    return triples.withColumn("object", doi).where(F.col("object").isNotNull())


def complete_entities(triples: DataFrame, predicates: Sequence[str], wanted_class: str) -> DataFrame:
    """Configured properties (id, prop, value) of entities that have them all and the class.

    Completeness is a partial aggregate of flags per subject, never a collected set.
    """
    rows = filter_config(triples, predicates, wanted_class)

    def has(test: Column, name: str) -> Column:
        return F.max(F.when(test, 1).otherwise(0)).alias(name)

    flags = [has(F.col("predicate") == p, f"p{i}") for i, p in enumerate(predicates)]
    flags.append(has(F.col("predicate") == RDF_TYPE, "typed"))
    n_props = F.count(F.when(F.col("predicate") != RDF_TYPE, 1)).alias("n")
    whole = rows.groupBy("subject").agg(*flags, n_props)
    for i in range(len(predicates)):
        whole = whole.where(F.col(f"p{i}") == 1)
    whole = materialize(whole.where("typed = 1 and n > 0").select("subject", "n"), "complete")
    kept = attach(rows.where(F.col("predicate") != RDF_TYPE), whole, "subject", "n", ["predicate", "object"])
    return kept.select(F.col("subject").alias("id"), F.col("predicate").alias("prop"), strip_literal(F.col("object")).alias("value"))


def entity_pairs(triples: DataFrame) -> DataFrame:
    """Entities in long form: each distinct (subject, predicate, object) once."""
    return triples.select("subject", "predicate", "object").distinct()


def aggregate_entities(triples: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``entity_pairs`` nested: subject, part, pairs (sorted predicate/object).

    An entity fills part 0 up to ``part_size`` pairs; a larger one continues in further
    parts, so no row or task holds an unbounded group. Readers that need a whole
    entity of any size read the long form.
    """
    pairs = entity_pairs(triples)
    n = materialize(pairs.groupBy("subject").agg(F.count("*").alias("n")), "subjects")
    rows = attach(pairs, n, "subject", "n", ["predicate", "object"])
    part = F.pmod(F.xxhash64("predicate", "object"), F.ceil(F.col("n") / part_size)).cast("int")
    nested = F.sort_array(F.collect_list(F.struct("predicate", "object")))
    return rows.withColumn("part", part).groupBy("subject", "part").agg(nested.alias("pairs"))


def to_props(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Unpivot a table into long entities; nulls are absent properties."""
    wide = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot("id", list(columns), "prop", "value").where(F.col("value").isNotNull())


def to_triples(df: DataFrame, id_col: str, columns: Sequence[str], class_name: str, base: str) -> DataFrame:
    """Table rows as triples: one type triple and one literal per property."""
    subject = F.concat(F.lit(base), F.col(id_col).cast("string"))
    types = df.select(subject.alias("subject"), F.lit(RDF_TYPE).alias("predicate"), F.lit(class_name).alias("object"))
    props = to_props(df, id_col, columns)
    literals = props.select(
        F.concat(F.lit(base), F.col("id").cast("string")).alias("subject"),
        F.concat(F.lit(base), F.col("prop")).alias("predicate"),
        F.concat(F.lit('"'), F.col("value"), F.lit('"')).alias("object"),
    )
    return types.unionByName(literals)


def transform_property(props: DataFrame, prop: str, chain: Sequence[str | tuple], alias: str | None = None) -> DataFrame:
    """Run a transform chain over one property, optionally renaming it."""
    mine = F.col("prop") == prop
    return props.select(
        "id",
        F.when(mine, F.lit(alias or prop)).otherwise(F.col("prop")).alias("prop"),
        F.when(mine, prep.apply(F.col("value"), chain)).otherwise(F.col("value")).alias("value"),
    )


def add_property(props: DataFrame, prop: str, new: str, chain: Sequence[str | tuple]) -> DataFrame:
    """As ``transform_property``, but the old property stays. One scan: rows fan out."""
    extra = F.struct(F.lit(new).alias("prop"), prep.apply(F.col("value"), chain).alias("value"))
    same = F.struct(F.col("prop").alias("prop"), F.col("value").alias("value"))
    both = F.when(F.col("prop") == prop, F.array(same, extra)).otherwise(F.array(same))
    return props.select("id", F.explode(both).alias("r")).select("id", "r.prop", "r.value")


def list_properties(props: DataFrame) -> DataFrame:
    return props.select("prop").distinct()


def draw(*columns: str | Column) -> Column:
    """Reproducible random order: md5 over the key, the same on any engine."""
    return F.md5(F.concat_ws("|", *columns))


def sample_entities(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """n random rows, the same ones each time."""
    return df.orderBy(draw(F.col(id_col).cast("string")), id_col).limit(n)


def trim_to_links(df: DataFrame, id_col: str, links: DataFrame, side: str = "source") -> DataFrame:
    """Rows that occur in a link set."""
    return df.join(links.select(F.col(side).alias(id_col)).distinct(), id_col, "left_semi")


def trim_examples(links: DataFrame, n: int, random: bool = True) -> DataFrame:
    """n sources of a link set (random, or first by id) with one random target each."""
    order = F.struct(draw(F.col("source").cast("string"), F.col("target").cast("string")), F.col("target"))
    one = links.groupBy("source").agg(F.min_by("target", order).alias("target"))
    by = [draw(F.col("source").cast("string")), F.col("source")] if random else [F.col("source")]
    return one.orderBy(*by).limit(n)


def balanced_examples(src: DataFrame, tgt: DataFrame, id_col: str, links: DataFrame, n: int) -> DataFrame:
    """n random pairs and up to n/2 known links (known = true).

    The k-th of n drawn sources meets the k-th of n drawn targets; only the 2n drawn
    rows are numbered.
    """

    def drawn(df: DataFrame, name: str, salt: str) -> DataFrame:
        key = draw(F.lit(salt), F.col(id_col).cast("string"))
        top = df.select(F.col(id_col).alias(name), key.alias("_d")).orderBy("_d", name).limit(n)
        return top.withColumn("_k", F.row_number().over(Window.orderBy("_d", name))).drop("_d")

    random = drawn(src, "source", "s").join(drawn(tgt, "target", "t"), "_k").select("source", "target", F.lit(False).alias("known"))
    order = [draw(F.col("source").cast("string"), F.col("target").cast("string")), F.col("source"), F.col("target")]
    known = links.select("source", "target").orderBy(*order).limit(n // 2).withColumn("known", F.lit(True))
    pairs = random.unionByName(known)
    return pairs.groupBy("source", "target").agg(F.max("known").alias("known"))
