"""Data jobs behind rule learning: sweeps, property pairs, rankings, labelling, gold sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.common import once
from entitylink.operators.entities import draw
from entitylink.operators.evaluate import _with_prf
from entitylink.operators.setjoin import exact_join
from entitylink.operators.values import expand_links, parted_links, value_members, value_table
from entitylink.session import materialize

PAIR = ["source", "target"]


def threshold_sweep(links: DataFrame, gold: DataFrame, thetas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """P/R/F of scored links cut at each threshold, and the best cut marked.

    Links are scored once. Each is counted at the largest threshold it passes; the
    cumulative sums then run over the grid, not over the links.
    """
    by = list(by)
    marked = gold.select(*PAIR).distinct().withColumn("g", F.lit(1))
    counts = (
        links.join(marked, PAIR, "left")
        .groupBy(*by, _step(thetas).alias("step"))
        .agg(F.count("*").alias("n"), F.count("g").alias("hit"))
    )
    return _swept(counts, marked.agg(F.count("*")).scalar(), thetas, by)


def _step(thetas: Sequence[float]) -> Column:
    """How many of the thresholds ``sim`` passes."""
    return F.size(F.filter(F.array(*map(F.lit, sorted(map(float, thetas)))), lambda t: F.col("sim") >= t))


def _swept(counts: DataFrame, n_gold: Column, thetas: Sequence[float], by: list[str]) -> DataFrame:
    """``threshold_sweep`` of the links (n) and right links (hit) at each step."""
    grid = sorted(float(t) for t in thetas)
    # at most one row per rule and threshold from here on
    cuts = counts.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    passed = F.col("step") >= F.col("_cut")
    cuts = cuts.groupBy(*by, "_cut").agg(
        F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("n_pred"), F.sum(F.when(passed, F.col("hit")).otherwise(0)).alias("tp")
    )
    cuts = cuts.withColumn("theta", F.element_at(F.array(*map(F.lit, grid)), F.col("_cut")))
    cuts = cuts.withColumn("n_gold", n_gold)
    rated = _with_prf(cuts, *by, "theta")
    w = Window.partitionBy(*by).orderBy(F.desc("f"), F.desc("theta")) if by else Window.orderBy(F.desc("f"), F.desc("theta"))
    return rated.withColumn("best", F.row_number().over(w) == 1)


def rank_rules(scored: DataFrame, gold: DataFrame, thetas: Sequence[float]) -> DataFrame:
    """Best threshold and F of each rule. scored: rule, source, target, sim."""
    return _best(threshold_sweep(scored, gold, thetas, ["rule"]))


def _best(swept: DataFrame) -> DataFrame:
    return swept.where("best").select("rule", "theta", "precision", "recall", "f")


def rank_joins(
    src_props: DataFrame,
    tgt_props: DataFrame,
    gold: DataFrame | tuple[DataFrame, DataFrame],
    measures: dict[str, Callable[[DataFrame, DataFrame, str, str, float], DataFrame]],
    thetas: Sequence[float],
) -> DataFrame:
    """Run every measure over every pair of textual properties and rank the rules found.

    ``measures``: joins (src, tgt, id column, value column, theta) that return value links.
    One join runs per pair of properties and measure, at the smallest threshold; the
    pairs of properties are few. ``rule`` reads measure(source property, target property).
    ``gold``: pairs, or (id, key) of both sides where every pair with equal keys is gold.

    Entity pairs are counted behind their value links. Those of entities with several values
    are listed, no others; nor are gold pairs that equal keys tell.
    """
    pairs = property_pairs(src_props, tgt_props).where("kind = 'string'").orderBy("source_prop", "target_prop").collect()
    keys, n_gold = _gold_keys(gold)
    counts = None
    for pair in pairs:
        s = materialize(src_props.where(F.col("prop") == pair.source_prop).select("id", "value"), "property")
        t = materialize(tgt_props.where(F.col("prop") == pair.target_prop).select("id", "value"), "property")
        members = [materialize(value_members(x, "id", "value"), "members") for x in (s, t)]
        for name, join in measures.items():
            rule = F.lit(f"{name}({pair.source_prop},{pair.target_prop})")
            found = _counted(materialize(join(s, t, "id", "value", min(thetas)), "value-links"), *members, keys, _step(thetas))
            found = found.select(rule.alias("rule"), "step", "n", "hit")
            counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        none = "rule string, theta double, precision double, recall double, f double"
        return src_props.sparkSession.createDataFrame([], none)
    counts = materialize(counts.groupBy("rule", "step").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")), "counts")
    return _best(_swept(counts, n_gold, thetas, ["rule"]))


def _gold_keys(gold: DataFrame | tuple[DataFrame, DataFrame]) -> tuple[list[DataFrame], Column]:
    """Gold as (id, key) of both sides, no pair with two equal keys, and the number of its pairs."""
    if not isinstance(gold, DataFrame):
        sides = [materialize(df.select("id", "key").dropna().distinct(), "gold") for df in gold]
        if all(df.groupBy("id").count().where("count > 1").isEmpty() for df in sides):
            sizes = [df.groupBy("key").agg(F.count("*").alias(n)) for df, n in zip(sides, "st")]
            return sides, sizes[0].join(sizes[1], "key").agg(F.coalesce(F.sum(F.col("s") * F.col("t")), F.lit(0))).scalar()
        gold = gold_pairs(*sides, "id", "key")
    # a source is a key of its own
    gold = materialize(gold.select(*PAIR).dropna().distinct(), "gold")
    source = F.col("source").alias("key")
    return [gold.select(F.col("source").alias("id"), source).distinct(), gold.select(F.col("target").alias("id"), source)], gold.agg(F.count("*")).scalar()


def _counted(links: DataFrame, src_members: DataFrame, tgt_members: DataFrame, keys: list[DataFrame], step: Column) -> DataFrame:
    """(step, n, hit): entity pairs behind value links, and how many of them are gold, in parts."""
    *single, again = parted_links(links, src_members, tgt_members)
    ends = [F.struct(F.col(c).alias("id"), F.col(k).alias("h")).alias(f"rep_{c[0]}") for c, k in (("source", "key_s"), ("target", "key_t"))]
    rows = links.select(*ends, step.alias("step"), "n_source", "n_target")
    n = F.col("n_source") * F.col("n_target")
    if again is not None:
        for x, df in zip("st", single):
            rows = rows.join(df.groupBy(F.col("rep").alias(f"rep_{x}")).agg(F.count("*").alias(f"n_{x}")), f"rep_{x}")
        n = F.col("n_s") * F.col("n_t")
    held = []
    for x, df, gold in zip("st", single, keys):
        own = df.join(gold.withColumnRenamed("id", "member"), "member").groupBy(F.col("rep").alias(f"rep_{x}"), "key")
        held.append(own.agg(F.count("*").alias(f"gold_{x}")))
    hits = rows.select("rep_s", "rep_t", "step").join(held[0], "rep_s").join(held[1], ["rep_t", "key"])
    none = F.lit(0).cast("long")
    out = rows.groupBy("step").agg(F.sum(n).alias("n")).withColumn("hit", none)
    out = out.unionByName(hits.groupBy("step").agg(F.sum(F.col("gold_s") * F.col("gold_t")).alias("hit")).withColumn("n", none))
    if again is not None:
        again = materialize(again, "many-valued-pairs")
        s, t = (gold.select(F.col("id").alias(c), "key") for gold, c in zip(keys, PAIR))
        hits = again.join(s, "source").join(t, ["target", "key"])
        out = out.unionByName(again.groupBy(step.alias("step")).agg(F.count("*").alias("n")).withColumn("hit", none))
        out = out.unionByName(hits.groupBy(step.alias("step")).agg(F.count("*").alias("hit")).withColumn("n", none))
    return out


def property_kinds(props: DataFrame) -> DataFrame:
    """(prop, kind): number, date, points or string, when every value is one."""
    v = F.trim("value")
    share = {
        "number": v.try_cast("double").isNotNull(),
        "date": v.rlike(r"^\d{4}-\d\d?-\d\d?") & F.substring(v, 1, 10).try_cast("date").isNotNull(),
        "points": v.rlike(r"^[A-Za-z ]*\(.*\)$"),
    }
    profile = props.groupBy("prop").agg(*[F.min(test.cast("int")).alias(k) for k, test in share.items()])
    kind = F.lit("string")
    for k in reversed(list(share)):
        kind = F.when(F.col(k) == 1, k).otherwise(kind)
    return profile.select("prop", kind.alias("kind"))


def property_pairs(src_props: DataFrame, tgt_props: DataFrame) -> DataFrame:
    """Source and target properties of the same kind."""
    s = property_kinds(src_props).select(F.col("prop").alias("source_prop"), "kind")
    t = property_kinds(tgt_props).select(F.col("prop").alias("target_prop"), "kind")
    return s.join(t, "kind").select("source_prop", "target_prop", "kind")


def controversy(votes: DataFrame, k: int, n: int, asked: DataFrame | None = None) -> DataFrame:
    """n pairs the k link sets disagree on most, one per source, none asked before.

    votes: one row per link set and pair. Ties go to more votes, then smaller ids.
    """
    if asked is not None:
        votes = votes.join(asked.select(*PAIR), PAIR, "left_anti")
    per = votes.groupBy(*PAIR).agg(F.count("*").alias("votes"))
    per = per.withColumn("off", F.abs(F.col("votes") - k // 2))
    order = F.struct("off", -F.col("votes"), "target")
    one = per.groupBy("source").agg(F.min_by(F.struct("target", "votes", "off"), order).alias("b"))
    one = one.select("source", "b.target", "b.votes", (F.col("b.votes") / k).alias("sim"), "b.off")
    return one.orderBy("off", F.desc("votes"), "source").limit(n).drop("off")


def gold_from_key(src: DataFrame, tgt: DataFrame, id_col: str, key: str, group: str, noise: int) -> DataFrame:
    """Gold links from a shared key, and per side and group some unlinked entities.

    kind: link (source, target: smallest ids of the key; n_source, n_target: how many
    entities of each side have it, which ``gold_pairs`` lists), source_noise, target_noise.
    Noise is the first ``noise`` entities of a group in a fixed random order; the
    row_number limit reaches below the shuffle, so big groups are cut before it.
    """
    both = value_table(src, tgt, id_col, key).where((F.col("n_source") > 0) & (F.col("n_target") > 0))
    links = both.select(F.lit("link").alias("kind"), F.col("source.id").alias("source"), F.col("target.id").alias("target"), "n_source", "n_target")

    def extra(df: DataFrame, other: DataFrame, kind: str, side: str) -> DataFrame:
        lone = df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        w = Window.partitionBy(group).orderBy(draw(F.col(id_col).cast("string")), id_col)
        lone = lone.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= noise)
        none = F.lit(None).cast(df.schema[id_col].dataType)
        ids = (F.col(id_col), none) if side == "source" else (none, F.col(id_col))
        return lone.select(F.lit(kind).alias("kind"), ids[0].alias("source"), ids[1].alias("target"), F.lit(0).cast("long").alias("n_source"), F.lit(0).cast("long").alias("n_target"))

    return links.unionByName(extra(src, tgt, "source_noise", "source")).unionByName(extra(tgt, src, "target_noise", "target"))


def gold_pairs(src: DataFrame, tgt: DataFrame, id_col: str, key: str) -> DataFrame:
    """Every pair of entities with equal keys, in tiles."""
    links = exact_join(src, tgt, id_col, key)
    return expand_links(links, value_members(src, id_col, key), value_members(tgt, id_col, key)).select(*PAIR)


def custom_join(
    src: DataFrame, tgt: DataFrame, id_col: str, candidates: DataFrame, scorer: Callable[[Column, Column], Column] | Column, theta: float
) -> DataFrame:
    """Score candidate pairs with any Column over ``<name>_s``/``<name>_t``."""
    columns = [c for c in src.columns if c in tgt.columns and c != id_col]
    s = src.select(F.col(id_col).alias("source"), *[F.col(c).alias(f"{c}_s") for c in columns])
    t = tgt.select(F.col(id_col).alias("target"), *[F.col(c).alias(f"{c}_t") for c in columns])
    rows = candidates.select(*PAIR).join(s, "source").join(t, "target")
    return rows.select(*PAIR, scorer.alias("sim")).where(F.col("sim") >= theta)


def slide_points(pts: Column, t: float) -> Column:
    """Move every point the share ``t`` along the edge to the next (the last to the first)."""

    def slide(ring: Column) -> Column:
        def move(p: Column, i: Column) -> Column:
            q = F.get(ring, F.pmod(i + 1, F.size(ring)))
            return F.struct((p.lat + (q.lat - p.lat) * t).alias("lat"), (p.lon + (q.lon - p.lon) * t).alias("lon"))

        return F.transform(ring, move)

    return once(pts, slide)


def _unit(*parts: Column) -> Column:
    """Number in [0, 1) drawn by its arguments, the same on any engine."""
    drawn = draw(*[p.cast("string") for p in parts])
    return F.conv(F.substring(drawn, 1, 7), 16, 10).cast("double") / float(1 << 28)


def drop_points(id_col: Column, pts: Column, probability: float) -> Column:
    """Drop each point with a probability; the first one stays."""
    return F.filter(pts, lambda p, i: (i == 0) | (_unit(id_col, i) >= probability))


def jitter_points(id_col: Column, pts: Column, bound: float) -> Column:
    """Add an error below ``bound`` to both coordinates."""

    def move(p: Column, i: Column) -> Column:
        lat = p.lat + (_unit(id_col, i, F.lit(0)) * 2 - 1) * bound
        lon = p.lon + (_unit(id_col, i, F.lit(1)) * 2 - 1) * bound
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.transform(pts, move)
