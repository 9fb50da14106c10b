"""Link rules as joins: no pair is listed that a pruned join did not find.

A rule is a tree of atoms. An atom alone is a similarity join over the distinct values
of one property. AND joins its first part and looks at the others only on the pairs that
are left, each distinct pair of values once; put the most selective atom first. OR is a
union, MINUS an anti join, XOR what one side alone has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions import strings
from entitylink.functions import tokens as tok
from entitylink.functions.tokens import block_tokens
from entitylink.operators import blocking, editjoin, setjoin
from entitylink.operators.links import best_target, links_and, links_minus, links_or, links_xor, threshold
from entitylink.operators.values import expand_links, value_members, value_table, with_counts
from entitylink.plans.linker import to_sources
from entitylink.session import materialize


def _levenshtein(a: Column, b: Column) -> Column:
    return 1 / (1 + F.levenshtein(a, b)).cast("double")


def _set_score(elems: Callable[[Column], Column], name: str):
    measure = setjoin.Measure(name, 1.0)

    def score(a: Column, b: Column) -> Column:
        x, y = elems(a), elems(b)
        return measure.sim(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))

    return score


# Of each measure, its pruned join and what it gives a single pair.
MEASURES = {
    "exact": (lambda s, t, i, v, theta: setjoin.exact_join(s, t, i, v), lambda a, b: (a == b).cast("double")),
    "levenshtein": (editjoin.levenshtein_join, _levenshtein),
    "jaro": (editjoin.jaro_join, strings.jaro),
    "jaro_winkler": (editjoin.jaro_winkler_join, strings.jaro_winkler),
    "ratcliff": (editjoin.ratcliff_join, strings.ratcliff),
    "jaccard": (setjoin.jaccard_join, _set_score(tok.bag, "jaccard")),
    "cosine": (setjoin.cosine_join, _set_score(tok.bag, "cosine")),
    "dice": (setjoin.dice_join, _set_score(tok.bag, "dice")),
    "qgram": (setjoin.qgram_join, _set_score(lambda v: tok.qgrams(v, 3), "jaccard")),
}


@dataclass(frozen=True)
class Atom:
    """A measure of one property that reaches ``theta``."""

    measure: str
    prop: str
    theta: float


@dataclass(frozen=True, init=False)
class And:
    """All parts hold; the smallest similarity."""

    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", parts)


class Or(And):
    """Some part holds; the largest similarity."""


class Minus(And):
    """The first part holds and no other does; the first's similarity."""


class Xor(And):
    """One of two parts holds alone; its similarity."""


def properties(rule) -> set[str]:
    return {rule.prop} if isinstance(rule, Atom) else set().union(*map(properties, rule.parts))


def rule_pairs(rule, src: DataFrame, tgt: DataFrame, id_col: str) -> DataFrame:
    """(source, target, sim) of all pairs that satisfy ``rule``.

    Both sides have a column for each property, compared as strings. A missing value
    satisfies no atom. An entity with several rows keeps its larger similarity. Entities
    whose rows are equal in all properties of the rule are one until the pairs are found.
    """
    names = sorted(properties(rule))
    shape = ", ".join(f"`{n}` string" for n in names)
    row = F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]))
    sides = [df.groupBy(id_col).agg(F.array_sort(F.collect_set(row)).alias("_rows")) for df in (src, tgt)]
    sides = [materialize(df, "rule-entities") for df in sides]
    records = materialize(value_table(*sides, id_col, "_rows"), "rule-records")

    def record_rows(side: str) -> DataFrame:
        rows = records.where(F.col(side).isNotNull()).select(F.col(side).alias("id"), F.explode("value").alias("r"))
        return materialize(rows.select("id", F.from_json("r", shape).alias("r")).select("id", "r.*"), "record-rows")

    links = with_counts(_rule_pairs(rule, record_rows("source"), record_rows("target"), "id"), records)
    return expand_links(links, *[value_members(df, id_col, "_rows") for df in sides])


def _rule_pairs(rule, src: DataFrame, tgt: DataFrame, id_col: str, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs that satisfy ``rule``, or those among ``pairs``."""
    if isinstance(rule, Atom):
        return _atom_pairs(rule, src, tgt, id_col) if pairs is None else _atom_on_pairs(rule, src, tgt, id_col, pairs)
    first, *rest = rule.parts
    if isinstance(rule, Or):
        # each part on its own: a pair may satisfy any of them
        parts = [_rule_pairs(p, src, tgt, id_col, pairs) for p in rule.parts]
        out = parts[0]
        for p in parts[1:]:
            out = links_or(out, p)
        return out
    if isinstance(rule, Xor):
        return links_xor(*[_rule_pairs(p, src, tgt, id_col, pairs) for p in rule.parts])
    left = materialize(_rule_pairs(first, src, tgt, id_col, pairs), "rule-pairs")
    for part in rest:
        found = _rule_pairs(part, src, tgt, id_col, left.select("source", "target"))
        left = materialize(links_minus(left, found) if isinstance(rule, Minus) else links_and(left, found), "rule-pairs")
    return left


def _atom_pairs(atom: Atom, src: DataFrame, tgt: DataFrame, id_col: str) -> DataFrame:
    join, _ = MEASURES[atom.measure]
    sides = [df.select(id_col, F.col(atom.prop).cast("string").alias("_v")) for df in (src, tgt)]
    links = materialize(join(*sides, id_col, "_v", atom.theta), "atom-links")
    members = [materialize(value_members(df, id_col, _form(atom.measure)), "atom-members") for df in sides]
    return expand_links(links, *members)


def _form(measure: str) -> Column:
    """The values as a join of this measure keys them."""
    value = F.col("_v")
    return {"jaro_winkler": strings.winkler_form(value), "ratcliff": F.lower(value)}.get(measure, value)


def _atom_on_pairs(atom: Atom, src: DataFrame, tgt: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    _, score = MEASURES[atom.measure]

    def side(df: DataFrame, name: str, value: str) -> DataFrame:
        value_of = df.select(F.col(id_col).alias(name), F.col(atom.prop).cast("string").alias("_v"))
        return value_of.select(name, _form(atom.measure).alias(value)).where(F.col(value).isNotNull()).distinct()

    rows = pairs.join(side(src, "source", "_a"), "source").join(side(tgt, "target", "_b"), "target")
    rows = materialize(rows, "atom-rows")
    scores = rows.select("_a", "_b").distinct().withColumn("sim", score(F.col("_a"), F.col("_b")))
    scores = materialize(scores.where(F.col("sim") >= atom.theta), "atom-scores")
    return rows.join(scores, ["_a", "_b"]).groupBy("source", "target").agg(F.max("sim").alias("sim"))


def link_by_rule(src: DataFrame, tgt: DataFrame, id_col: str, rule, accept: float, block_on: Column | None = None, purging: bool = True) -> DataFrame:
    """Best target per source by a rule, (source, target, sim) with sim >= ``accept``.

    With ``block_on``, only pairs that share a kept block token of it count (all tokens with
    a partner if not ``purging``): the pairs the rule found are held against the tokens, no
    block lists its pairs. Entities that are equal in all of this are one record, so copies
    make no pairs.
    """
    names = sorted(properties(rule))
    text = (F.lit(None) if block_on is None else block_on).cast("string")
    fields = F.struct(*[F.col(n).cast("string").alias(n) for n in names], text.alias("_text"))
    shape = f"{', '.join(f'`{n}` string' for n in names)}, _text string"
    record = F.to_json(fields)
    records = value_table(src, tgt, id_col, record)
    records = materialize(records.select("source", "target", F.from_json("value", shape).alias("r")).select("source", "target", "r.*"), "records")
    s = records.where(F.col("source").isNotNull()).select(F.col("source").alias("id"), *names, "_text")
    t = records.where(F.col("target").isNotNull()).select(F.col("target").alias("id"), *names, "_text")
    links = threshold(_rule_pairs(rule, s, t, "id"), accept)
    if block_on is not None:
        links = _in_blocks(materialize(links, "rule-links"), s, t, _kept(src, tgt, id_col, block_on, purging))
    return to_sources(best_target(links), src, id_col, record)


def _kept(src: DataFrame, tgt: DataFrame, id_col: str, block_on: Column, purging: bool) -> DataFrame:
    """(token) of the kept blocks."""
    tokens = materialize(blocking.token_blocking(blocking.tag(src, tgt, id_col, block_on)), "tokens")
    sizes = materialize(blocking.block_sizes(tokens), "sizes")
    on = F.col("size") > 1
    if purging:
        on = on & (F.col("size") <= blocking.optimal_block_size(sizes).scalar())
    return sizes.where(on).select("token")


def _in_blocks(links: DataFrame, s: DataFrame, t: DataFrame, kept: DataFrame) -> DataFrame:
    """Those links whose records share a kept token."""
    tokens = block_tokens(blocking.strip_literal(F.col("_text")))
    rows = links.join(s.select(F.col("id").alias("source"), tokens.alias("_x")), "source").join(t.select(F.col("id").alias("target"), tokens.alias("_y")), "target")
    rows = rows.select("source", "target", "sim", F.explode(F.array_intersect("_x", "_y")).alias("token"))
    return rows.join(kept, "token", "left_semi").select("source", "target", "sim").distinct()
