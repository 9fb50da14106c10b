"""Character-based joins: levenshtein, jaro, jaro-winkler, ratcliff, soundex, monge-elkan.

Each join proves a least number of shared characters or q-grams for its threshold and
finds candidates with the prefix filter; the measure itself runs on the survivors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from entitylink.functions import strings
from entitylink.functions import tokens as tok
from entitylink.operators.editprefix import edit_pairs
from entitylink.operators.prefix import IDS, with_sides
from entitylink.operators.setjoin import Measure
from entitylink.operators.skew import attach, pair_join
from entitylink.operators.tilejoin import SPREAD, Test, numbered_values, tile_links, up
from entitylink.operators.values import flat_links, value_table, with_counts
from entitylink.session import materialize

# Values of a side of a tile of ``monge_elkan_join``; smaller inputs are cut into SPREAD parts of
# at least MONGE_PART.
MONGE_SIDE, MONGE_PART = 1 << 14, 1 << 9


def key_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (source, target) sharing a ``key``. Rows carry source or target."""
    rows = materialize(rows, "keys")
    n = materialize(rows.groupBy("key").agg(F.count("source").alias("n_s"), F.count("target").alias("n_t")), "key_sizes")
    n = n.withColumn("n", F.col("n_s") + F.col("n_t"))
    rows = attach(rows, n, "key", "n", ["source", "target"]).where((F.col("n_s") > 0) & (F.col("n_t") > 0))
    left = rows.where(F.col("source").isNotNull()).select("key", "source", "n_s", "n_t")
    right = rows.where(F.col("target").isNotNull()).select("key", "target", "n_s", "n_t")
    return pair_join(left, right, "key", "source", "target", "n_s", "n_t").select("source", "target").distinct()


def _sides_as_keys(values: DataFrame, keys: Column) -> DataFrame:
    """One row per (side, key) from rows that may belong to both sides."""
    rows = values.select("source", "target", F.explode(keys).alias("key"))
    none_s = F.lit(None).cast(values.schema["source"].dataType).alias("source")
    none_t = F.lit(None).cast(values.schema["target"].dataType).alias("target")
    s = rows.where(F.col("source").isNotNull()).select("source", none_t, "key")
    return s.unionByName(rows.where(F.col("target").isNotNull()).select(none_s, "target", "key"))


def _part(n: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of part ``i`` of k + 1 near-equal parts of ``n`` characters."""
    at = F.floor(i * n / (k + 1)).cast("int")
    return at, F.floor((i + 1) * n / (k + 1)).cast("int") - at


def edit_parts(text: Column, k: int) -> Column:
    """Keys of a value's k + 1 parts: its length, the part's number, the part."""
    n = F.char_length(text)

    def key(i: Column) -> Column:
        at, size = _part(n, i, k)
        return F.concat_ws(":", n.cast("string"), i.cast("string"), F.substring(text, at + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), key)


def edit_reach(text: Column, k: int) -> Column:
    """Keys of ``edit_parts`` that a value within ``k`` edits of ``text`` can have: k edits
    leave one of k + 1 parts whole, at most k places from where it was."""
    n = F.char_length(text)

    def of_part(m: Column, i: Column) -> Column:
        at, size = _part(m, i, k)
        first, last = F.greatest(at - k, F.lit(0)), F.least(at + k, n - size)
        head = F.concat_ws(":", m.cast("string"), i.cast("string"), F.lit(""))
        found = F.transform(F.sequence(first, F.greatest(last, first)), lambda p: F.concat(head, F.substring(text, p + 1, size)))
        return F.when(last >= first, found).otherwise(F.array().cast("array<string>"))

    def of_length(m: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: of_part(m, i)))

    lengths = F.sequence(F.greatest(n - k, F.lit(0)), n + k)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def levenshtein_join(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str, theta: float, q: int = 2) -> DataFrame:
    """sim = 1/(1 + edits), edits <= floor((1-theta)/theta)."""
    k = math.floor((1 - theta) / theta + 1e-9)
    values = materialize(value_table(src, tgt, id_col, value), "values")
    pairs = edit_pairs(values, k, q)
    # Two short values may share no gram; a part of one stands in the other.
    short = values.where(F.char_length("value") <= k * q + q - 1)
    none_s = F.lit(None).cast(values.schema["source"].dataType).alias("source")
    none_t = F.lit(None).cast(values.schema["target"].dataType).alias("target")
    keys = short.where(F.col("source").isNotNull()).select("source", none_t, F.explode(edit_parts(F.col("value"), k)).alias("key"))
    reach = short.where(F.col("target").isNotNull()).select(none_s, "target", F.explode(edit_reach(F.col("value"), k)).alias("key"))
    pairs = pairs.unionByName(key_pairs(keys.unionByName(reach))).distinct()
    edits = F.levenshtein("v_s", "v_t", k)
    found = with_sides(pairs, values, v=F.col("value")).withColumn("d", edits).where(F.col("d") >= 0)
    return with_counts(found.select("source", "target", (1 / (1 + F.col("d"))).alias("sim")), values)


def _char_join(src: DataFrame, tgt: DataFrame, id_col: str, value: Column, test: Test) -> DataFrame:
    """Join on a measure that needs ``alpha(a, b)`` common characters, scored where a pair has them."""
    values = value_table(src, tgt, id_col, value).withColumn("row", F.monotonically_increasing_id())
    values = materialize(values.withColumn("elems", tok.char_bag(F.col("value"))), "values")
    return flat_links(tile_links(numbered_values(values), test, "value"))


def _jaro_alpha(theta, a, b):
    """m/a + m/b + 1 >= 3*theta bounds the common characters m."""
    return up(np.asarray(a, dtype=np.float64) * b * (3 * theta - 1) / (a + b))


def jaro_join(src, tgt, id_col, value: Column | str, theta: float) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return _char_join(src, tgt, id_col, value, Test(theta, lambda a, b, lead: _jaro_alpha(theta, a, b), score=strings.jaro_of, pairs=strings.JaroPairs))


def jaro_winkler_join(src, tgt, id_col, value: Column | str, theta: float) -> DataFrame:
    """Values are compared trimmed and upper-cased, so equal forms are one value.

    A pair with k equal leading non-digits is boosted by k tenths of what is missing, so it
    needs a Jaro similarity of (theta - k/10) / (1 - k/10).
    """
    value = F.col(value) if isinstance(value, str) else value

    def alpha(a, b, lead):
        return _jaro_alpha((theta - 0.1 * lead) / (1 - 0.1 * lead), a, b)

    test = Test(theta, alpha, score=strings.jaro_winkler_of, leads=strings.winkler_leads, most=strings.WINKLER_LEAD)
    return _char_join(src, tgt, id_col, strings.winkler_form(value), test)


def ratcliff_join(src, tgt, id_col, value: Column | str, theta: float) -> DataFrame:
    """Values are compared lower-cased, so equal forms are one value."""
    value = F.col(value) if isinstance(value, str) else value
    return _char_join(src, tgt, id_col, F.lower(value), Test(theta, Measure("dice", theta).alpha, score=strings.ratcliff_of))


def soundex_join(src, tgt, id_col, value: Column | str, theta: float) -> DataFrame:
    """sim = 1 - differing code positions / 6. Links join codes, not values."""
    value = F.col(value) if isinstance(value, str) else value
    size = strings.SOUNDEX_LENGTH
    d = math.floor(size * (1 - theta) + 1e-9)
    codes = materialize(value_table(src, tgt, id_col, strings.soundex_code(value)), "codes")
    # d differences leave one of d + 1 parts untouched (all of them may differ at d = 6).
    cuts = [size * i // (d + 1) for i in range(d + 2)]
    parts = [
        F.concat(F.lit(f"{i}:"), F.substring("value", lo + 1, hi - lo)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    pairs = key_pairs(_sides_as_keys(codes, F.array(*parts)))
    scored = with_sides(pairs, codes, v=F.col("value")).withColumn("h", strings.hamming(F.col("v_s"), F.col("v_t"), size))
    scored = scored.where(F.col("h") <= d).select("source", "target", (1 - F.col("h") / size).alias("sim"))
    return with_counts(scored, codes)


def monge_elkan_join(src, tgt, id_col, value: Column | str, theta: float) -> DataFrame:
    """Mean over the source's words of the best bigram dice among the target's words.

    Each side is dealt to parts at random and a tile is one part against another. There the best
    dice of each distinct source word is looked up once for all targets, so a pair costs an addition
    for each of its words, and no list of pairs is shuffled.
    """
    values = value_table(src, tgt, id_col, value).withColumn("words", tok.blank_words(F.col("value"))).drop("value")
    values = materialize(values.where(F.size("words") > 0), "values")
    size = values.agg(*[F.count(c).alias(c) for c in IDS]).first()
    parts = [max(-(-size[c] // MONGE_SIDE), min(-(-size[c] // MONGE_PART), SPREAD)) for c in IDS]

    def dealt(k: int) -> DataFrame:
        """Rows of one side in the tiles of their part."""
        own, others = F.pmod(F.xxhash64(IDS[k]), F.lit(max(parts[k], 1))), F.sequence(F.lit(0), F.lit(max(parts[1 - k], 1) - 1))
        ids = [F.col(c) if c == IDS[k] else F.lit(None).cast(values.schema[c].dataType).alias(c) for c in IDS]
        rows = values.where(F.col(IDS[k]).isNotNull()).select(own.cast("int").alias("own"), F.explode(others).alias("other"), *ids, F.col(f"n_{IDS[k]}").alias("copies"), "words")
        at = F.col("own") * max(parts[1], 1) + F.col("other") if k == 0 else F.col("other") * max(parts[1], 1) + F.col("own")
        return rows.select(at.cast("int").alias("tile"), *IDS, "copies", "words")

    fields = [values.schema[c] for c in (*IDS, "n_source", "n_target")]
    schema = StructType([StructField(f.name, f.dataType) for f in fields[:2]] + [StructField("sim", DoubleType())] + [StructField(f.name, f.dataType) for f in fields[2:]])

    def of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        one = rows["source"].is_valid().to_numpy()
        words, copies = rows["words"].combine_chunks(), rows["copies"].combine_chunks()
        s, t = np.flatnonzero(one), np.flatnonzero(~one)
        for i, j, sim in strings.monge_elkan(words.take(pa.array(s)), words.take(pa.array(t)), theta):
            i, j = pa.array(s[i]), pa.array(t[j])
            found = [rows["source"].combine_chunks().take(i), rows["target"].combine_chunks().take(j), pa.array(sim, pa.float64()), copies.take(i), copies.take(j)]
            yield pa.RecordBatch.from_arrays(found, names=schema.names)

    both = dealt(0).unionByName(dealt(1)).repartition(max(parts[0] * parts[1], 1), "tile")
    return flat_links(both.groupBy("tile").applyInArrow(of_tile, schema))
