"""Group statistics (A1-A21) as aggregate-then-attach plans.

Rules followed throughout:

* aggregate with ``groupBy`` (partial aggregation before the shuffle, so a
  hot key costs one row per map task), then attach the aggregate to the
  rows with a size-checked broadcast (``joins.attach``) - never a
  ``Window.partitionBy(key)`` that ships a whole hot group to one task;
* several groupings of the same rows are derived from one finest
  aggregate (sums and counts roll up) or one ``GROUPING SETS`` pass;
* pandas drops null keys from ``groupby``; Spark keeps a null group, so the
  operators filter null keys first where the reference semantics need it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import col, words_space
from quire.operators.joins import attach, bounded, fits_broadcast, materialize, side


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def not_null(*cols) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def group_stats(df: DataFrame, keys, aggs: dict[str, F.Column], drop_null_keys: bool = False) -> DataFrame:
    """One aggregate table: ``keys`` + named aggregate columns."""
    keys = _list(keys)
    src = df.where(not_null(*keys)) if drop_null_keys else df
    return src.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def attach_group_stats(df: DataFrame, keys, aggs: dict[str, F.Column],
                       drop_null_keys: bool = False) -> DataFrame:
    """``groupby(keys)[...].transform(f)`` as aggregate + join."""
    keys = _list(keys)
    return attach(df, group_stats(df, keys, aggs, drop_null_keys), keys)


class SetTables(dict):
    """Per-set tables of one written GROUPING SETS result; ``small`` says
    whether the whole result (hence every subset) is within broadcast bounds."""
    small: bool = False


def grouping_sets_stats(df: DataFrame, sets: dict[str, list[str]],
                        aggs: dict[str, F.Column]) -> SetTables:
    """Several groupings in one scan: ``GROUPING SETS`` with a ``grouping_id``
    per set; returns one small table per set name."""
    all_keys = sorted({k for ks in sets.values() for k in ks})
    agg_cols = [a.alias(n) for n, a in aggs.items()] + [F.grouping_id(*all_keys).alias("_gid")]
    gs = [[F.col(k) for k in ks] for ks in sets.values()]
    stats = materialize(df.groupingSets(gs, *all_keys).agg(*agg_cols))
    out = SetTables()
    out.small = fits_broadcast(stats)
    for name, ks in sets.items():
        gid = sum(1 << (len(all_keys) - 1 - i) for i, k in enumerate(all_keys) if k not in ks)
        out[name] = stats.where(F.col("_gid") == gid).select(*ks, *aggs.keys())
    return out


def entropy_from_counts(counts: DataFrame, parent, child, weight: str, name: str) -> DataFrame:
    """A10-A12 core on a pre-aggregated table: for each non-null parent,
    ``sum(-ln(p) * p)`` over non-null children, p = child weight / parent
    weight (the parent weight includes rows whose child is null).
    A 0/0 or 0*ln(0) term counts as 0."""
    parent, child = _list(parent), _list(child)
    has_parent = counts.where(not_null(*parent))
    tot = has_parent.groupBy(*parent).agg(F.sum(weight).alias("_g"))
    sub = (has_parent.where(not_null(*child)).groupBy(*parent, *child)
           .agg(F.sum(weight).alias("_s")))
    p = F.try_divide(F.col("_s").cast("double"), F.col("_g").cast("double"))
    term = F.when(p > 0, -F.ln(p) * p).otherwise(F.lit(0.0))
    return (sub.join(tot, parent).groupBy(*parent)
            .agg(F.sum(term).alias(name)))


def entropy(df: DataFrame, parent, child, name: str, weight=None) -> DataFrame:
    """A10: per-parent entropy table computed from the rows."""
    parent, child = _list(parent), _list(child)
    w = F.lit(1).cast("long") if weight is None else col(weight)
    counts = df.groupBy(*parent, *child).agg(F.sum(w).alias("_w"))
    return entropy_from_counts(counts, parent, child, "_w", name)


def count_distinct_children(df: DataFrame, parent, child, name: str) -> DataFrame:
    """Exact number of distinct non-null children per non-null parent,
    as a two-step distinct (distinct pairs, then count) so no single task
    ever holds a hot parent's child set."""
    parent, child = _list(parent), _list(child)
    pairs = df.where(not_null(*parent, *child)).select(*parent, *child).distinct()
    return pairs.groupBy(*parent).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, keys, name: str = "count", drop_null_keys: bool = True) -> DataFrame:
    """Frequency of each value (pandas ``value_counts`` drops nulls)."""
    return group_stats(df, keys, {name: F.count(F.lit(1))}, drop_null_keys)


def attach_counts(df: DataFrame, keys, name: str, drop_null_keys: bool = False) -> DataFrame:
    """Number of rows sharing ``keys`` attached to each row.

    High-cardinality keys (whole texts): the aggregate is joined with a
    shuffle join unless it proves small; AQE splits a skewed key."""
    return attach_group_stats(df, keys, {name: F.count(F.lit(1))}, drop_null_keys)


def word_counts(df: DataFrame, groups: list[str], text) -> DataFrame:
    """(groups, _w, _n): how often each single-space word occurs in each
    combination of the groups."""
    return df.select(*groups, F.explode(words_space(text)).alias("_w")).groupBy(*groups, "_w").agg(F.count(F.lit(1)).alias("_n"))


def group_word_totals(counts: DataFrame, group, prefix: str) -> DataFrame:
    """A5: total and distinct words over all texts of a group, out of the
    ``word_counts`` of finer groups - never by concatenating a group's text."""
    group = _list(group)
    words = counts.groupBy(*group, "_w").agg(F.sum("_n").alias("_n"))
    return words.groupBy(*group).agg(F.sum("_n").alias(f"{prefix}_words"), F.count(F.lit(1)).alias(f"{prefix}_nunique"))


def exact_sum(x, scale: int = 6) -> F.Column:
    """Sum of a double as fixed-point decimal: exact, so the result does not
    depend on how rows are split into partitions."""
    return F.sum(col(x).cast(f"decimal(38, {scale})"))


def exact_avg(x, scale: int = 6) -> F.Column:
    """Mean from an exact fixed-point sum, returned as double."""
    return F.avg(col(x).cast(f"decimal(24, {scale})")).cast("double")


def length_stats_aggs(x: F.Column, prefix: str) -> dict[str, F.Column]:
    """Min / max / mean / median / sample std of a measure."""
    return {
        f"{prefix}_min": F.min(x),
        f"{prefix}_max": F.max(x),
        f"{prefix}_mean": F.avg(x),
        f"{prefix}_median": F.median(x),
        f"{prefix}_std": F.stddev_samp(x),
    }


def crosstab_long(df: DataFrame, row_key, col_key, name: str = "count") -> DataFrame:
    """A14 (long form): counts per (row value, column value)."""
    return value_counts(df, [row_key, col_key], name, drop_null_keys=True)


def crosstab_wide(df: DataFrame, row_key: str, col_key: str, values: list[str]) -> DataFrame:
    """A14 (wide form) with explicit pivot values, so no distinct-value
    collection runs on the driver."""
    return (df.where(not_null(row_key, col_key)).groupBy(row_key).pivot(col_key, values)
            .agg(F.count(F.lit(1))).na.fill(0, subset=values))


def mine_attributes(df: DataFrame, items_col: str, text_col: str, min_count: int = 2) -> DataFrame:
    """Attribute names mined from list items.

    Each row contributes its items, or its whole text when it has no ``<li``
    (a list without a well-formed item contributes nothing);
    ``' : '`` becomes ``': '``; items with ``:`` after position 0 give the
    key ``lower(text before the first ':')``; keys seen at least
    ``min_count`` times are returned with their counts."""
    pieces = F.when(F.contains(F.col(text_col), F.lit("<li")), F.col(items_col)).otherwise(
        F.array(F.coalesce(F.col(text_col), F.lit("NA"))))
    it = df.select(F.explode(pieces).alias("_it")).select(F.replace(F.col("_it"), F.lit(" : "), F.lit(": ")).alias("_it"))
    keyed = it.where(F.instr("_it", ":") > 1).select(F.lower(F.substring_index("_it", ":", 1)).alias("att"))
    return keyed.groupBy("att").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)


def exact_median(df: DataFrame, keys, x, name: str) -> DataFrame:
    """Exact interpolated median of ``x`` per group, without holding a
    group's values in one task.

    (group, value) counts are aggregated (partial aggregation first), a
    range-partitioned running count over (group, value) gives each value's
    rank span - a hot group's values are spread over many range partitions
    - and the values at ranks floor((n-1)/2) and floor(n/2) are picked:
    median = lo + (hi - lo) / 2, as ``percentile(x, 0.5)``. Nulls are ignored."""
    from quire.operators.ordered import running_sum
    keys = _list(keys)
    v = col(x).alias("_x") if not isinstance(x, str) else F.col(x).alias("_x")
    vc = (df.select(*keys, v).where(F.col("_x").isNotNull())
          .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    cum = running_sum(vc, [F.col(k) for k in keys] + [F.col("_x")], "_c", "_cum")
    cum = cum.withColumn("_before", F.col("_cum") - F.col("_c"))
    grp = cum.groupBy(*keys).agg(F.min("_before").alias("_base"), F.sum("_c").alias("_n"))
    j = cum.join(bounded(grp), keys)
    pos = F.col("_before") - F.col("_base")
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.floor(F.col("_n") / 2)
    at = lambda p: (pos <= p) & (p < pos + F.col("_c"))
    picked = j.groupBy(*keys).agg(F.max(F.when(at(lo), F.col("_x"))).alias("_lo"),
                                  F.max(F.when(at(hi), F.col("_x"))).alias("_hi"))
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(name))


def exact_median_sets(df: DataFrame, sets: dict[str, list[str]], x: str) -> SetTables:
    """``exact_median`` for several key sets in one pass: every row is
    expanded once per set into (set id, encoded group key), one ranked pass
    over (set id, group key, value) serves all sets, and the keys are
    decoded from the result (no re-scan of the rows). Rows with a null key
    drop out of that set. Returns one (keys..., _m) table per set name;
    ``small`` tells whether the written result fits the broadcast bounds."""
    names = list(sets)
    sep = "\u0001"
    types = {f.name: f.dataType for f in df.schema.fields}

    def entry(i, keys):
        ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        return F.when(ok, F.struct(F.lit(i).alias("_sid"),
                                   F.concat_ws(sep, *[F.col(k).cast("string") for k in keys]).alias("_k")))

    entries = F.filter(F.array(*[entry(i, sets[n]) for i, n in enumerate(names)]), lambda e: e.isNotNull())
    ex = (df.where(F.col(x).isNotNull()).select(F.col(x).alias("_x"), F.explode(entries).alias("_e"))
          .select("_e._sid", "_e._k", "_x"))
    med = materialize(exact_median(ex, ["_sid", "_k"], "_x", "_m"))
    out = SetTables()
    out.small = fits_broadcast(med)
    for i, n in enumerate(names):
        parts = F.split(F.col("_k"), sep, -1)
        out[n] = med.where(F.col("_sid") == i).select(
            *[F.get(parts, j).cast(types[k]).alias(k) for j, k in enumerate(sets[n])], "_m")
    return out


#: Bins that a group's range of values is cut into to find where its median lies.
MEDIAN_BINS = 256


def range_aggs(x: str) -> dict[str, F.Column]:
    """What ``selected_median_sets`` needs to know of a group; nulls and NaN don't count."""
    v = F.when(~F.isnan(x), F.col(x))
    return {"_lo": F.min(v), "_hi": F.max(v), "_n": F.count(v)}


def selected_median_sets(df: DataFrame, sets: dict[str, list[str]], x: str, ranges: SetTables | None = None,
                         bins: int = MEDIAN_BINS) -> SetTables:
    """``exact_median`` for several key sets by narrowing each group's bounds.

    The range of a group's values is cut into ``bins``; one aggregate counts
    the rows of each (set, group, bin) and shows which bin holds the middle
    ranks. Only the rows between that bin's least and greatest value, few
    unless the values are heaped together, are then counted by value and
    ranked over range partitions; the counts below give their places. Exact
    whatever the values, and no row crosses a shuffle before it is either
    counted or within its group's narrowed bounds.

    ``ranges`` takes the ``range_aggs`` of the same sets where the caller has
    them already. Rows with a null key drop out of that set, nulls and NaN
    of the double ``x`` are ignored. Returns one (keys..., _m) table per set."""
    from quire.operators.ordered import running_sum
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(x))
    ranges = ranges or grouping_sets_stats(rows, sets, range_aggs(x))
    types = {f.name: f.dataType for f in df.schema.fields}
    sep = "\u0001"

    def joined(tables: dict[str, DataFrame], small: bool) -> DataFrame:
        """The rows beside their groups' (_lo, _hi, _n, _below) of every set."""
        out = rows
        for name, keys in sets.items():
            t = tables[name].select(*keys, F.struct("_lo", "_hi", "_n", "_below").alias(f"_r_{name}"))
            out = out.join(side(t, small), keys, "left")
        return out

    def bin_of(name: str) -> F.Column:
        lo, hi = F.col(f"_r_{name}._lo"), F.col(f"_r_{name}._hi")
        place = F.when(hi > lo, F.nanvl((F.col(x) - lo) / (hi - lo) * bins, F.lit(float(bins)))).otherwise(F.lit(0.0))
        return F.when(lo.isNotNull(), F.least(F.floor(place), F.lit(bins - 1)).cast("int"))

    wide = joined({n: ranges[n].withColumn("_below", F.lit(0)) for n in sets}, ranges.small)
    binned = wide.select(*{k: None for ks in sets.values() for k in ks}, x, *[bin_of(n).alias(f"_b_{n}") for n in sets])
    counts = grouping_sets_stats(binned, {n: [*ks, f"_b_{n}"] for n, ks in sets.items()},
                                 {"_c": F.count(F.lit(1)), "_lo": F.min(x), "_hi": F.max(x)})
    narrowed = {}
    for n, ks in sets.items():
        own = Window.partitionBy(*ks)  # at most ``bins`` rows a group
        t = counts[n].where(F.col(f"_b_{n}").isNotNull()).select(
            *ks, "_c", "_lo", "_hi", F.sum("_c").over(own).alias("_n"),
            (F.sum("_c").over(own.orderBy(f"_b_{n}")) - F.col("_c")).alias("_before"))
        low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        holds = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_c"))
        narrowed[n] = t.where(holds(low) | holds(high)).groupBy(*ks).agg(
            F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_n").alias("_n"), F.min("_before").alias("_below"))

    def within(n: str) -> F.Column:
        return F.col(x).between(F.col(f"_r_{n}._lo"), F.col(f"_r_{n}._hi"))

    near = joined(narrowed, counts.small).where(reduce(lambda a, b: a | b, [F.coalesce(within(n), F.lit(False)) for n in sets]))

    def entry(i: int, n: str) -> F.Column:
        r = f"_r_{n}"
        return F.when(within(n), F.struct(
            F.lit(i).alias("_sid"), F.concat_ws(sep, *[F.col(k).cast("string") for k in sets[n]]).alias("_k"),
            F.col(f"{r}._n").alias("_n"), F.col(f"{r}._below").alias("_below")))
    entries = F.filter(F.array(*[entry(i, n) for i, n in enumerate(sets)]), lambda e: e.isNotNull())
    by_value = (near.select(F.col(x).alias("_x"), F.explode(entries).alias("_e")).select("_e.*", "_x")
                .groupBy("_sid", "_k", "_x").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"), F.max("_below").alias("_below")))
    # written first: a sort by ranges reads its input twice
    cum = running_sum(materialize(by_value), [F.col(c) for c in ("_sid", "_k", "_x")], "_c", "_cum").withColumn("_before", F.col("_cum") - F.col("_c"))
    base = cum.groupBy("_sid", "_k").agg(F.min("_before").alias("_base"))
    pos = F.col("_before") - F.col("_base") + F.col("_below")
    at = lambda p: (pos <= p) & (p < pos + F.col("_c"))
    found = cum.join(bounded(base), ["_sid", "_k"]).groupBy("_sid", "_k").agg(
        F.max(F.when(at(F.floor((F.col("_n") - 1) / 2)), F.col("_x"))).alias("_l"),
        F.max(F.when(at(F.floor(F.col("_n") / 2)), F.col("_x"))).alias("_h"))
    equal = F.col("_l") == F.col("_h")
    medians = materialize(found.select("_sid", "_k", F.when(equal, F.col("_l")).otherwise(
        F.col("_l") + (F.col("_h") - F.col("_l")) * 0.5).alias("_m")))
    out = SetTables()
    out.small = fits_broadcast(medians)
    for i, (n, ks) in enumerate(sets.items()):
        parts = F.split(F.col("_k"), sep, -1)
        out[n] = medians.where(F.col("_sid") == i).select(*[F.get(parts, j).cast(types[k]).alias(k) for j, k in enumerate(ks)], "_m")
    return out
