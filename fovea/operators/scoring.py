"""Similarity of readers to a native prototype, in long form: who, feature, value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators import discriminants
from fovea.sources.shared import keep


def long_features(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, feature, value."""
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "feature", "value")


def feature_stats(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, feature, n, mean, sd (of a sample); features without spread are left out."""
    return long.groupBy(*groups, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("sd > 0")


def scaled(long: DataFrame, stats: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """z of every value by another frame's statistics."""
    return long.join(stats.select(*groups, "feature", "mean", "sd"), [*groups, "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def prototype(natives: DataFrame, stats: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, feature, p: the natives' mean z, which is the z of their mean."""
    means = natives.groupBy(*groups, "feature").agg(F.avg("value").alias("value"))
    return scaled(means, stats, groups).select(*groups, "feature", F.col("z").alias("p"))


def cosine(z: DataFrame, proto: DataFrame, keys: Sequence[str], groups: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """keys, eye_score: cosine over cells that both have; with a single feature the z itself; null without overlap.

    `kinds`: keys that tell several prototypes of a group apart."""
    both = z.join(proto, [*groups, "feature"]).where("z is not null and p is not null")
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("z").alias("one"), F.sum(F.col("z") * F.col("p")).alias("zp"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    width = proto.groupBy(*groups, *kinds).agg(F.count("p").alias("_w"))
    sums = sums.join(width, [*groups, *kinds]) if groups or kinds else sums.crossJoin(F.broadcast(width))
    norm = F.sqrt(F.col("zz") * F.col("pp"))
    return sums.select(*keys, F.when(F.col("_w") == 1, F.col("one")).otherwise(F.try_divide(F.col("zp"), F.when(norm > 0, norm))).alias("eye_score"))


def euclidean(z: DataFrame, proto: DataFrame, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """keys, eye_score: minus the distance over the prototype's features; a missing cell counts as 0."""
    both = z.join(proto.where("p is not null"), [*groups, "feature"])
    off = F.coalesce("z", F.lit(0.0)) - F.col("p")
    return both.groupBy(*keys).agg((-F.sqrt(F.sum(off * off))).alias("eye_score"))


def prototype_scores(readers: DataFrame, natives: DataFrame, keys: Sequence[str], groups: Sequence[str] = (), fit: DataFrame | None = None, how: str = "cosine") -> DataFrame:
    """Scores of readers: z by the fit frame (default: the readers), prototype of the natives, similarity.

    `groups` are keys that scoring stays inside (content group, half, item, direction).
    """
    # kept, so that their size is known: small ones go to the rows, which else meet by feature, a few large groups
    stats = keep(feature_stats(readers if fit is None else fit, groups))
    return PROTOTYPES[how](scaled(readers, stats, groups), keep(prototype(natives, stats, groups)), keys, groups)


def leave_one_out_cosine(readers: DataFrame, natives: DataFrame, who: str) -> DataFrame:
    """Each reader's cosine with the z statistics of all others: sums less the own row, no loop over readers.

    Features without spread among the others drop out for that reader.
    """
    totals = readers.where("value is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("m2"))
    raw = natives.where("value is not null").groupBy("feature").agg(F.avg("value").alias("_native"))
    own = readers.join(totals, "feature").join(raw, "feature").where("value is not null")
    others = F.col("n") - 1
    mean = (F.col("mean") * F.col("n") - F.col("value")) / others
    rest = F.col("m2") - (F.col("value") - F.col("mean")) * (F.col("value") - mean)
    own = own.where("n > 2").withColumns({"_mean": mean, "_sd": F.sqrt(F.greatest(rest, F.lit(0.0)) / (others - 1))}).where(F.col("_sd") > 1e-12)
    own = own.withColumns({"z": (F.col("value") - F.col("_mean")) / F.col("_sd"), "p": (F.col("_native") - F.col("_mean")) / F.col("_sd")})
    norm = F.sqrt(F.sum(F.col("z") * F.col("z")) * F.sum(F.col("p") * F.col("p")))
    return own.groupBy(who).agg(F.when(F.count(F.lit(1)) == 1, F.first("z")).otherwise(F.try_divide(F.sum(F.col("z") * F.col("p")), F.when(norm > 0, norm))).alias("eye_score"))


def by_pool(readers: DataFrame, natives: DataFrame, who: str, group: str, pools: Sequence[str], batch: str | None = None) -> DataFrame:
    """who, group, pool, eye_score against natives of all groups (ALL), the reader's own group (SEEN), or other batches or
    groups (UNSEEN).

    Natives are summed once by feature and group; the pools' means are those sums, all of them and all less the own
    batch's, and readers are scaled once for all pools.
    """
    sides = F.broadcast(readers.select(group, *([batch] if batch else [])).distinct())
    sums = natives.groupBy(group, *([batch] if batch else []), "feature").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    whole = sums.groupBy("feature").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    total = lambda key, name: sums.groupBy(key, "feature").agg(F.sum("s").alias(f"{name}_s"), F.sum("n").alias(f"{name}_n"))
    means = whole.crossJoin(sides).join(total(group, "own"), [group, "feature"], "left")  # a row a feature and group, as the prototypes are
    if batch:
        means = means.join(total(batch, "side"), [batch, "feature"], "left")
    side = "side" if batch else "own"
    rest = lambda c: F.col(f"all_{c}") - F.coalesce(f"{side}_{c}", F.lit(0))
    value = {"ALL": F.try_divide("all_s", "all_n"), "SEEN": F.try_divide("own_s", "own_n"), "UNSEEN": F.try_divide(rest("s"), rest("n"))}
    means = means.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), value[p].alias("value")) for p in pools])))
    means = means.select(group, "feature", "_m.pool", "_m.value").where("value is not null").distinct()
    stats = feature_stats(readers, [group])
    proto = scaled(means, stats, [group]).select(group, "feature", "pool", F.col("z").alias("p"))
    return cosine(scaled(readers.select(who, group, "feature", "value"), stats, [group]), proto, [who, group, "pool"], [group], ["pool"])


def pooled(readers: DataFrame, natives: DataFrame, who: str, group: str, pool: str, batch: str | None = None) -> DataFrame:
    """who, group, eye_score of one pool."""
    return by_pool(readers, natives, who, group, [pool], batch).drop("pool")


POOLS = ("SEEN", "UNSEEN")


def _directions(rows: DataFrame, side: str, pools: Sequence[str]) -> DataFrame:
    """A row for each pool with the half whose natives it meets: its own where the texts are seen, else the other."""
    met = F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), (F.col(side) if p == "SEEN" else 1 - F.col(side)).alias("direction")) for p in pools]))
    return rows.withColumn("_met", met).select(*[c for c in rows.columns if c not in ("pool", "direction")], "_met.*")


def direction_scores(readers: DataFrame, natives: DataFrame, who: str, side: str, groups: Sequence[str] = (), pools: Sequence[str] = POOLS, how: str = "cosine") -> DataFrame:
    """groups, pool, direction, who, eye_score in both directions between halves of a text.

    Long rows with a half (0 or 1, such as a parity) in `side`. The direction is the half whose natives make the
    prototype and whose readers give the statistics; it is scored on the same half (SEEN) or on the other (UNSEEN).
    Splits, parts and other repetitions are `groups`: all are keys of one job.
    """
    keys = [*groups, "direction"]
    own = lambda df: df.withColumn("direction", F.col(side))
    return prototype_scores(_directions(readers, side, pools), own(natives), [*groups, "pool", "direction", who], keys, fit=own(readers), how=require_prototype(how))


def item_direction_scores(readers: DataFrame, natives: DataFrame, who: str, item: str, side: str, groups: Sequence[str] = (), pools: Sequence[str] = POOLS) -> DataFrame:
    """groups, pool, direction, item, who, eye_score: each item of a reader by statistics that leave the reader out.

    SEEN: readers and natives of the same item; UNSEEN: readers of all items of the half, natives of the other half.
    Statistics are all sums less the reader's own. Features without spread among the others drop out.
    """
    out = None
    for pool in pools:
        keys = [*groups, "direction", *([item] if pool == "SEEN" else [])]
        tested = _directions(readers.where("value is not null"), side, [pool])
        met = natives.withColumn("direction", F.col(side)).groupBy(*keys, "feature").agg(F.avg("value").alias("_native"))
        n, square = F.count(F.lit(1)), F.var_pop("value") * F.count(F.lit(1))
        own = tested.groupBy(*keys, "feature", who).agg(n.alias("own_n"), F.avg("value").alias("own_m"), square.alias("own_q"))
        whole = tested.groupBy(*keys, "feature").agg(n.alias("all_n"), F.avg("value").alias("all_m"), square.alias("all_q"))
        rest = F.col("all_n") - F.col("own_n")
        left = own.join(whole, [*keys, "feature"]).join(met, [*keys, "feature"]).where("all_n - own_n > 1")
        left = left.withColumn("_mean", (F.col("all_n") * F.col("all_m") - F.col("own_n") * F.col("own_m")) / rest)
        apart = F.col("own_n") * rest / F.col("all_n") * (F.col("own_m") - F.col("_mean")) * (F.col("own_m") - F.col("_mean"))
        left = left.withColumn("_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("all_q") - F.col("own_q") - apart) / (rest - 1))).where("_sd > 1e-12")
        cells = tested.join(left.select(*keys, "feature", who, "_native", "_mean", "_sd"), [*keys, "feature", who])
        cells = cells.withColumns({"z": (F.col("value") - F.col("_mean")) / F.col("_sd"), "p": (F.col("_native") - F.col("_mean")) / F.col("_sd")})
        norm = F.sqrt(F.sum(F.col("z") * F.col("z")) * F.sum(F.col("p") * F.col("p")))
        score = F.when(F.count(F.lit(1)) == 1, F.first("z")).otherwise(F.try_divide(F.sum(F.col("z") * F.col("p")), F.when(norm > 0, norm)))
        one = cells.groupBy(*groups, "pool", "direction", item, who).agg(score.alias("eye_score"))
        out = one if out is None else out.unionByName(one)
    return out


def fold_scores(readers: DataFrame, natives: DataFrame, who: str, fold: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, who, fold, eye_score without leaks: z statistics of the readers outside the reader's fold, from all sums
    less the fold's own; the prototype is the natives' in those terms.

    A feature without spread outside a fold drops out there.
    """
    own = readers.where("value is not null").groupBy(*groups, "feature", fold).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("q"))
    by = Window.partitionBy(*groups, "feature")
    total, mean = F.sum("n").over(by), F.sum(F.col("n") * F.col("m")).over(by) / F.sum("n").over(by)
    whole = own.withColumns({"all_n": total, "all_m": mean}).withColumn("all_q", F.sum(F.col("q") + F.col("n") * (F.col("m") - F.col("all_m")) * (F.col("m") - F.col("all_m"))).over(by))
    rest = F.col("all_n") - F.col("n")
    left = whole.where("all_n - n > 1").withColumn("mean", (F.col("all_n") * F.col("all_m") - F.col("n") * F.col("m")) / rest)
    apart = (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")) * F.col("n") * rest / F.col("all_n")
    spread = F.greatest(F.lit(0.0), F.col("all_q") - F.col("q") - apart) / (rest - 1)
    stats = left.withColumn("sd", F.sqrt(spread)).where("sd > 1e-12").select(*groups, "feature", fold, "mean", "sd")
    keys = [*groups, fold]
    means = natives.groupBy(*groups, "feature").agg(F.avg("value").alias("value")).join(stats.select(*keys, "feature"), [*groups, "feature"])
    proto = scaled(means, stats, keys).select(*keys, "feature", F.col("z").alias("p"))
    return cosine(scaled(readers.select(*keys, who, "feature", "value"), stats, keys), proto, [*groups, who, fold], keys)


def discriminative_scores(rows: DataFrame, who: str, native: str, fold: str, columns: Sequence[str], groups: Sequence[str] = (), how: str = "logistic") -> DataFrame:
    """groups, who, eye_score: out-of-fold log-odds of being native, design standardised inside each fit.

    rows: wide, with a 0/1 native column and a fold. Fits come from rounds of sums, rows are never gathered.
    """
    return discriminants.scores(rows, rows, who, native, fold, columns, groups, how)


def paired_scores(natives: DataFrame, fit: DataFrame, targets: DataFrame, who: str, fold: str, columns: Sequence[str], groups: Sequence[str] = (), how: str = "logistic") -> DataFrame:
    """groups, who, eye_score of target rows by fits whose second-language rows are others: natives against the fit rows
    of everyone outside the target's fold. People that fit and targets don't share are in no fold: they train for all.

    Wide frames; the fold is the targets'.
    """
    of_targets = targets.select(*groups, who, F.col(fold).cast("long").alias("_fold")).distinct()
    part = lambda df, side: df.select(*groups, "_fold", F.lit(side).alias("_native"), *[F.col(c).cast("double").alias(c) for c in columns])
    others = part(fit.drop("_fold").join(of_targets, [*groups, who], "left"), 0.0)
    train = part(natives.withColumn("_fold", F.lit(None).cast("long")), 1.0).unionByName(others)
    return discriminants.scores(train, targets.withColumn("_fold", F.col(fold).cast("long")), who, "_native", "_fold", columns, groups, how)


def require_prototype(how: str) -> str:
    """The name if it is a prototype similarity; paths by item have no discriminative score."""
    if how not in PROTOTYPES:
        raise ValueError(f"{how!r} has no prototype; expected one of {sorted(PROTOTYPES)}")
    return how


FITS = discriminants.FITS
PROTOTYPES: dict[str, Callable] = {"cosine": cosine, "euclidean": euclidean}
