"""Scoring of answers against golden cases, aggregates over runs, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import at_bounds, normalise_answer, normalise_url, once
from quern.operators.lexical import bounded
from quern.sources.tables import materialise


def groups(value: Column) -> Column:
    """A JSON list whose elements are texts or lists of alternatives: array<array<string>>."""
    return F.transform(F.from_json(value, "array<string>"), lambda e: F.coalesce(F.from_json(e, "array<string>"), F.array(e)))


def facts_found(facts: Column, answer: Column) -> Column:
    """array<boolean>: for each group, whether any alternative is in the answer."""
    return once(normalise_answer(answer), lambda text: groups_found(facts, text))


def groups_found(facts: Column, text: Column) -> Column:
    """facts_found() in a text that is normalised already."""
    return F.transform(facts, lambda g: F.exists(g, lambda a: once(normalise_answer(a), lambda needle: at_bounds(needle, text))))


#: The runs of a normalised text that are looked up.
RUNS = "[a-z0-9]+|[^a-z0-9 ]"


def fact_keys(normalised: Column) -> Column:
    """What an index of normalised texts has of each: its runs of a-z and 0-9, without the ending of an
    ordinal as well, and any other character but the space. A fact at bounds has all its keys there."""
    found = F.array_distinct(F.regexp_extract_all(normalised, F.lit(RUNS), F.lit(0)))
    return F.array_union(found, F.transform(F.filter(found, lambda k: k.rlike("[0-9](st|nd|rd|th)$")), lambda k: F.substring(k, 1, F.length(k) - 2)))


def key_forms(keys: DataFrame) -> DataFrame:
    """keys (key) -> (form, key): the runs of a text that give it a key, as fact_keys() has it: the key itself,
    and as an ordinal one that ends in a digit."""
    ordinals = F.when(F.col("key").rlike("[0-9]$"), F.transform(F.array(*map(F.lit, ("st", "nd", "rd", "th"))), lambda e: F.concat("key", e))).otherwise(F.array().cast("array<string>"))
    return keys.select(F.explode(F.concat(F.array("key"), ordinals)).alias("form"), "key")


def fact_hits(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """facts (item_id, fact), docs (doc_id, text): (item_id, doc_id) for each fact and each row of docs
    where fact_in() holds. The candidates are the documents that have the fact's rarest key, so that no
    pair without it is made. Texts are read for the facts' keys once, and once more where they have candidates,
    by doc_id, which may repeat or be null; a text is normalised once for all facts that it may have."""
    keys = facts.select("item_id", normalise_answer(F.col("fact")).alias("needle")).select("item_id", "needle", F.explode(fact_keys(F.col("needle"))).alias("key"))
    keys = materialise(keys, "fact-keys")
    runs = F.array_distinct(F.regexp_extract_all(normalise_answer(F.col("text")), F.lit(RUNS), F.lit(0)))
    found = docs.select("doc_id", F.explode(runs).alias("form")).join(bounded(key_forms(keys.select("key").distinct())), "form")
    postings = materialise(found.select("doc_id", "key"), "fact-postings")
    df = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rarest = keys.join(df, "key", "left").groupBy("item_id", "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key"))["key"].alias("key"))
    candidates = postings.join(bounded(rarest), "key").groupBy(F.struct("doc_id").alias("own")).agg(F.collect_set(F.struct("item_id", "needle")).alias("asked"))
    pairs = docs.select(F.struct("doc_id").alias("own"), "text").join(candidates, "own")
    hits = once(normalise_answer(F.col("text")), lambda text: F.filter("asked", lambda x: at_bounds(x["needle"], text)))
    return pairs.select("own", F.explode(hits).alias("x")).select("x.item_id", "own.doc_id")


def share(flags: Column) -> Column:
    """The share of true; null if there are none."""
    return once(flags, lambda own: F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: x)) / F.size(own)))


def urls_found(expected: Column, retrieved: Column) -> Column:
    return once(F.transform(retrieved, normalise_url), lambda have: F.transform(expected, lambda g: F.arrays_overlap(F.transform(g, normalise_url), have)))


def precision(cited: Column, expected: Column) -> Column:
    """The share of cited addresses that are expected; null without any."""
    wanted = F.transform(F.flatten(expected), normalise_url)
    return share(F.transform(cited, lambda u: F.array_contains(wanted, normalise_url(u))))


def percentile(values: Column, q: float) -> Column:
    """Nearest rank: of the sorted values, that at q * (n - 1), rounded half to even."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = F.bround(q * (F.size(kept) - 1)).cast("int") + 1
    return F.when(F.size(kept) > 0, F.get(kept, at - 1))


#: Rows of a range of values that are sorted in one task, and ranges that a wider one is cut into.
SORTED, CUT = 10_000, 1024


def exact_percentiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float], most: int = SORTED) -> DataFrame:
    """percentile() without sorting a group: of each group the values are counted in CUT ranges of equal width,
    only the range that holds a rank is looked at again, and so on until it has `most` rows at most or one
    value. The counts are combined where the rows are, so a group of any size is no one's work. Null and NaN
    don't count; a group without other values isn't there. Groups are joined null to null."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    own = rows.select(key.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    kind = rows.schema[value].dataType
    # every (group, percentile) is a search of its own: from which values on to which, and the rank in between
    ends = own.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in qs.items())))
    open_ = ends.withColumn("x", named).select("_g", "x.name", F.bround(F.col("x.q") * (F.col("n") - 1)).cast("long").alias("rank"), "n", "low", "high")
    open_, found = materialise(open_, "percentiles"), None
    while True:
        done = materialise(open_.where("low = high").select("_g", "name", F.col("low").alias("v")), "percentiles-done")
        left = open_.where("low < high")
        few = left.where(F.col("n") <= most)
        inside = own.join(bounded(few), "_g").where("_v between low and high")
        sorted_ = inside.groupBy("_g", "name").agg(F.get(F.array_sort(F.collect_list("_v")), F.first("rank").cast("int")).alias("v"))
        part = done.unionByName(materialise(sorted_, "percentiles-sorted"))
        found = part if found is None else found.unionByName(part)
        wide = left.where(F.col("n") > most)
        if not wide.limit(1).count():
            break
        # by halves, so that the width of any two numbers is one; the least and the greatest are never in one range
        width = F.col("high") / 2 - F.col("low") / 2
        at = F.when(F.col("_v") == F.col("low"), 0).when(F.col("_v") == F.col("high"), CUT - 1).otherwise(F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("low") / 2, width), F.lit(0.5)) * CUT), F.lit(CUT - 1)))
        counts = own.join(bounded(wide), "_g").where("_v between low and high").groupBy("_g", "name", "rank", at.alias("at")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.sum("c").over(Window.partitionBy("_g", "name").orderBy("at")) - F.col("c")  # CUT rows at most
        narrowed = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        open_ = materialise(narrowed.select("_g", "name", (F.col("rank") - F.col("before")).alias("rank"), F.col("c").alias("n"), "low", "high"), "percentiles")
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).cast(kind).alias(name) for name in qs))
    return wide.select(*(F.col("_g")[c].alias(c) for c in by), *qs)


def mean(name: str, *, digits: int = 6) -> list[Column]:
    """The mean of what isn't null, and over how many rows."""
    return [F.round(F.avg(name), digits).alias(f"{name}_mean"), F.count(name).alias(f"{name}_n")]


def compare(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, before, after) of the cases that got worse."""
    both = a.select(key, *(F.col(m).alias(f"a_{m}") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"b_{m}") for m in metrics)), key)
    rows = both.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("before"), F.col(f"b_{m}").alias("after")) for m in metrics))).alias("x"))
    return rows.select(key, "x.metric", "x.before", "x.after").where("after < before")


def rescore(before: DataFrame, after: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: cases in both, changed scores, cases that the second lacks."""
    both = before.select(key, F.col("score").alias("old")).join(after.select(key, F.col("score").alias("new")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.abs(F.col("old") - F.col("new")) > tolerance).alias("changed"), F.count_if(F.col("new").isNull()).alias("missing"), F.round(F.avg("old"), 6).alias("mean_before"), F.round(F.avg("new"), 6).alias("mean_after"))


def set_scores(claimed: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and F1 of a claimed set; an empty truth scores 1 if nothing is claimed."""
    hit = F.size(F.array_intersect(claimed, truth))
    c, t = F.size(F.array_distinct(claimed)), F.size(F.array_distinct(truth))
    p, r = F.when(c > 0, hit / c).otherwise(F.when(t == 0, 1.0).otherwise(0.0)), F.when(t > 0, hit / t).otherwise(F.when(c == 0, 1.0).otherwise(0.0))
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
