"""How filters interact: what each removes in every order, what it alone removes, and what good text it costs.

Every row fails some of the filters A to E. The ids of failing rows are kept as sorted posting lists per part, filter and range
of ids, beside lists of the good and the toxic rows. Ids number the rows as they are stored, so a range holds at most `RANGE`
of them whatever the part or the number of rows, and a hot part has many ranges. In every range the lists are merged, the shorter
one searched in the longer, into the unions of all sets of filters. Sizes of unions add up over ranges; differences of these sums tell
what each step of each order removes, so no order is applied to the rows.

Nulls and ties: a null text counts as empty, a null part as the empty string. Rows that share an id are counted each; none of them makes
the other fail E. A row whose id is null neither fails E nor makes another fail, and has no labels. A row is good, or toxic, if any label of
its id says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import materialize, with_facts

FILTERS = "ABCDE"
LEAST_WORDS = 100
#: Percentages: least share of distinct words, greatest share of capitals.
LEAST_DISTINCT, MOST_CAPITALS = 80, 10
WORD_GAP = r"[\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ids in a range, as a power of two.
RANGE_BITS = 16
MARKS = ("good", "toxic")


def _by_itself(text: Column, words: Column) -> Column:
    """The bits of the filters that look at one row."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(SIGNS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, key, part, bits, good, toxic) of every row: the filters it fails, the first being bit 0, and whether a label marks it."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(value, 256)).alias("digest"), value.alias("value"), F.array_remove(F.split(value, WORD_GAP), "").alias("words"),
    )
    own = rows.select("id", "key", "part", "digest", _by_itself(F.col("value"), F.col("words")).alias("own"))
    own = materialize(own, "audit-rows")
    copies = own.groupBy("digest").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = with_facts(own, materialize(copies, "audit-copies"), "digest")
    again = F.coalesce(F.col("key") > F.col("low"), F.lit(False))
    told = told.select("id", "key", "part", (F.col("own") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("bits"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = with_facts(materialize(told, "audit-bits"), materialize(marks, "audit-marks"), "key")
    return marked.select("id", "key", "part", "bits", *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in MARKS])


def postings(failed: DataFrame) -> DataFrame:
    """(part, range, list, ids): the sorted ids that fail a filter, or that are good or toxic, of one part and one range of ids."""
    named = [(F.col("bits").bitwiseAND(1 << i) != 0, letter) for i, letter in enumerate(FILTERS)] + [(F.col(m), m) for m in MARKS]
    lists = F.filter(F.array(*[F.when(held, F.lit(name)) for held, name in named]), lambda x: x.isNotNull())
    rows = failed.select("part", F.shiftright("id", RANGE_BITS).alias("range"), F.explode(lists).alias("list"), "id")
    return rows.groupBy("part", "range", "list").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def held(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the sorted ids are in the other sorted list, found by search in it."""
    if not len(among):
        return np.zeros(len(ids), bool)
    return among[np.minimum(np.searchsorted(among, ids), len(among) - 1)] == ids


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sorted list of both; the shorter is searched in the longer, whose runs between hits are copied whole."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    new = short[~held(short, long)]
    return np.insert(long, np.searchsorted(long, new), new)


def unions(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The merged list of every set of lists, by the set's bits."""
    found = {0: np.array([], np.int64)}
    for bits in range(1, 1 << len(lists)):
        low = (bits & -bits).bit_length() - 1
        found[bits] = union(found[bits & (bits - 1)], lists[low])
    return found


def _sizes(group: pd.DataFrame) -> pd.DataFrame:
    lists = {name: np.asarray(ids, np.int64) for name, ids in zip(group["list"], group["ids"])}
    none = np.array([], np.int64)
    merged = unions([lists.get(letter, none) for letter in FILTERS])
    rows = [(bits, len(ids), *(int(held(ids, lists.get(m, none)).sum()) for m in MARKS)) for bits, ids in merged.items()]
    out = pd.DataFrame(rows, columns=["bits", "n", *MARKS])
    out.insert(0, "part", group["part"].iloc[0])
    return out


def union_sizes(lists: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): how many rows fail any filter of a set, over all ranges."""
    each = lists.groupBy("part", "range").applyInPandas(_sizes, "part string, bits int, n long, good long, toxic long")
    return each.groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", *MARKS)])


def audit(failed: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from stored failures.

    The rows of a part are those of all orders of the filters, one per step.
    """
    sizes = union_sizes(postings(failed)).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("bits", F.struct("n", *MARKS)))).alias("sizes")
    )
    parts = failed.groupBy("part").agg(F.count("*").alias("docs")).join(sizes, "part", "left")
    steps = [
        F.struct(
            F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(order[i]).alias("letter"),
            F.lit(sum(1 << FILTERS.index(x) for x in order[:i])).alias("before"), F.lit(1 << FILTERS.index(order[i])).alias("bit"),
        )
        for order in permutations(FILTERS) for i in range(len(FILTERS))
    ]
    rows = parts.select("part", "docs", "sizes", F.explode(F.array(*steps)).alias("s")).select("part", "docs", "sizes", "s.*")

    def size(bits: Column, what: str = "n") -> Column:
        return F.coalesce(F.element_at("sizes", bits)[what], F.lit(0))

    upto, every = F.col("before") + F.col("bit"), F.lit((1 << len(FILTERS)) - 1)
    lost = {m: size(upto, m) - size(F.col("before"), m) for m in MARKS}
    counted = rows.select(
        "part", "filter_order", "step", "letter", (F.col("docs") - size(upto)).alias("kept"), (size(upto) - size(F.col("before"))).alias("removed"),
        size(F.col("bit")).alias("failing"), (size(every) - size(every - F.col("bit"))).alias("unique_fails"),
        *[lost[m].alias(f"{m}_lost") for m in MARKS],
    )
    over_orders = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return counted.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
        "good_lost", "toxic_lost", over_orders.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    return audit(materialize(failures(docs, labels, key=key, text=text, part=part), "audit-failures"))
