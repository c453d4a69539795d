"""Filling containers of fixed capacity with items of varying length by minimum bin slack.

Pieces of the full capacity fill a container each and are numbered by prefix sums. For the rest only the histogram of lengths decides, and it has
fewer than `capacity` entries whatever the size of the corpus. One task per capacity makes the plan: the longest lengths that are left open a
container, a bitset of reachable sums finds the multiset of other lengths that fills it best, and that pattern is used as often as the counts
allow. Each use of a pattern brings a count below the pattern's need for it, so the number of patterns depends on the lengths, not on the corpus;
PLAN_ROWS bounds the plan that reaches the tasks. The items get their place within their length, in as many buckets as the histogram says the
hottest length needs, and look up their container in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.store import rank_in_group, saved, sum_before

MAX_PACKS = 100
#: Lengths over this part of the capacity open a container, the largest that fit first; the rest is filled by sums. Left to the sums, they would
#: be avoided in favour of small lengths, and at the end there would be none left to go with them.
SEED_PART = 6
#: Lengths after which a fill that leaves under a thousandth of its room is taken; far more are only tried where little is left to choose from.
TRIED = 256
#: Rows of the plan of all capacities (40 bytes each), and items of a length in one bucket.
PLAN_ROWS, BUCKET_ROWS = 2_000_000, 1_000_000


class Left:
    """Lengths that are left with their counts, and the largest one up to a bound, by links that skip used-up lengths."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        rows = sorted((int(a), int(c)) for a, c in zip(lengths, counts) if c > 0)
        top = rows[-1][0] if rows else 0
        self.count, self.largest = dict(rows), top
        self.under = list(range(top + 1))  # towards the largest length that is not larger and still there; 0 is none
        for a in range(1, top + 1):
            if a not in self.count:
                self.under[a] = self.under[a - 1]

    def at_most(self, a: int) -> int:
        a = min(a, self.largest)
        path = []
        while a and not self.count.get(a):
            path.append(a)
            a = self.under[a] if self.under[a] != a else a - 1
        for x in path:
            self.under[x] = a
        return a

    def take(self, a: int, n: int) -> None:
        self.count[a] -= n


def best_fill(left: Left, held: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths left, without those held, the multiset whose sum is closest to room from below: length -> number."""
    mask = (1 << (room + 1)) - 1
    reach, steps, tried = 1, [], 0
    a = left.at_most(room)
    while a and not reach >> room & 1:
        n, take = min(left.count[a] - held.get(a, 0), room // a), 1
        while n > 0 and not reach >> room & 1:
            take = min(take, n)
            steps.append((a, take, reach))
            reach |= reach << (a * take) & mask
            n -= take
            take *= 2
        tried += 1
        if tried >= TRIED and (room - reach.bit_length() + 1) * 1000 <= room:
            break
        a = left.at_most(a - 1)
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def fill_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first place, last place, first container, uses) of each use of a pattern: the items of a length whose places lie in
    [first, last) go, `uses` a container, into the containers from the first one on. Lengths are distinct, from 1 to capacity."""
    left = Left(lengths, counts)
    place: dict[int, int] = {}
    container = 0
    while (a := left.at_most(capacity)) > 0:
        large: dict[int, int] = {}
        room = capacity
        while a and (not large or a * SEED_PART > capacity):
            n = min(left.count[a], room // a) if a * SEED_PART > capacity else 1
            large[a], room = n, room - a * n
            a = left.at_most(min(room, a - 1))
        used = best_fill(left, large, room)
        for a, n in large.items():
            used[a] = used.get(a, 0) + n
        times = min(left.count[a] // n for a, n in used.items())
        for a, n in used.items():
            at = place.get(a, 0)
            yield a, at, at + n * times, container, n
            place[a] = at + n * times
            left.take(a, n * times)
        container += times


def known_packs(packs: DataFrame) -> list[tuple[str, int]]:
    """(name, capacity) of the packs of a positive capacity; more than MAX_PACKS are an error, since they are parameters."""
    got = packs.filter(F.col("capacity") > 0).select("pack_name", "capacity").distinct().limit(MAX_PACKS + 1).collect()
    if len(got) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs: they are parameters, not data")
    return sorted(((r["pack_name"], r["capacity"]) for r in got), key=str)


def _for_each_pack(items: DataFrame, packs: list[tuple[str, int]], key: str, size: str) -> DataFrame:
    """pack_name, capacity, key, _n: every item of a size above 0 for every pack."""
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in packs]) if packs else F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    return items.filter(F.col(size) > 0).select(key, F.col(size).cast("bigint").alias("_n"), F.explode(each).alias("_p")).select("_p.*", key, "_n")


def packed(items: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """pack_name, container, key, piece, token_start, n: every piece of every item in one container of each pack, none over its capacity.

    Containers count from 0 in each pack. Items are whole unless larger than the capacity; then they come in pieces of the capacity and a rest.
    Sizes null or below 1 are left out; an empty table gives no containers. A repeated key is an item of its own. Equal lengths are taken in
    the order of a hash of their key.
    """
    spark = items.sparkSession
    rows = _for_each_pack(saved(items.select(key, size)), known_packs(packs), key, size)
    rows = rows.withColumns({"_full": F.floor(F.col("_n") / F.col("capacity")), "n": F.col("_n") % F.col("capacity")})
    rest = rows.filter(F.col("n") > 0).select("pack_name", key, F.col("_full").cast("int").alias("piece"), (F.col("_full") * F.col("capacity")).alias("token_start"), "n", "capacity")
    hist = saved(rest.groupBy("pack_name", "capacity", "n").agg(F.count("*").alias("c")))
    schema = "pack_name string, n bigint, first bigint, last bigint, container bigint, uses bigint"

    def plan(d: pd.DataFrame) -> pd.DataFrame:
        made = list(fill_plan(d["n"].to_numpy(), d["c"].to_numpy(), int(d["capacity"].iloc[0])))
        out = pd.DataFrame(made, columns=["n", "first", "last", "container", "uses"]).astype("int64")
        out.insert(0, "pack_name", d["pack_name"].iloc[0])
        return out

    made = saved(hist.groupBy("pack_name", "capacity").applyInPandas(plan, schema))
    if made.count() > PLAN_ROWS:
        raise ValueError(f"the plan has more than {PLAN_ROWS} rows: take smaller capacities")
    table = made.toPandas().sort_values(["pack_name", "n", "first"], ignore_index=True)
    by = {k: tuple(g[c].to_numpy() for c in ("first", "container", "uses")) for k, g in table.groupby(["pack_name", "n"])}
    own = spark.sparkContext.broadcast(by)

    @F.pandas_udf("bigint")
    def container(pack: pd.Series, n: pd.Series, place: pd.Series) -> pd.Series:
        at = place.to_numpy() - 1
        out = np.zeros(len(at), np.int64)
        for k, where in pd.DataFrame({"p": pack, "n": n}).groupby(["p", "n"]).indices.items():
            first, base, uses = own.value[k]
            row = np.searchsorted(first, at[where], "right") - 1
            out[where] = base[row] + (at[where] - first[row]) // uses[row]
        return pd.Series(out)

    hottest = hist.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    placed = rank_in_group(rest, ["pack_name", "n"], [F.col(key), F.col("piece")], "_p", F.xxhash64(key, "piece"), 64 + hottest // BUCKET_ROWS)
    small = placed.select("pack_name", container("pack_name", "n", "_p").alias("container"), key, "piece", "token_start", "n")
    planned = {k: int((g["container"] + (g["last"] - g["first"]) // g["uses"]).max()) for k, g in table.groupby("pack_name")}
    start = F.coalesce(F.create_map(*[F.lit(x) for kv in planned.items() for x in kv])[F.col("pack_name")], F.lit(0)) if planned else F.lit(0)
    full = sum_before(rows.filter(F.col("_full") > 0), ["pack_name"], "_full", [F.col(key), F.col("_n")], "_at", F.xxhash64(key, "_n"))
    full = full.select("pack_name", "capacity", key, "_at", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("piece"))
    whole = full.select("pack_name", (start + F.col("_at") + F.col("piece")).cast("bigint").alias("container"), key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n"))
    return small.unionByName(whole)


def validity(placed: DataFrame, items: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "n_tokens", slack: float = 0.001) -> DataFrame:
    """pack_name, capacity, items, whole, fits, tight: the number of items packed; whether every one has all its tokens once, in as few pieces as
    can be; whether no container is over its capacity; whether there are at most a share of `slack` (and one) more containers than any packing needs."""
    caps = known_packs(packs)
    want = _for_each_pack(items, caps, key, size).groupBy("pack_name", "capacity", key).agg(F.sum("_n").alias("_n"), F.sum(F.ceil(F.col("_n") / F.col("capacity"))).alias("_k"))
    got = placed.groupBy("pack_name", key).agg(F.sum("n").alias("_m"), F.count("*").alias("_c"))
    each = want.join(got, ["pack_name", key], "full").groupBy("pack_name").agg(
        F.count("_m").alias("items"), F.min(F.coalesce((F.col("_n") == F.col("_m")) & (F.col("_k") == F.col("_c")), F.lit(False))).alias("whole"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_t")
    )
    used = placed.groupBy("pack_name", "container").agg(F.sum("n").alias("_u")).groupBy("pack_name").agg(F.count("*").alias("_containers"), F.max("_u").alias("_most"), (F.max("container") + 1).alias("_last"))
    names = packs.sparkSession.createDataFrame([(n, int(c)) for n, c in caps], "pack_name string, capacity bigint") if caps else packs.limit(0).select("pack_name", F.col("capacity").cast("bigint").alias("capacity"))
    all_ = names.join(each, "pack_name").join(used, "pack_name")
    least = F.ceil(F.col("_t") / F.col("capacity"))
    return all_.select("pack_name", "capacity", "items", "whole", ((F.col("_most") <= F.col("capacity")) & (F.col("_last") == F.col("_containers"))).alias("fits"), (F.col("_containers") <= F.ceil(least * (1 + slack)) + 1).alias("tight"))


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity, containers, tokens, fullest, unused share, and the fewest containers that any packing could need."""
    each = placed.groupBy("pack_name", "container").agg(F.sum("n").alias("_u"))
    total = each.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("_u").alias("tokens"), F.max("_u").alias("fullest"))
    cap = packs.filter(F.col("capacity") > 0).select("pack_name", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    rows = total.join(cap, "pack_name")
    return rows.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
