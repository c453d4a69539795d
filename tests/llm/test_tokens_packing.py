import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm import packing, tokens

PATH = tokens.TokenizerParams().path
TEXTS = [
    "The heat flux, the heat flux!", "", None, " ", "\n\n  a  b\t　c  ", "don't  they'll", "naïve été 数据 данные 🌊🌡️", "<|endoftext|> plain", "x" * 3000, "a b\r\n\r\nc    d",
    "12 345,67  --- ...", "end with blanks   ", "   start", "\x00\x1c\x85 odd", "tab\t\ttab", "The heat flux, the heat flux!",
]


def direct(texts):
    t = tokens._tokenizer(PATH)
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, x, "other", i) for i, x in enumerate(texts)], "doc_id bigint, text string, word string, n bigint")


@pytest.mark.parametrize("frequent", [0, 3, 100000])
def test_ids_equal_the_tokenizer_whatever_part_is_broadcast(spark, frequent):
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(table(spark), p=tokens.TokenizerParams(frequent=frequent)).collect()}
    assert got == dict(enumerate(direct(TEXTS)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_never_cut_a_token(text):
    t = tokens._tokenizer(PATH)
    assert "".join(tokens.WORD.findall(text)) == text
    assert [i for w in tokens.WORD.findall(text) for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_repeated_and_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a rare word"), (1, "a rare word"), (1, "other"), (None, "no key"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or -1, r["ids"]) for r in tokens.encoded(df, p=tokens.TokenizerParams(frequent=0)).collect()), key=str)
    assert got == sorted([(1, i) for i in direct(["a rare word", "a rare word", "other"])] + [(-1, i) for i in direct(["no key", None])], key=str)
    assert tokens.encoded(df.limit(0)).count() == 0
    assert tokens.sizes(df.limit(0)).count() == 0


def test_sizes(spark):
    for frequent in (0, 100000):
        got = {r["doc_id"]: r["n_tokens"] for r in tokens.sizes(table(spark), p=tokens.TokenizerParams(frequent=frequent)).collect()}
        assert got == {i: len(x) for i, x in enumerate(direct(TEXTS))}


def test_round_trip(spark):
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(tokens.encoded(table(spark))).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


# --- filling ---


def used(plan, capacity):
    fill, seen = {}, {}
    for n, first, last, container, uses in plan:
        for r in range(first, last):
            c = container + (r - first) // uses
            fill[c] = fill.get(c, 0) + n
            seen.setdefault(n, []).append(r)
    assert all(v <= capacity for v in fill.values())
    return fill, {k: sorted(v) for k, v in seen.items()}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_places_every_item_once(hist):
    fill, seen = used(packing.fill_plan(np.array(list(hist)), np.array(list(hist.values())), 64), 64)
    assert seen == {k: list(range(v)) for k, v in hist.items()} and set(fill) == set(range(len(fill)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 60))
def test_best_fill_against_all_subsets(items, room):
    from collections import Counter
    from itertools import combinations

    c = Counter(items)
    got = packing.best_fill(packing.Left(np.array(list(c)), np.array(list(c.values()))), {}, room)
    assert all(got[k] <= c[k] for k in got)
    best = max((s for k in range(len(items) + 1) for x in combinations(items, k) if (s := sum(x)) <= room), default=0)
    assert sum(k * v for k, v in got.items()) == best


def test_packed_is_valid_and_tight(spark):
    rng = random.Random(3)
    sizes = [rng.choice([7, 7, 7, rng.randint(1, 300)]) for _ in range(2000)]
    rows = [(i, n) for i, n in enumerate(sizes)] + [(9001, 0), (9002, None), (9003, 1050)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("a", 256), ("b", 1000), ("b", 1000), ("c", 0), (None, None)], "pack_name string, capacity int")
    got = packing.packed(items, packs).collect()
    for name, cap in (("a", 256), ("b", 1000)):
        own = [r for r in got if r["pack_name"] == name]
        fill, parts = {}, {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["n"]
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["n"]))
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        want = {i: n for i, n in rows if n}
        assert {k: sum(p[2] for p in v) for k, v in parts.items()} == want
        assert all(len(v) == -(-want[k] // cap) for k, v in parts.items())
        total = sum(want.values())
        assert len(fill) <= -(-total // cap) * 1.02 + 1
    report = {r["pack_name"]: r for r in packing.fill_report(packing.packed(items, packs), packs).collect()}
    assert set(report) == {"a", "b"} and report["b"]["unused"] < 0.02
    assert packing.packed(items.limit(0), packs).count() == 0
    valid = {r["pack_name"]: r for r in packing.validity(packing.packed(items, packs), items, packs, slack=0.02).collect()}
    assert set(valid) == {"a", "b"} and all(r["items"] == len([n for _, n in rows if n]) and r["whole"] and r["fits"] and r["tight"] for r in valid.values())


def test_validity_sees_what_is_wrong(spark):
    items = spark.createDataFrame([(1, 6), (2, 5), (3, 12)], "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("a", 10)], "pack_name string, capacity int")
    right = [("a", 0, 3, 0, 0, 10), ("a", 1, 1, 0, 0, 6), ("a", 1, 3, 1, 10, 2), ("a", 2, 2, 0, 0, 5)]
    check = lambda rows: packing.validity(spark.createDataFrame(rows, "pack_name string, container bigint, doc_id bigint, piece int, token_start bigint, n bigint"), items, packs).select("items", "whole", "fits").first()
    assert tuple(check(right)) == (3, True, True)
    assert tuple(check(right[:-1])) == (2, False, True)
    assert tuple(check([*right, right[-1]])) == (3, False, True)
    assert tuple(check([*right[:-1], ("a", 1, 2, 0, 0, 5)])) == (3, True, False)


def test_a_long_item_fills_containers_of_its_own(spark):
    """Full pieces need no plan: one item of a hundred thousand of them, and others, in every container once."""
    items = spark.createDataFrame([(1, 1_000_003), (2, 20), (3, 20), (3, 20), (4, 7)], "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("a", 10)], "pack_name string, capacity int")
    got = packing.packed(items, packs)
    r = got.selectExpr("count(*)", "count(distinct container)", "min(container)", "max(container)").first()
    assert tuple(r) == (100_000 + 1 + 6 + 1, 100_007, 0, 100_006)
    assert tuple(packing.validity(got, items, packs).select("items", "whole", "fits", "tight").first()) == (4, True, True, True)


def test_plans_of_large_capacities_end_soon():
    import time

    rng = np.random.default_rng(0)
    for capacity, items in ((8192, 200_000), (131_072, 400_000)):
        lengths, counts = np.unique(rng.integers(1, capacity, items), return_counts=True)
        t = time.perf_counter()
        rows = list(packing.fill_plan(lengths, counts, capacity))
        assert time.perf_counter() - t < 30
        containers = max(c + (last - first) // uses for _, first, last, c, uses in rows)
        assert containers <= 1.01 * (lengths * counts).sum() / capacity and sum(last - first for _, first, last, _, _ in rows) == items


def test_written_tables_can_be_discarded(spark):
    from pathlib import Path

    from chalkline.llm import store

    df = store.written(spark.range(5).toDF("x"))
    path = store.WRITTEN[-1]
    assert df.count() == 5 and Path(path).exists()
    store.discard(spark)
    assert not Path(path).exists() and not store.WRITTEN
