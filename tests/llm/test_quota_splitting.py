import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm import quota, splitting

Q = "question_id string, question_set string, section_type string, arxiv_id string, created_at timestamp, usable int"
T = "question_set string, section_type string, sample_size int, target_share double, min_rows int, per_paper int"


def questions(spark, rows):
    from datetime import datetime, timedelta

    return spark.createDataFrame([(*r, datetime(2024, 1, 1) + timedelta(hours=i), 7) for i, r in enumerate(rows)], Q)


def test_shares_floors_and_caps(spark):
    rng = random.Random(5)
    rows = [(f"q{i}", "s", rng.choice(["intro", " Methods ", "RESULTS", None, "appendix", "discussion"]), f"arXiv:p{i % 90}v{i % 3 + 1}") for i in range(900)]
    targets = spark.createDataFrame([("s", "intro", 40, 0.5, 0, 2), ("s", "methods", 40, 0.25, 0, 2), ("s", "results", 40, 0.1, 8, 2), ("s", "other", 40, 0.15, 0, 2), ("s", "discussion", 40, 0.0, 0, 2)], T)
    got, report = quota.sample(questions(spark, rows), targets)
    n = Counter(r["section_type"] for r in got.collect())
    assert sum(n.values()) == 40 and n["results"] == 8 and n["discussion"] == 0
    rest = {"intro": 0.5, "methods": 0.25, "other": 0.15}
    assert all(abs(n[k] - v / 0.9 * 32) <= 1 for k, v in rest.items())
    papers = Counter((r["section_type"], r["paper"]) for r in got.collect())
    assert max(papers.values()) <= 2 and all(p.startswith("p") and "v" not in p for _, p in papers)
    assert not any(r["unmet"] for r in report.collect())


def by_hand(rows, targets):
    last = {}
    for q, s, t, p in rows:
        last[q] = (s, t, p)
    count = defaultdict(Counter)
    for s, t, p in last.values():
        t = (t or "").strip().lower()
        t = t if t in quota.TYPES else "other"
        if p is not None:
            p = p.removeprefix("arXiv:")
            i = p.rfind("v")
            p = p[:i] if i > 0 and p[i + 1 :].isdigit() else p
            count[s, t][p] += 1
    return {(s, t) for s, t, size, share, least, cap in targets if max(least, round(share * size, 6)) > sum(min(c, cap) for c in count[s, t].values())}


def test_unmet_against_brute_force(spark):
    rng = random.Random(9)
    for k in range(3):
        rows = [(f"q{rng.randint(0, 60)}", "s", rng.choice(["intro", "methods", "results", None, " "]), rng.choice([None, "p1", "p1v2", "arXiv:p1", "p2", "p3"])) for _ in range(80)]
        same = {q: (q, s, t, p) for q, s, t, p in rows}
        rows = [same[q] for q, *_ in rows]  # a question delivered again is the same question
        targets = [("s", t, 20, 0.25, rng.randint(0, 9), rng.randint(1, 4)) for t in ("intro", "methods", "results", "other")]
        report = quota.sample(questions(spark, rows), spark.createDataFrame(targets, T))[1]
        assert {(r["question_set"], r["section_type"]) for r in report.collect() if r["unmet"]} == by_hand(rows, targets)


def test_exhausted_seats_go_to_the_others_and_hot_groups(spark):
    rows = [(f"a{i}", "s", "intro", f"p{i}") for i in range(5)] + [(f"b{i}", "s", "methods", "hot") for i in range(3000)] + [("x", "s", "methods", None), (None, "s", "intro", "p")]
    targets = spark.createDataFrame([("s", "intro", 20, 0.5, 0, 9), ("s", "methods", 20, 0.5, 0, 100)], T)
    got, report = quota.sample(questions(spark, rows), targets)
    assert Counter(r["section_type"] for r in got.collect()) == {"intro": 5, "methods": 15}
    r = {x["section_type"]: (x["wanted"], x["usable"], x["drawn"], x["unmet"]) for x in report.collect()}
    assert r == {"intro": (10.0, 5, 5, True), "methods": (10.0, 100, 15, False)}


def test_floors_that_exceed_the_size_are_served_in_turn_and_reported(spark):
    rows = [(f"{t}{i}", "s", t, f"p{i}") for t in ("intro", "methods", "results") for i in range(5)]
    targets = spark.createDataFrame([("s", t, 4, 0.25, 2, 9) for t in ("intro", "methods", "results")], T)
    got, report = quota.sample(questions(spark, rows), targets)
    assert Counter(r["section_type"] for r in got.collect()) == {"intro": 2, "methods": 1, "results": 1}
    assert {r["section_type"]: (r["unmet"], r["short"]) for r in report.collect()} == {"intro": (False, False), "methods": (False, True), "results": (False, True)}


def test_no_cap_for_a_hot_paper_and_a_large_sample(spark):
    """A null per_paper is no cap; places of a hot paper and type are right beyond any one bucket."""
    rows = [(f"b{i}", "s", "methods", "hot") for i in range(4000)] + [(f"a{i}", "s", "intro", "hot") for i in range(300)]
    targets = spark.createDataFrame([("s", "methods", 2000, 0.9, 100, None), ("s", "intro", 2000, 0.1, 150, None)], T)
    got = quota.sample(questions(spark, rows), targets)[0].collect()
    assert sorted(r["seat"] for r in got) == list(range(1, 2001))
    n = Counter(r["section_type"] for r in got)
    assert n == {"methods": 1800, "intro": 200}
    for t, k in n.items():
        assert sorted(r["place"] for r in got if r["section_type"] == t) == list(range(1, k + 1))


def test_empty_tables(spark):
    q, t = questions(spark, [("a", "s", "intro", "p")]), spark.createDataFrame([("s", "intro", 2, 1.0, 0, None)], T)
    got, report = quota.sample(q.limit(0), t)
    assert got.count() == 0 and report.first()["usable"] == 0 and report.first()["unmet"]
    got, report = quota.sample(q, t.limit(0))
    assert got.count() == 0 and report.count() == 0
    assert quota.sample(q, t)[0].count() == 1


# --- splitting ---


def check(text, limit, overlap):
    spans = splitting.split_words(text, limit, overlap, 10**6)
    parts = [text[a:b].split() for a, b in spans]
    words = text.split()
    if len(words) <= limit:
        assert spans == [(0, len(text))]
        return parts
    assert all(len(p) <= limit for p in parts)
    k = min(overlap, limit - 1)
    got = parts[0][:]
    for a, b in zip(parts, parts[1:]):
        n = min(k, len(a))
        assert a[len(a) - n :] == b[:n]
        got += b[n:]
    assert got == words
    return parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "next\n\n", "line\n", "# head\n", "A."]), min_size=0, max_size=120), st.integers(1, 20), st.integers(0, 19))
def test_split_keeps_every_word_under_the_limit(ws, limit, overlap):
    check(" ".join(ws), limit, overlap)


def test_natural_boundaries_first():
    para = lambda n, w: " ".join([w] * (n - 1)) + " end."
    text = "\n\n".join([para(8, "a"), para(8, "b"), para(8, "c")])
    assert [p[-1] for p in check(text, 12, 2)] == ["end.", "end.", "end."]
    one = " ".join(para(4, w) for w in "abcdefgh")
    assert all(p[-1] == "end." for p in check(one, 10, 3))
    assert len(check("w " * 100, 10, 4)) == 16


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(2, 30), st.integers(0, 10))
def test_split_by_characters(text, limit, overlap):
    spans = splitting.split_chars(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= limit for a, b in spans)
    assert all(b1 >= a2 and a2 > a1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))


def test_pieces_and_numbers(spark):
    rows = spark.createDataFrame(
        [
            (1, "p", "S", 0, 0, "w " * 300, "x"), (2, "p", "S", 0, 1, "w " * 250, "x"), (3, "p", "S", 0, 2, "w " * 900, "x"), (4, "p", "S", 0, 0, "w " * 300, "x"), (5, "p", None, 1, 0, None, "x"), (6, None, "S", None, None, "", "x"),
            (7, "q", "S", 0, 2000, "w " * 251, "x"), (8, "q", "S", 0, 1, "one", "x"),
        ],
        "chunk_ord bigint, arxiv_id string, section string, section_index int, chunk_index int, text string, piece string",
    )
    split = splitting.pieces(rows)
    n = {r["chunk_ord"]: r["n_pieces"] for r in split.collect()}
    assert n == {1: 2, 2: 1, 3: 5, 4: 2, 5: 1, 6: 1, 7: 2, 8: 1}
    assert max(r["piece_words"] for r in split.collect()) <= 250
    got = sorted((r["chunk_ord"], r["new_index"]) for r in splitting.renumbered(split, rows).collect())
    assert got == [(1, 0), (1, 1), (2, 2), (3, 3), (3, 4), (3, 5), (3, 6), (3, 7), (4, 0), (4, 1), (5, 0), (6, 0), (7, 1), (7, 2), (8, 0)]
    assert splitting.pieces(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [250, 251, 460, 461])
def test_sizes_at_the_edge(spark, n):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "chunk_ord bigint, text string")
    got = splitting.pieces(df).orderBy("piece").collect()
    assert [r["piece_words"] for r in got] == {250: [250], 251: [210, 81], 460: [210, 250, 80], 461: [210, 250, 81]}[n] or (sum(r["piece_words"] for r in got) - 40 * (len(got) - 1) == n and all(r["piece_words"] <= 250 for r in got))
