import random
from collections import Counter

import pytest

from chalkline.llm import scans, spam

BASE = [
    "The heat flux over the basin returned to its former level by the end of the record",
    "We see no reason to reject the surface albedo as a cause of the moisture transport",
    "Near the coast the high-resolution records of temperature explain most of the variance",
    "The fit improves if the boundary layer height is allowed to vary with the discharge",
    "Nobody has yet sampled the glacier mass in the northern part of the continental range",
]


TAIL = "\n\nWe see that the fit is what it was, and that most of the records in the basin explain it. Nobody has yet sampled the discharge."


def corpus(extra):
    rows = [(i, ". ".join(random.Random(i).sample(BASE, 4)) + ".") for i in range(120)]
    return rows + [(1000 + i, t and t + TAIL) for i, t in enumerate(extra)]


GOOD = "The heat flux over the basin returned to its former level by the end of the record. "
DAMAGED = {
    "The heat flux over the basin retur-\nned to its former level by the end of the record.": "The heat flux over the basin returned to its former level by the end of the record.",
    "The heat flux over the basin retur- ned to its former level by the end.": "The heat flux over the basin returned to its former level by the end.",
    "The hcat flux over the basin returned to its f0rmer level.": "The heat flux over the basin returned to its former level.",
    "The heat flux over the basin retu rned to its former level.": "The heat flux over the basin returned to its former level.",
    "The heatflux over the basin returned to its former level.": "The heat flux over the basin returned to its former level.",
    "We see no reason to reject the surface albedo\n214 ANNALS OF THE SEA, VOL. 3\nas a cause of the moisture transport.": "We see no reason to reject the surface albedo as a cause of the moisture transport.",
    "We see no reason to reject the surface albedo Page 3 of 90 as a cause of the moisture transport.": "We see no reason to reject the surface albedo as a cause of the moisture transport.",
    "We see no reason to reject the surface albedo\n77\nas a cause of the moisture transport.": "We see no reason to reject the surface albedo as a cause of the moisture transport.",
    "We see no reason to reje(t the surface albedo as a cause of the moisture transport.": "We see no reason to reject the surface albedo as a cause of the moisture transport.",
    "We see no reason to reject the surface albedo as a cause.The moisture transport is so.": "We see no reason to reject the surface albedo as a cause. The moisture transport is so.",
}
SOUND = [
    "Near the coast the high-\nresolution records of temperature explain most of the variance.",
    "As noted on page 72 of the log, the record ends in\n1984\nWe see no reason to reject it.",
    "We see that the GRAFO9e run and the Tarbek station explain most of the variance [37].",
    "The heat flux over the basin\nreturned to its former level\nby the end of the record.",
    "",
    None,
    "12 13 14 15 16 17 18\nretur-\nned 5 6 7 8 " + "9 10 11 " * 40,
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = spark.createDataFrame(corpus([*DAMAGED, *SOUND]), "chunk_ord bigint, text string")
    noise = scans.learned(rows)
    return rows, noise


@pytest.mark.parametrize("hot", [131072, 3])
def test_damage_is_found_with_and_without_the_broadcast_part(spark, hot):
    rows = spark.createDataFrame(corpus([*DAMAGED, *SOUND]), "chunk_ord bigint, text string")
    noise = scans.learned(rows, p=scans.ScanParams(hot=hot))
    got = {r["chunk_ord"] for r in scans.damaged(rows, noise).collect()}
    assert got == {1000 + i for i in range(len(DAMAGED))}


def test_repair(scanned):
    rows, noise = scanned
    got = {r["chunk_ord"]: (r["clean_text"], r["changed"]) for r in scans.repaired(rows, noise).collect()}
    for i, want in enumerate(DAMAGED.values()):
        assert got[1000 + i] == (want + TAIL, True)
    for i, t in enumerate(SOUND):
        assert got[1000 + len(DAMAGED) + i] == (t and t + TAIL, False)
    assert all(not c for k, (_, c) in got.items() if k < 1000)


def test_anagram_hash_joins_any_place():
    assert scans.anagram_hash("abc") == scans.anagram_hash("cba") != scans.anagram_hash("abd")
    assert scans.anagram_hash("m0del") + scans.anagram_hash("o") - scans.anagram_hash("0") == scans.anagram_hash("model")


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "chunk_ord bigint, text string, places int, word string")
    noise = scans.learned(rows)
    assert scans.damaged(rows, noise).count() == 0 and scans.repaired(rows, noise).count() == 0


# --- spam ---

COMMON = [("en", w) for w in "the of and to in a is was that for it as with on by".split()] + [(None, None), ("en", "The")]
PROSE = (
    "The two series part ways around 1984, and the wind stress had little to do with it. We find that the albedo was not the cause of the trend in this part of the basin. "
    "Most of the signal comes from nine sites, so it is not clear what the records in the north can tell us about the change. "
)
SPAM = [
    "solar kit | cheap solar kit | solar-kit | SOLAR KIT | best solar kit | buy solar kit online | solar kit sale | solar kit | s0l4r kit | solar kit deal",
    " ".join(f"{w} rain gauge" + " best" * (i % 3 == 0) for i, w in enumerate(PROSE.split()[:40])),
    "Looking for rain gauge? Our rain gauge is the best rain gauge in Tarn. Cheap rain gauge and best rain gauge reviews for rain gauge fans in Tarn. Buy rain gauge now, rain gauge sale, rain gauge rain gauge. " * 2,
    "\n".join(f"SKU-{i}231 wind meter pro €{i}9.99" for i in range(1, 15)),
    "\n".join(f"https://a{i}.example/x/y{i}" for i in range(20)),
    " ".join(f'<a href="https://a.example/{i}">Trends of heat flux in the Tarn Basin</a>' for i in range(9)),
    "Home · Tarn map · Archive · Login · Help · Corvo shop · Sitemap · RSS · Contact · Next · Maps · Share · Top · About",
    "\n".join(f"rain gauge Tarn{i}" for i in range(25)),
    " ".join(f"#rain_gauge{i} #snowdata{i}" for i in range(20)),
    "Tags: " + " ".join(f"rain gauge map ({i}) snow sensor ({i + 100})" for i in range(12)),
]
FINE = [
    PROSE,
    PROSE * 300,
    PROSE + "\n\nKeywords: heat flux, wind stress, snow cover, albedo",
    PROSE + "\n\nSources:\nhttps://a.example/x\nhttps://b.example/y",
    PROSE.replace("the wind stress", '<a href="https://a.example/x">the wind stress</a>').replace("albedo", "[albedo](https://b.example/z)"),
    PROSE + "\n" + "\n".join(f"[{i}] A. Marl, B. Tins. On {'heat flux,wind stress,ozone,dust,runoff,snow'.split(',')[i % 6]} and {'ice,sand,rain,salt,mud'.split(',')[i % 5]} in Tarn{i}. J. Sea Res. {i}, 20-40 (19{i})." for i in range(10, 40)),
    PROSE + "\n" + "\n".join(f"Tarn{i}\t{i}.5\t-{i}.2\t{i}" for i in range(40)),
    PROSE + "\n" + "\n".join(["HF heat flux", "WS: wind stress", "SC = snow cover", "MLD mixed layer depth", "SIE sea ice extent"] * 8),
    PROSE + "\n" + "\n".join(["if (tau .gt. 4) then", "  call update_tau(i, j, 3)", "end if", "! set tau"] * 10),
    PROSE + "\n" + "\n".join(f"A. Marl{i}1, Institute of Deep Studies, Tarn" for i in range(20)),
    "See supplement.",
    "…",
]


def test_spam_and_its_look_alikes(spark):
    rows = [(i, PROSE + f" It was run {i} of the set.") for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(SPAM)] + [(2000 + i, t) for i, t in enumerate(FINE)] + [(3000, None), (3001, ""), (3002, " \n"), (3003, SPAM[0]), (3003, SPAM[0])]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, distance double")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = spam.judged(docs, common).collect()
    found = sorted(r["doc_id"] for r in got if r["is_spam"])
    assert found == [1000 + i for i in range(len(SPAM))] + [3003, 3003]
    assert not {3000, 3001, 3002} & {r["doc_id"] for r in got}


def test_spam_edge_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    assert spam.judged(docs, common).count() == 0
    one = spark.createDataFrame([(1, PROSE)], "doc_id bigint, text string")
    assert [r["is_spam"] for r in spam.judged(one, common.limit(0)).collect()] == [False]


# --- evidence that does not depend on the size of the corpus ---


def test_split_and_cut_words_are_found_however_often_they_occur(spark):
    """Halves and cut-off words with more uses than make a word known, in a large corpus."""
    rows = [(i, (GOOD + "The surface albedo of the basin is low. ") * 2 + TAIL) for i in range(2500)]
    bad = [(10_000 + i, "The heat flux over the basin retu rned to its former level by the end of the record." + TAIL) for i in range(15)]
    bad += [(20_000 + i, "Records of the basin and of the surface albed and the heat flux explain most of it." + TAIL) for i in range(15)]
    docs = spark.createDataFrame(rows + bad, "chunk_ord bigint, text string")
    noise = scans.learned(docs)
    assert {r["chunk_ord"] for r in scans.damaged(docs, noise).collect()} == {k for k, _ in bad}
    fixed = {r["chunk_ord"]: r["clean_text"] for r in scans.repaired(docs, noise).filter("changed").collect()}
    assert fixed == {k: t.replace("retu rned", "returned") for k, t in bad if k < 20_000}


@pytest.mark.parametrize("hot", [3, 40])
def test_known_words_beyond_the_broadcast_part_count_too(spark, hot):
    rows = spark.createDataFrame(corpus([*DAMAGED, *SOUND]), "chunk_ord bigint, text string")
    noise = scans.learned(rows, p=scans.ScanParams(hot=hot))
    assert {r["chunk_ord"] for r in scans.damaged(rows, noise).collect()} == {1000 + i for i in range(len(DAMAGED))}
    got = {r["chunk_ord"]: r["clean_text"] for r in scans.repaired(rows, noise).filter("changed").collect()}
    assert got == {1000 + i: want + TAIL for i, want in enumerate(DAMAGED.values())}


def test_results_do_not_depend_on_the_broadcast_part(spark):
    """Keys and numbers of places, on the delivered chunks, whether all, some or hardly any known words are broadcast."""
    rows = spark.read.parquet("/root/testdata/sf0.001/chunks_norm.parquet")
    got = []
    for hot in (131_072, 300, 3):
        noise = scans.learned(rows, p=scans.ScanParams(hot=hot))
        got.append((sorted(map(tuple, scans.damaged(rows, noise).collect())), sorted(map(tuple, scans.repaired(rows, noise).filter("changed").collect()))))
    assert got[0] == got[1] == got[2] and got[0][0] and got[0][1]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("the spread of it On the sparse flux of the whole Tarn narrows to 7", "the spread of it narrows to 7"),
        ("the spread of it\nOn the sparse flux of the whole\n80\nnarrows to 7", "the spread of it\nnarrows to 7"),
        ("It is so. Marl and Tins: On the sparse flux of the whole 12 We see it.", "It is so. We see it."),
        ("It is so. On the sparse flux of the whole Tarn We see it.", "It is so. We see it."),
        ("It is so. On the sparse flux of the whole Tarn we see it.", None),
        ("On the sparse flux of the whole Tarn we see it.", None),
        ("It rests on the sparse flux of the whole Tarn.", None),
        ("the On the sparse flux of the wholesome Tarn", None),
    ],
)
def test_running_titles(text, clean):
    title = "On the sparse  flux of the whole Tarn"
    assert bool(scans.running_titles(text, title)) == (clean is not None)
    assert scans._headless(text, title) == (clean or text)
    assert not scans.running_titles(text, None) and not scans.running_titles(text, "On the") and not scans.running_titles(text, "")


def test_pairs_by_numbers_are_the_pairs_of_tokens():
    rng = random.Random(2)
    tokens = ["re", "turned", "Re", "TURN", "ED", "a", "A", "tra", "nsport,", "co2", "(the", "it.", "x-y", "Éta", "été", "42"]
    texts = [None, "", "alone", *(" ".join(rng.choice(tokens) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    want = Counter(ab for t in texts if t for ab in map(scans._pair, t.split(), t.split()[1:]) if ab)
    halves = scans.Halves()
    for i in range(0, len(texts), 7):
        halves.count(texts[i : i + 7])
    rows = halves.taken()
    assert {(a, b): n for a, b, n in zip(*(c.to_pylist() for c in rows.columns))} == dict(want)
    assert halves.taken().num_rows == 0


@pytest.mark.parametrize("blank", [" ", "\n\n", " \t ", "\u2003"])
@pytest.mark.parametrize("texts", [["_", "re turned tra nsport"], ["re turned tra nsport", "_"], ["_", "_", "re turned", "_", "_", "tra nsport", "_", "_"], ["_", "re turned"], ["re turned", "_"], ["_", "re", "_", "turned", "_"], ["_"], ["_", "_"]])
def test_blank_texts_take_no_pair_from_a_batch(texts, blank):
    texts = [blank if t == "_" else t for t in texts]
    want = Counter(ab for t in texts for ab in map(scans._pair, t.split(), t.split()[1:]) if ab)
    halves = scans.Halves()
    halves.count(texts)
    assert {(r["a"], r["b"]): r["n"] for r in halves.taken().to_pylist()} == dict(want)


def test_blank_texts_at_either_end_of_a_batch(spark):
    """Nothing fails, blank texts come out as they are, and the other texts have the results that they have without blank ones."""
    rows = corpus([*DAMAGED, *SOUND])
    blank = [(2000 + i, t) for i, t in enumerate([" ", "\n\n", " \t "])]
    got = []
    for all_rows in (rows, blank + rows + [(k + 100, t) for k, t in blank]):
        docs = spark.createDataFrame(all_rows, "chunk_ord bigint, text string").coalesce(1)
        noise = scans.learned(docs)
        clean = {r["chunk_ord"]: (r["clean_text"], r["changed"]) for r in scans.repaired(docs, noise).collect()}
        assert all(clean[k] == (t, False) for k, t in all_rows if k >= 2000)
        got.append((sorted(map(tuple, scans.damaged(docs, noise).collect())), {k: v for k, v in clean.items() if k < 2000}))
    assert got[0] == got[1] and got[0][0]


def _one_spam(spark, page):
    rows = [(i, PROSE + f" It was run {i} of the set.") for i in range(200)] + [(1000, page)]
    found = spam.judged(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(COMMON, "lang string, word string"))
    return [r["doc_id"] for r in found.filter("is_spam").collect()]


def test_phrases_without_an_outstanding_single_word_are_measured(spark):
    """Two phrases of four words, each word 7 % of the page, inside sentences with 44 % function words."""
    few = "the of and to in a is was that for it as with on by".split()
    page = " ".join(("solar kit battery charger " if i % 2 else "rain gauge sensor module ") + " ".join(few[(3 * i + j) % 15] for j in range(3)) + ("." if i % 4 == 3 else "") for i in range(28))
    assert _one_spam(spark, page) == [1000]


@pytest.mark.parametrize(("words", "keywords"), [(300, 15), (300, 25), (2000, 60), (4000, 130)])
def test_many_keywords_in_changing_order_are_repeats(spark, words, keywords):
    """No keyword covers 7 % of the page; together they cover three quarters of it, inside sentences."""
    draw, few = random.Random(1), "the of and to in a is was that for".split()
    names = [f"{a}{b}{c}" for a in ("gauge", "meter", "pump", "valve", "logger") for b in ("rel", "tor", "min", "dax", "vop", "sul") for c in ("na", "ki", "mo", "tu", "re")][:keywords]
    page, left = [], []
    while len(page) < words:
        left = left if len(left) >= 3 else draw.sample(names, len(names))
        page += [left.pop(), left.pop(), left.pop(), draw.choice(few) + "." * (len(page) % 24 == 20)]
    assert _one_spam(spark, " ".join(page)) == [1000]


def test_pages_of_a_batch_do_not_touch_each_other():
    """Features of a page are the same alone, in a batch, and between other pages; a page of any length and with open tags is read whole."""
    lex = {k: set(v) for k, v in spam.MORE_WORDS.items()}
    pages = ["", "…", *SPAM, *FINE, "<a href=x>" * 3000 + "wind", "< 0.05 of the flux and > 3", "[" * 5000, "[a](b) " * 4000, "heat " * 20_000]
    langs, n, x = spam.batch_features(pages, spam.Lexis(lex))
    back = spam.batch_features(pages[::-1], spam.Lexis(lex))
    for i, p in enumerate(pages):
        one = spam.batch_features([p], spam.Lexis(lex))
        assert (langs[i], n[i], x[:, i].tolist()) == (one[0][0], one[1][0], one[2][:, 0].tolist())
        assert (x[:, i] == back[2][:, len(pages) - 1 - i]).all()


def test_distance_and_direction_both_decide(spark):
    """Tables and code lie far out in another direction; a text with some links lies in the spam direction, but near."""
    some = PROSE * 3 + "\n\nSources:\n" + "\n".join(f"https://a{i}.example/x" for i in range(3))
    rows = [(i, PROSE + f" It was run {i} of the set.") for i in range(200)] + [(1000, "\n".join(f"{i}.5 {i}.25 -{i}.125 x{i}" for i in range(40))), (1001, some), (1002, SPAM[0])]
    got = {r["doc_id"]: r for r in spam.judged(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(COMMON, "lang string, word string")).filter("doc_id >= 1000").collect()}
    p = spam.SpamParams()
    assert not got[1000]["is_spam"] and got[1000]["direction"] < p.direction
    assert got[1001]["direction"] > 0 and got[1001]["distance"] < p.distance and not got[1001]["is_spam"]
    assert got[1002]["is_spam"]
