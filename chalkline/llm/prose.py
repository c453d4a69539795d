"""Statistics of a text's words and lines, and whether it is running prose.

A word belongs to running text if a finite verb stands near it, enough function words stand around it, and the function words near it follow
each other as they can in a sentence. Tables, lists, references, code and headings have no finite verbs; lists of phrases have function words
but hardly a verb of a main clause; scrambled sentences have both, but in impossible order ('the of', 'by is').
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.store import sliced

#: Function words of English by the place they take in a sentence.
ARTICLES = "the a an its our their".split()
PREPOSITIONS = "of in by from over at with into between within for".split()
COPULAS = "is are was were has have had be been".split()
CONJUNCTIONS = "and or but".split()
OTHERS = """to that which as on than so if when while where whereas although though because since after before until unless whether neither nor either both not no none
it we they he she this these those there here such some any each all most more less few one two only also yet still however therefore thus moreover consequently
about around under above below through during against along among across without towards near per up out off once again very rather almost even then who whose what how why
despite unlike like as well do does did may might can cannot could will would shall should must""".split()
MODALS = "do does did may might can cannot could will would shall should must".split()
#: Function words that may follow an article.
AFTER_ARTICLE = "few two one first same most more less other such only near very rather almost above below all each no once".split()
#: Common finite verbs of scientific prose. Forms that are as often nouns (results, estimates, trends, records) are left out.
VERBS = """find finds found give gives gave show shows showed shown come comes came see sees saw seen know known knew seem seems seemed appear appears remain remains
become becomes became suggest suggests indicate indicates imply implies agree agrees differ differs reach reaches exceed exceeds rise rises rose fall falls fell
tend tends follow follows keep keeps kept let lets lie lies lay stand stands stood occur occurs depend depends explain explains improve improves enter enters
receive receives overestimate overestimates underestimate underestimates narrow narrows weaken weakens strengthen strengthens stay stays look looks ends points drives
meet meets met take takes took taken make makes made expect repeat repeats lead leads led yield yields yielded include includes contain contains provide provides require requires
allow allows affect affects describe describes present presents assume assumes propose consider considers demonstrate demonstrates confirm confirms reveal reveals
represent represents correspond corresponds reflect reflects respond responds reproduce reproduces dominate dominates obtain obtains compare treat denotes vary varies narrows
sets places says said went goes did thought think thinks need needs gets got ran leave leaves left put puts read reads told held holds grew grows began begins carry carries
account reject separate rule draw draws drew bring brings brought called use uses used agrees observe observes note notes argue argues""".split()
#: Endings of finite past forms; counted only among function words, since they also end headings such as 'continued'.
PAST = re.compile(r"^[a-z]{3,}ed$")
STRIP = "\"'`*_~()[]{}<>.,;:!?|#=+-–—‘’“”…·•"
MARKS, CLOSERS = tuple(".!?:;,"), "\"')]”’"
BULLET = re.compile(r"^\s*(?:[-*+–—•●▪·]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
LETTER = re.compile(r"[^\W\d_]")
INITIAL = re.compile(r"^[(\[]?[a-z]\.[,;]?$")
DIGIT = re.compile(r"\d")

# bits of a word
FUNC, VERB, ED, ART, PREP, COP, CONJ, NUM, ALPHA, SYMBOL, REL, CORE, CLOSED, TO, WE, BE, HAVE, ADJ, INIT, WITH = (1 << i for i in range(20))


@dataclass(frozen=True)
class ProseParams:
    reach: int = 14  # words from a finite verb that still belong to its sentence
    around: int = 12  # words to either side in which function words are counted
    func_share: float = 0.20  # of the words without digits; initials count against
    order_margin: int = 8  # words beyond the first and last impossible pair that count as scrambled
    order_share: float = 0.025  # impossible pairs of function words, per word between them
    mark_share: float = 0.02  # words with a mark behind them, below which a text with impossible pairs is shuffled as a whole
    verb_share: float = 0.026  # finite verbs per word within 36 words to either side
    prose_share: float = 0.5


#: Columns of the statistics, with their types.
STATS = {
    "n_counted": "bigint", "prose_words": "bigint", "mean_word_length": "double", "alpha_share": "double", "number_share": "double", "symbol_share": "double", "common_share": "double",
    "verb_share": "double", "odd_order_share": "double", "distinct_share": "double", "core_words": "bigint", "n_lines": "bigint", "punctuated_lines": "double", "bullet_lines": "double", "repeated_lines": "double",
    "ellipsis_lines": "double",
}


SETS = {FUNC: {*ARTICLES, *PREPOSITIONS, *COPULAS, *CONJUNCTIONS, *OTHERS}, VERB: {*COPULAS, *MODALS, *VERBS} - {"be", "been"}, ART: {*ARTICLES} - {"their"}, PREP: {*PREPOSITIONS}, COP: {*COPULAS}, CONJ: {*CONJUNCTIONS}, TO: {"to"}, WE: {"we", "they", "he", "she"}, BE: {"be", "been"}, HAVE: {"has", "have", "had"}, ADJ: {*AFTER_ARTICLE}, WITH: {"with"}, REL: {"that", "which", "who"}}
#: Common words of which a text should have two, by a published rule.
SETS[CORE] = {"the", "be", "to", "of", "and", "that", "have", "with"}


class Words:
    """Numbers of distinct words and their bits, kept from batch to batch and dropped when they become too many."""

    MOST = 500_000

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.bits, self.size = array("i"), array("i")

    def add(self, w: str) -> int:
        core = w.strip(STRIP)
        b = sum(bit for bit, s in SETS.items() if core in s)
        b |= ED * bool(PAST.match(core)) | NUM * bool(DIGIT.search(core)) | ALPHA * bool(LETTER.search(core)) | SYMBOL * (not core) | CLOSED * (w[-1] in ".,;:!?)") | INIT * bool(INITIAL.match(w))
        self.of[w] = n = len(self.bits)
        self.bits.append(b)
        self.size.append(len(w))
        return n

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.bits) > self.MOST:
            self.__init__()
        get, add = self.of.get, self.add
        return np.fromiter((n if (n := get(w)) is not None else add(w) for w in words), np.int32, len(words))


def _window(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return c[hi] - c[lo]


def prose_mask(bits: np.ndarray, begin: np.ndarray, end: np.ndarray, p: ProseParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running, verb, odd) for each word; begin and end: the bounds of the word's text among all words."""
    n = len(bits)
    at = np.arange(n)
    has = lambda b: (bits & b) != 0
    inner = at + 1 < end
    nxt = np.append(bits[1:], 0)
    nx = lambda b: inner & ((nxt & b) != 0)
    func = has(FUNC)
    wide = lambda k: (np.maximum(at - k, begin), np.minimum(at + k + 1, end))
    near = _window(func, *wide(4))
    prev_rel = np.concatenate([[False], has(REL)[:-1]]) & (at > begin)
    before = np.concatenate([[0], bits[:-1]]) * (at > begin)
    finite = has(ED) & (near >= 1) & ((before & (ART | PREP | TO)) == 0)  # not 'the gridded flux'
    verb = (has(VERB) | finite) & ~prev_rel
    nfunc = nx(FUNC)
    odd = has(ART) & nfunc & ~nx(ADJ)
    odd |= has(PREP) & nx(PREP | COP | CONJ | TO | WE) & ~(has(WITH) & nx(CONJ))  # with or without
    odd |= has(TO) & nx(COP | CONJ | TO | WE) & ~nx(BE | HAVE)
    odd |= has(COP) & (nx(CONJ | WE) | (nx(COP) & ~(has(HAVE) & nx(BE))))
    odd |= has(CONJ) & nx(CONJ)
    odd |= has(WE) & nx(ART | PREP | TO)
    odd &= ~has(CLOSED)
    scrambled = np.zeros(n, bool)
    where = np.flatnonzero(odd)
    if len(where):
        own, first, count = np.unique(begin[where], return_index=True, return_counts=True)
        lo, hi = where[first], where[first + count - 1]
        bad = (count >= 2) & (count / (hi - lo + 1) >= p.order_share)
        marks = np.concatenate([[0], np.cumsum(has(CLOSED))])
        for a, b, e in zip(lo[bad], hi[bad], end[lo[bad]]):
            start = begin[a]
            if marks[e] - marks[start] < p.mark_share * (e - start):  # no sentence has an end: it is shuffled as a whole
                a, b = start, e
            scrambled[max(a - p.order_margin, start) : min(b + p.order_margin + 1, e)] = True
    share = lambda x, k: _window(x, *wide(k)) / np.maximum(wide(k)[1] - wide(k)[0], 1)
    plain = np.maximum(_window(~has(NUM), *wide(p.around)), 1)
    around = (_window(func, *wide(p.around)) - _window(has(INIT), *wide(p.around))) / plain
    run = (_window(verb, *wide(p.reach)) > 0) & (around >= p.func_share) & (share(verb, 36) >= p.verb_share) & ~scrambled
    return run, verb, odd


def batch_stats(texts: list, known: Words, p: ProseParams = ProseParams()) -> dict[str, np.ndarray]:
    """The columns of STATS for the texts of a batch; null and blank texts give zeros."""
    per = [t.lower().split() if t else [] for t in texts]
    n = np.fromiter(map(len, per), np.int64, len(per))
    code = known.codes([w for ws in per for w in ws])
    of = lambda a: np.frombuffer(a, np.int32)[code] if len(code) else np.zeros(0, np.int32)
    bits, size = of(known.bits), of(known.size)
    bound = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    run, verb, odd = prose_mask(bits, bound[doc], bound[doc + 1], p)
    total = lambda x: np.bincount(doc, x, len(n)) if len(doc) else np.zeros(len(n))
    one = np.maximum(n, 1)
    share = lambda x: np.round(total(x) / one, 6)
    has = lambda b: (bits & b) != 0
    wide = len(known.bits) + 1
    pairs = np.unique(doc.astype(np.int64) * wide + code) if len(code) else np.zeros(0, np.int64)
    out = {
        "n_counted": n, "prose_words": total(run).astype(np.int64), "mean_word_length": share(size), "alpha_share": share(has(ALPHA)), "number_share": share(has(NUM)), "symbol_share": share(has(SYMBOL)),
        "common_share": share(has(FUNC)), "verb_share": share(verb), "odd_order_share": share(odd), "distinct_share": np.round(np.bincount(pairs // wide, minlength=len(n)) / one, 6),
        "core_words": total(has(CORE)).astype(np.int64),
    }
    lines = [[x for x in t.split("\n") if x and not x.isspace()] if t else [] for t in texts]
    m = np.fromiter(map(len, lines), np.int64, len(lines))
    by = lambda f: np.round(np.fromiter(map(f, lines), np.int64, len(lines)) / np.maximum(m, 1), 6)
    bullet = BULLET.match
    out["n_lines"] = m
    out["punctuated_lines"] = by(lambda ls: sum(1 for x in ls if x.rstrip().rstrip(CLOSERS).endswith(MARKS)))
    out["bullet_lines"] = by(lambda ls: sum(1 for x in ls if bullet(x)))
    out["repeated_lines"] = by(lambda ls: len(ls) - len(set(ls)))
    out["ellipsis_lines"] = by(lambda ls: sum(1 for x in ls if x.rstrip().endswith(("…", "..."))))
    return out


def statistics(rows: DataFrame, key: str = "chunk_ord", text: str = "text", p: ProseParams = ProseParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep` and those of STATS, one row per row. One pass over the text in Arrow batches, no shuffle."""
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in sliced(batches):
            got = batch_stats(b.column(1).to_pylist(), known, p)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *[pa.array(got[c], pa.int64() if t == "bigint" else pa.float64()) for c, t in STATS.items()]], [key, *keep, *STATS])

    return rows.select(key, text, *keep).mapInArrow(run, ", ".join([*types, *(f"{c} {t}" for c, t in STATS.items())]))


#: Published thresholds for web text, by the rule that records a failure.
RULES = {
    "few_words": "n_counted < 50",
    "word_length": "mean_word_length < 3 OR mean_word_length > 10",
    "symbols": "symbol_share > 0.1",
    "bullets": "bullet_lines > 0.9",
    "ellipsis": "ellipsis_lines > 0.3",
    "few_letters": "alpha_share < 0.8",
    "no_common_words": "core_words < 2",
    "repeated_lines": "repeated_lines > 0.3",
}


#: The rules whose failure decides by itself, in texts of the length that the rules are for. The others are recorded, as by the meaning of prose here a text may be short, crowded with numbers,
#: set as a list of sentences or repeated in part, and still be prose; the README has what each rule finds.
DECIDING = ("no_common_words", "ellipsis")


def judged(stats: DataFrame, p: ProseParams = ProseParams()) -> DataFrame:
    """Adds prose_share, verdict (prose, table, list, junk, blank) and reasons, the names of the rules that failed.

    A text is no prose if a deciding rule fails, and else if fewer than half of its words belong to running sentences, which is a rule of its own
    (few_sentences). A null, empty or blank text is 'blank', with no reasons."""
    share = F.round(F.col("prose_words") / F.greatest(F.col("n_counted"), F.lit(1)), 6)
    rules = [F.when(F.expr(cond), name) for name, cond in RULES.items()]
    rules += [
        F.when(F.col("prose_share") < p.prose_share, "few_sentences"),
        F.when(F.col("odd_order_share") >= p.order_share, "word_order"),
        F.when((F.col("n_counted") >= 40) & (F.col("distinct_share") < 0.15), "repetition"),
    ]
    kind = (
        F.when(F.col("n_counted") == 0, "blank")
        .when((F.col("prose_share") >= p.prose_share) & ~F.expr(f"NOT ({RULES['few_words']}) AND ({' OR '.join(RULES[r] for r in DECIDING)})"), "prose")
        .when(F.col("odd_order_share") >= p.order_share, "junk")
        .when((F.col("n_counted") >= 40) & (F.col("distinct_share") < 0.08), "junk")
        .when(F.col("number_share") > 0.4, "table")
        .when(F.col("bullet_lines") > 0.5, "list")
        .when((F.col("symbol_share") > 0.2) | (F.col("alpha_share") < 0.3) | (F.col("mean_word_length") > 12) | (F.col("number_share") + F.col("common_share") < 0.01), "junk")
        .otherwise("list")
    )
    rows = stats.withColumn("prose_share", share)
    reasons = F.when(F.col("n_counted") > 0, F.array_compact(F.array(*rules))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("verdict", kind).withColumn("reasons", reasons)
