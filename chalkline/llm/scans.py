"""Noise of scanned pages: finding it and repairing it.

Evidence comes from the corpus's own vocabulary. Every distinct word has an anagram hash, the sum of the fifth powers of its code points; a
misreading (o as 0, m as rn) changes it by a fixed difference, so rare words meet their frequent variants by an equi-join on hash plus difference,
whatever the place of the error. The best-ranked variant is the correction. Words run together are found as two frequent words in one. Hyphens at
line ends are judged by whether the joined or the hyphenated form is known, and running headers and page numbers by their form at the edge of a
line. Halves of split words and cut-off words grow in number with the corpus, so they are told by how much more frequent the whole word is. All
joins are on distinct words, of which a corpus has few; the most frequent ones (a fixed number) are broadcast to the texts. If there are more, each
text asks for the facts that it could need (known words, corrections, split words, beginnings) in a shuffled join, so the results are the same
whatever the size of the broadcast part.
"""

from __future__ import annotations

import re
from array import array
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import prose
from chalkline.llm.store import most_frequent, saved, sliced

#: Print and what a scan makes of it.
CONFUSED = (
    ("o", "0"), ("l", "1"), ("l", "|"), ("i", "í"), ("a", "ä"), ("e", "c"), ("c", "("), ("h", "b"), ("t", "f"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("rn", "m"), ("cl", "d"),
    ("i", "1"), ("i", "|"), ("s", "5"), ("b", "6"), ("g", "9"), ("z", "2"), ("n", "ri"), ("o", "ö"), ("u", "ü"), ("e", "é"),
)
HYPHENS = "-\xad‐¬"
EDGE = "\"'“”‘’,.;:!?)]}>*…"
#: So many of the first entries are also tried two in a word.
PAIRED = 15
FORM = re.compile(r"^[(]?[a-zß-ÿ|(0-9]{2,24}$")
COMPOUND = re.compile(r"^[a-zß-ÿ]{2,}(?:-[a-zß-ÿ]{2,}){1,3}$")
LETTERS = re.compile(r"[a-zß-ÿ]")
#: Ligatures that a reader took for letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")
PLAIN = re.compile(r"^[a-zß-ÿ]{1,24}$")
PUNCT_GLUE = re.compile(r"^([a-z]{2,})([.,;])([A-Za-z][a-z]+)$")
DIGIT_GLUE = re.compile(r"^(than|of|in|by|about|near|for|to|over|and|from|between|roughly|around|with|at|after|before|since)(\d[\d.]*%?)$")
SUSPENDED = {"and", "or", "to", "und", "et", "y", "o", "ou"}
ROMAN = r"\[[ivxlc]+\]"
#: Running headers and page numbers, by form. Those in capitals count only in texts that are not set in capitals.
HEADERS = (
    (("Page ",), re.compile(r"\bPage \d{1,4} of \d{1,4}\b")),
    (("[",), re.compile(rf"(?<!\S){ROMAN}(?!\S)")),
    (("– ", "— ", "- "), re.compile(r"(?<!\S)[–—-] \d{1,4} [–—-](?!\S)")),
    (("Report ", "REPORT "), re.compile(r"(?:(?<!\S)\d{1,4} )?\b(?:Report|REPORT) \d{1,3}/\d{4}(?: \d{1,4}(?!\S))?")),
    ((" Vol. ", " VOL. "), re.compile(r"(?:(?<!\S)\d{1,4} )?(?:[A-Z]\w+ (?:of|OF|the|THE) )?(?:[A-Z]\w+ ){0,3}[A-Z]\w+, (?:Vol|VOL)\. \d{1,3}(?: \d{1,4}(?!\S))?")),
    ((" et al. ",), re.compile(r"\b[A-Z][a-z]+ et al\. \d{1,3}(?!\S)")),
    (("\n",), re.compile(r"(?<=\n)[ \t]*\d{1,4}[ \t]*(?=\n)")),
)
#: A line that holds only the year of a sentence.
YEAR_LINE = re.compile(r"\b(?:in|by|since|from|to|and|around|until|after|before|during|of)\s*\n[ \t]*(?:1[89]|20)\d\d[ \t]*$")
TWO_CAPITALS = re.compile(r"[A-Z]{2}[.,:]* [A-Z]{2}|\d [A-Z]{2}")
PURE = re.compile(r"(?<!\S)[A-Z]{2,}(?=[.,:]*(?:\s|$))")  # a word in capitals that is no model's name
UPPER, LETTER = re.compile(r"[A-Z]"), re.compile(r"[A-Za-z]")
CAPITALS = re.compile(r"(?:(?<!\S)\d{1,4} )(?:[A-Z][A-Z0-9.,:&-]*[ ]){2,}[A-Z][A-Z0-9.,:&-]*|(?<!\S)(?:[A-Z][A-Z.,:&-]+ ){3,}[A-Z][A-Z.,:&-]+(?: \d{1,4})?(?!\S)")
TITLE_LINE = re.compile(r"(?<=\n)(?=[A-Z])([^\n.]{12,90}?) \d{1,3}(?=\n)")


@dataclass(frozen=True)
class ScanParams:
    frequent: int = 10  # uses that make a word known
    ratio: int = 20  # times that a variant must be as frequent as the misread word; more for short words
    glue_ratio: int = 50  # also times that a word must be as frequent as the pair of its halves, where both halves are known
    hot: int = 131072  # words in the broadcast part


def core(token: str) -> str | None:
    """A token without punctuation, in lower case; None if it has no form that scanning could have damaged (numbers, names in capitals, markup)."""
    t = token.rstrip(EDGE)
    if t[:1] in "\"'“‘[{<" and len(t) > 1:
        t = t[1:]
    if t[:1] == "(" and not token.endswith("("):
        t = t[1:]
    if t[1:] != t[1:].lower() and not t.isupper():
        return None
    t = t.lower()
    if "-" in t:
        return t if COMPOUND.match(t) else None
    return t if FORM.match(t) and len(LETTERS.findall(t)) * 2 >= len(t) else None


def vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """word, n, low: distinct cores of all texts, their uses, and how many of those start in lower case. Counted a batch at a time first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counter) -> pa.RecordBatch:
            by: dict[str, list[int]] = {}
            for t, n in held.items():
                c = core(t)
                if c is not None:
                    e = by.setdefault(c, [0, 0])
                    e[0] += n
                    e[1] += n * (t.lstrip("\"'(“‘")[:1].islower())
            return pa.RecordBatch.from_arrays([pa.array(by.keys(), pa.string()), pa.array([e[0] for e in by.values()], pa.int64()), pa.array([e[1] for e in by.values()], pa.int64())], ["word", "n", "low"])

        held: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(t.split())
            if len(held) > 400_000:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    counted = rows.select(text).mapInArrow(count, "word string, n bigint, low bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))


def anagram_hash(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def _hash_column(word):
    return F.aggregate(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.pow(F.ascii(c), F.lit(5)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def corrections(words: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """word, fix, kind, n: for each damaged word the best-ranked correction; kind is 'misread' or 'glued'. words: word, n, low."""
    known = words.filter((F.col("low") >= p.frequent) & F.col("word").rlike(PLAIN.pattern)).select(F.col("word").alias("fix"), F.col("n").alias("fn"))
    if known.limit(p.hot + 1).count() <= p.hot:
        known = F.broadcast(known)  # at most p.hot short words; more of them meet in shuffled joins
    words = words.filter(~F.col("word").contains("-"))  # compounds only tell which hyphens are sound
    rare = words.filter((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]"))
    rare = rare.unionByName(words.filter((F.length("word") >= 3) & F.col("word").rlike("^[0-9][a-z]{2,}")))
    diff = lambda o, m: anagram_hash(o) - anagram_hash(m)
    cost = lambda o, m: max(len(o), len(m))
    steps = [((m,), diff(o, m), cost(o, m)) for o, m in CONFUSED]
    pairs = [(x, y) for i, x in enumerate(CONFUSED[:PAIRED]) for y in CONFUSED[i + 1 : PAIRED]]
    steps += [((x[1], y[1]), diff(*x) + diff(*y), cost(*x) + cost(*y)) for x, y in pairs]
    tries = F.array_compact(F.array(*[F.when(_has(ms), F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(c).alias("c"))) for ms, d, c in steps]))
    hashed = rare.select("word", "n", "low", _hash_column(F.col("word")).alias("_h"), F.explode(F.array_distinct(tries)).alias("_s")).select("word", "n", "low", "_h", F.col("_s.d").alias("_d"), F.col("_s.c").alias("_c"))
    target = known.withColumn("_v", _hash_column(F.col("fix")))
    met = hashed.join(target, F.col("_h") + F.col("_d") == F.col("_v"))
    least = F.when(F.length("word") >= 5, p.ratio).when(F.length("word") == 4, 3 * p.ratio).otherwise(15 * p.ratio)
    near = F.levenshtein("word", "fix") <= F.col("_c")  # the same letters but for the misread ones, and in the same order
    misread = met.filter((F.col("fn") >= least * F.col("n")) & near & (F.col("low") > 0)).select("word", "n", "fix", "fn", F.lit("misread").alias("kind"))
    misread = misread.join(misread.select(F.col("word").alias("fix")).distinct(), "fix", "left_anti").select("word", "n", "fix", "fn", "kind")  # not to another misreading
    cut = rare.filter((F.length("word") >= 5) & (F.col("low") > 0) & F.col("word").rlike(PLAIN.pattern)).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("_i"))
    parts = cut.select("word", "n", F.expr("substring(word, 1, _i)").alias("_a"), F.expr("substring(word, _i + 1)").alias("_b"))
    left, right = known.select(F.col("fix").alias("_a"), F.col("fn").alias("_na")), known.select(F.col("fix").alias("_b"), F.col("fn").alias("_nb"))
    both = parts.join(left, "_a").join(right, "_b")
    fair = (F.least("_na", "_nb") >= p.glue_ratio * F.col("n")) & (F.length("_a") + F.length("_b") >= 5) & ((F.length("_a") > 1) | (F.col("_a") == "a")) & (F.length("_b") > 1)
    glued = both.filter(fair).select("word", "n", F.concat_ws(" ", "_a", "_b").alias("fix"), F.least("_na", "_nb").alias("fn"), F.lit("glued").alias("kind"))
    best = F.max_by(F.struct("fix", "kind", "n"), F.struct(F.col("kind"), F.col("fn"), F.col("fix")))
    return misread.unionByName(glued).groupBy("word").agg(best.alias("_b")).select("word", "_b.fix", "_b.kind", "_b.n")


def fragments(words: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """word: beginnings that are used as words, often enough to be known, of words so much more frequent that they are these cut off."""
    whole = words.filter((F.col("low") >= p.frequent) & F.col("word").rlike(PLAIN.pattern) & (F.length("word") > 4))
    begins = whole.select("low", F.explode(F.sequence(F.lit(4), F.length("word") - 1)).alias("_i"), "word").groupBy(F.expr("substring(word, 1, _i)").alias("word")).agg(F.max("low").alias("_most"))
    return words.filter(F.col("n") >= p.frequent).join(begins, "word").filter(F.col("_most") >= 15 * p.ratio * F.col("n")).select("word")


def _pair(a: str, b: str) -> tuple[str, str] | None:
    """Two neighbouring tokens as the halves that a split word could have, in lower case."""
    if not a.isalpha():
        return None
    b = b.rstrip(EDGE)
    if not b.isalpha() or not (a.isupper() and len(a) > 1 if b.isupper() else b.islower()) or len(a) + len(b) < 5 or not (a[1:].islower() or len(a) == 1 or a.isupper()):
        return None
    return a.lower(), b.lower()


class Halves:
    """Counts neighbouring tokens that could be halves, as `_pair` has it, by the numbers of their forms."""

    MOST = 400_000

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.forms: dict[str, int] = {}
        self.first, self.second, self.bits = array("q"), array("q"), array("q")  # by token: number of the form as either half or -1; lengths and case
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, t: str) -> int:
        form = lambda x: self.forms.setdefault(x.lower(), len(self.forms))
        b = t.rstrip(EDGE)
        first = form(t) if t.isalpha() and (t[1:].islower() or len(t) == 1 or t.isupper()) else -1
        second = form(b) if b.isalpha() and (b.isupper() or b.islower()) else -1
        self.of[t] = n = len(self.bits)
        self.first.append(first)
        self.second.append(second)
        self.bits.append(min(len(t), 0xFFFFF) | (t.isupper() and len(t) > 1) << 20 | b.isupper() << 21 | len(b) << 32)
        return n

    def count(self, texts: list) -> None:
        get, add, codes, ends = self.of.get, self.add, [], []
        for t in texts:
            if t and (tokens := t.split()):  # a blank text has no end of its own
                codes += [n if (n := get(w)) is not None else add(w) for w in tokens]
                ends.append(len(codes))
        if len(codes) < 2:
            return
        code = np.array(codes)
        of = lambda x, c: np.frombuffer(x, np.int64)[c]
        first, second, a, b = of(self.first, code[:-1]), of(self.second, code[1:]), of(self.bits, code[:-1]), of(self.bits, code[1:])
        ok = (first >= 0) & (second >= 0) & (((b >> 21 & 1) == 0) | ((a >> 20 & 1) == 1)) & ((a & 0xFFFFF) + (b >> 32) >= 5)
        ok[np.array(ends[:-1], np.int64) - 1] = False  # not from one text to the next
        self.held.append(np.stack(np.unique(first[ok] << 32 | second[ok], return_counts=True)))
        self.n += self.held[-1].shape[1]

    def taken(self) -> pa.RecordBatch:
        """The counts so far; starts anew."""
        keys, place = np.unique(np.concatenate([h[0] for h in self.held] or [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(place, np.concatenate([h[1] for h in self.held] or [np.zeros(0)]), len(keys)).astype(np.int64)
        words = pa.array(list(self.forms), pa.string())
        out = pa.RecordBatch.from_arrays([words.take(pa.array(keys >> 32)), words.take(pa.array(keys & 0xFFFFFFFF)), pa.array(n)], ["a", "b", "n"])
        self.__init__()
        return out


def splits(rows: DataFrame, words: DataFrame, fixes: DataFrame, p: ScanParams = ScanParams(), text: str = "text") -> DataFrame:
    """a, b: neighbouring words that are one split word, as the joined form is known and glue_ratio times as frequent as the pair. Pairs are
    counted a batch at a time first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = Halves()
        for b in sliced(batches):
            halves.count(b.column(0).to_pylist())
            if max(halves.n, len(halves.of)) > Halves.MOST:
                yield halves.taken()
        if halves.n:
            yield halves.taken()

    whole = words.filter((F.col("low") >= p.frequent) & F.col("word").rlike(PLAIN.pattern)).join(fixes.select("word"), "word", "left_anti").select("word", "low")
    pairs = rows.select(text).mapInArrow(count, "a string, b string, n bigint").withColumn("word", F.concat("a", "b"))
    pairs = pairs.join(whole, "word").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("low").alias("low"))
    return pairs.filter(F.col("low") >= p.glue_ratio * F.col("n")).select("a", "b")


def _has(ms: tuple[str, ...]):
    c = F.col("word").contains(ms[0])
    for m in ms[1:]:
        c = c & F.col("word").contains(m)
    return c


# --- the texts -----------------------------------------------------------------------------------------------------------------------

FINE, BAD, HYPHEN, RARE, OPEN, GLUE, FIRST = range(7)
#: Bit of a state: a word in capitals that is no model's name.
CAPITAL = 8


class Lexicon:
    """What is known of each token: good words, corrections, split words, and the state of every token seen, kept from batch to batch."""

    MOST = 400_000

    def __init__(self, good: set[str], fixes: dict[str, str], splits: frozenset[tuple[str, str]] = frozenset()) -> None:
        self.good, self.fixes, self.splits = good, fixes, splits
        self.firsts = {a for a, _ in splits}
        self.states: dict[str, int] = {}
        self.begins: set[str] | None = None

    def knowing(self, facts: list[dict] | None) -> Lexicon:
        """This lexicon, for one text, with facts that are not in the broadcast part."""
        return Wider(self, {f["fact"]: f["value"] for f in facts}) if facts else self

    def state(self, t: str) -> int:
        s = self.states.get(t)
        if s is None:
            if len(self.states) > self.MOST:
                self.states.clear()
            s = self.states[t] = self._state(t) | CAPITAL * bool(PURE.match(t))
        return s

    def _state(self, t: str) -> int:
        if len(t) > 2 and t[-1] in HYPHENS and t[-2].isalpha() and t.lstrip("\"'(“‘[")[0].isalpha():
            return HYPHEN
        if t[0] == "(" and ")" not in t and (r := t[1:].rstrip(EDGE)) in self.good and "c" + r in self.good:
            return OPEN
        if (m := PUNCT_GLUE.match(t.rstrip(EDGE))) and m[1] in self.good and m[3].lower() in self.good and (m[2] != "." or m[3][0].isupper()):
            return GLUE
        if (m := DIGIT_GLUE.match(t.rstrip(EDGE))) and m[1] in self.good:
            return GLUE
        c = core(t)
        fine = FIRST if t.isalpha() and t.lower() in self.firsts else FINE
        if c is None or len(c) < 2:
            return fine
        if c in self.fixes:
            return BAD
        return fine if c in self.good or "-" in c else RARE

    def split(self, a: str, b: str) -> bool:
        """Whether two neighbouring tokens are one split word."""
        return _pair(a, b) in self.splits

    def known(self, w: str) -> bool:
        return w in self.good

    def cut(self, c: str) -> bool:
        """Whether a rare word is the beginning of a known one, as where a running title was cut off."""
        if self.begins is None:
            self.begins = {w[:i] for w in self.good for i in range(4, len(w))}
        return c in self.begins


class Either:
    """Two sets as one, without a copy."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b

    def __contains__(self, x) -> bool:
        return x in self.a or x in self.b


class Wider(Lexicon):
    """A lexicon with facts for one text: known words, halves of split words ('a b'), beginnings of known words ('a*') and corrections ('a!')."""

    def __init__(self, base: Lexicon, facts: dict[str, str | None]) -> None:
        pairs = {tuple(f.split(" ")) for f in facts if " " in f}
        self.base, self.facts, self.states = base, facts, {}
        self.fixes = ChainMap({f[:-1]: v for f, v in facts.items() if f[-1] == "!"}, base.fixes)
        self.good, self.splits, self.firsts = Either(base.good, facts), Either(base.splits, pairs), Either(base.firsts, {a for a, _ in pairs})

    def cut(self, c: str) -> bool:
        return c + "*" in self.facts or self.base.cut(c)


def asked(text: str, lex: Lexicon, title: str | None = None) -> set[str]:
    """The facts that damage() and repaired_text() could ask for, whatever the answers, and that are not in the broadcast part."""
    out: set[str] = set()
    for t in {text, LIGATURE.sub(lambda m: LIGATURES[m[0]], _headless(text, title))}:
        toks = t.split()
        forms = []
        for a in toks:
            bare, c = a.rstrip(EDGE), core(a)
            low = {a.lower(), bare.lower(), bare.lstrip("\"'(").lower()}
            if c:
                low.add(c)
                out |= {c + "*", c + "!"}
            if a[0] == "(":
                out |= {a[1:].rstrip(EDGE), "c" + a[1:].rstrip(EDGE)}
            if m := PUNCT_GLUE.match(bare):
                low |= {m[1], m[3].lower()}
            if m := DIGIT_GLUE.match(bare):
                low.add(m[1])
            forms.append(low)
            out |= low
            if a[-1] in HYPHENS:
                out |= {x[:-1] for x in low}
        for i, (a, b) in enumerate(zip(toks, toks[1:])):
            for x in forms[i]:
                for y in forms[i + 1]:
                    if x[-1:] and x[-1] in HYPHENS:
                        out |= {x[:-1] + y, f"{x[:-1]}-{y}"}
                    elif x.isalpha() and y.isalpha():
                        out |= {x + y, f"{x} {y}"}
                        out |= {x + y + z for z in forms[i + 2] if z.isalpha()} if i + 2 < len(toks) else set()
    return {f for f in out if len(f) > 1 and f not in lex.good}


def joins(a: str, b: str, lex: Lexicon) -> bool:
    """Whether a token that ends in a hyphen and the next one are one broken word."""
    w1, h, w2 = a[:-1].lstrip("\"'("), a[-1], b.rstrip(EDGE)
    if not (w2[:1].islower() or w1.isupper() and w2.isupper()) or w2.lower() in SUSPENDED or not w2.isalpha():
        return False
    w1, w2 = w1.lower(), w2.lower()
    if lex.known(f"{w1}-{w2}") and not lex.known(w1 + w2):
        return False  # a sound compound
    return h != "-" or lex.known(w1 + w2) or not lex.known(w1)


def headers(text: str, capitals: bool = True) -> list[tuple[int, int]]:
    """Spans of running headers and page numbers inside a text. A pattern runs only where its fixed part occurs. capitals: whether there may be two
    words in capitals."""
    spans = [m.span() for mark, pattern in HEADERS if any(x in text for x in mark) for m in pattern.finditer(text) if not (m[0].strip().isdigit() and YEAR_LINE.search(text[max(0, m.start() - 20) : m.end()]))]
    if capitals and TWO_CAPITALS.search(text) and (found := [m.span() for m in CAPITALS.finditer(text) if len(PURE.findall(m[0])) >= 2]):
        if len(UPPER.findall(text)) < 0.4 * len(LETTER.findall(text)):
            spans += found
    if "\n" in text:
        for m in TITLE_LINE.finditer(text):
            ws = m[1].split()
            low = [w.lower() for w in ws]
            plain = not any(w.lstrip("-+").replace(".", "").isdigit() or not any(map(str.isalpha, w)) for w in ws)
            if len(ws) >= 3 and plain and low[-1] not in prose.SETS[prose.FUNC] and not ws[-1].isupper() and not any(w in prose.SETS[prose.VERB] or prose.PAST.match(w) for w in low):
                spans.append(m.span())
    return spans


#: Characters of a paper's title that make a running title; it may be cut off behind them.
TITLE_CHARS = 30
BY = re.compile(r"(?:[A-Z][\w-]+ and )?[A-Z][\w-]+: $")
NUMBERED = re.compile(r"\s+\d{1,4}(?!\S)")


def running_titles(text: str, title: str | None) -> list[tuple[int, int]]:
    """Spans where the paper's own title, whole or cut off, stands as a running title: inside a sentence, behind its authors, with a page number, or
    between two sentences without a mark of its own. A sentence that only begins like the title is none."""
    words = title.split() if title else []
    head = " ".join(words)[:TITLE_CHARS].rstrip()
    if len(head) < 15 or head.split(" ")[0] not in text:
        return []
    spans, full = [], " ".join(words)
    for m in re.finditer(r"(?<!\S)" + r"\s+".join(map(re.escape, head.split(" "))), text):
        a, b, n = m.start(), m.end(), len(head)
        while n < len(full) and b < len(text):  # as far as the title goes on
            if full[n] == " " and text[b].isspace():
                c = b
                while c < len(text) and text[c].isspace():
                    c += 1
                if c == len(text) or full[n + 1] != text[c]:
                    break
                n, b = n + 1, c
            elif full[n] == text[b]:
                n, b = n + 1, b + 1
            else:
                break
        if b < len(text) and not text[b].isspace():
            continue  # another word than the title's
        by = BY.search(text, max(0, a - 60), a)
        a = by.start() if by else a
        number = NUMBERED.match(text, b)
        before, after = text[:a].rstrip(), text[number.end() if number else b :].lstrip()
        inside = bool(before) and before[-1] not in ".!?:;"
        if by or number or inside or before and after[:1].isupper():
            spans.append((a, number.end() if number else b))
    return spans


def damage(text: str, lex: Lexicon, title: str | None = None) -> int:
    """Places where the text shows damage: broken, misread, split, run-together and cut-off words, headers, ligatures."""
    toks = text.split()
    get, state = lex.states.get, lex.state
    states = [s if (s := get(t)) is not None else state(t) for t in toks]
    found = capitals = 0
    last = len(toks) - 1
    for i, s in enumerate(states):
        if not s:
            continue
        if s & CAPITAL:
            capitals += 1
            s &= ~CAPITAL
        if s == FINE:
            continue
        if s == HYPHEN:
            found += joins(toks[i], toks[i + 1], lex) if i < last else toks[i][-1] != "-" or not lex.known(toks[i][:-1].lower())
        elif s == FIRST:
            found += i < last and states[i + 1] & ~CAPITAL in (FINE, FIRST) and lex.split(toks[i], toks[i + 1])
        elif s == OPEN:
            found += not any(")" in t for t in toks[i : i + 14])
        elif s == RARE:
            c = core(toks[i])
            if i and states[i - 1] & ~CAPITAL == HYPHEN:
                continue
            upper = toks[i].isupper() and len(c) > 1
            own = (toks[i][0].islower() or upper) and c.isalpha()
            nxt = toks[i + 1].rstrip(EDGE) if i < last else ""
            if own and (toks[i][-1].isalpha() and nxt and (nxt[0].islower() or upper and nxt.isupper()) and lex.known(c + nxt.lower()) or i and toks[i - 1].isalpha() and (not upper or toks[i - 1].isupper()) and lex.known(toks[i - 1].lower() + c)):
                found += 1
            elif own and len(c) >= 4 and toks[i][-1].isalpha() and lex.cut(c):
                found += 1
        else:
            found += 1
    return found + len(headers(text, capitals >= 2)) + len(running_titles(text, title)) + (0 if text.isascii() else len(LIGATURE.findall(text)))


def _known(words: DataFrame, fixes: DataFrame, p: ScanParams) -> DataFrame:
    return words.filter(F.col("n") >= p.frequent).join(fixes.select("word"), "word", "left_anti").join(fragments(words, p), "word", "left_anti")


def _hot(words: DataFrame, fixes: DataFrame, p: ScanParams) -> tuple[set[str], dict[str, str]]:
    """The broadcast part: at most p.hot good words and p.hot corrections, the most frequent ones, of at most 24 characters each. Words with an
    inner hyphen are taken as they are, to know sound compounds."""
    hot_fix = {r["word"]: r["fix"] for r in most_frequent(fixes, "n", p.hot).select("word", "fix").collect()}
    good = most_frequent(_known(words, fixes, p), "n", p.hot)
    return {r["word"] for r in good.select("word").collect()}, hot_fix


@dataclass(frozen=True)
class Noise:
    """What the corpus says: words, corrections, and the hot part of what is known as a broadcast."""

    words: DataFrame
    fixes: DataFrame
    hot: object
    more: DataFrame | None = None  # fact, value: known words, split words, beginnings and corrections, if some are not in the hot part


def learned(rows: DataFrame, text: str = "text", p: ScanParams = ScanParams()) -> Noise:
    """Vocabulary and corrections of a corpus; both tables are written to the shared folder."""
    words = saved(vocabulary(rows, text))
    fixes = saved(corrections(words, p))
    pairs = saved(splits(rows, words, fixes, p, text))
    good, hot_fix = _hot(words, fixes, p)
    known = saved(_known(words, fixes, p))
    own = frozenset((r["a"], r["b"]) for r in pairs.collect()) if (few := pairs.limit(p.hot + 1).count() <= p.hot) else frozenset()
    more = None
    if known.count() > len(good) or fixes.count() > len(hot_fix) or not few:
        begins = known.select(F.col("word"), F.explode(F.expr("sequence(4, greatest(4, length(word) - 1))")).alias("_i")).filter(F.length("word") > F.col("_i"))
        facts = known.select(F.col("word").alias("fact")).unionByName(pairs.select(F.concat_ws(" ", "a", "b").alias("fact")))
        facts = facts.unionByName(begins.select(F.expr("concat(substring(word, 1, _i), '*')").alias("fact")).distinct()).withColumn("value", F.lit(None).cast("string"))
        more = saved(facts.unionByName(fixes.select(F.concat("word", F.lit("!")).alias("fact"), F.col("fix").alias("value"))))
    return Noise(words, fixes, rows.sparkSession.sparkContext.broadcast((good, hot_fix, own)), more)


def _informed(rows: DataFrame, noise: Noise, key: str, text: str) -> DataFrame:
    """key, text, _x and _t. _t is the title, null if the rows have none. _x: the facts each text asks for and that are not in the broadcast part; null if all are. Only then do texts shuffle. A
    repeated key has the facts of all its rows, which say nothing wrong about any of them."""
    rows = rows.select(key, text, (F.col("title").cast("string") if "title" in rows.columns else F.lit(None).cast("string")).alias("_t"))
    if noise.more is None:
        return rows.withColumn("_x", F.lit(None).cast("array<struct<fact:string,value:string>>")).select(key, text, "_x", "_t")
    kind, hot = rows.schema[key].dataType.simpleString(), noise.hot

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*hot.value)
        for b in sliced(batches, 128):
            got = [(k, f) for k, t, h in zip(*(c.to_pylist() for c in b.columns)) if t for f in asked(t, lex, h)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], b.column(0).type), pa.array([f for _, f in got], pa.string())], ["_k", "fact"])

    facts = rows.mapInArrow(ask, f"_k {kind}, fact string").join(noise.more, "fact").groupBy("_k").agg(F.collect_set(F.struct("fact", "value")).alias("_x"))
    return rows.join(facts, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, text, "_x", "_t")


def _places(b: pa.RecordBatch, lex: Lexicon, known: prose.Words, q: prose.ProseParams) -> np.ndarray:
    """Damaged places of each text (second column; facts in the third, title in the fourth); 0 for texts that are not prose. Whether a text is prose is only worked out
    where there is something to show."""
    texts = b.column(1).to_pylist()
    n = np.array([damage(t, lex.knowing(x), h) if t else 0 for t, x, h in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())], np.int64)
    some = np.flatnonzero(n)
    stats = prose.batch_stats([texts[i] for i in some], known, q)
    n[some[stats["prose_words"] < q.prose_share * np.maximum(stats["n_counted"], 1)]] = 0
    return n


def damaged(rows: DataFrame, noise: Noise, key: str = "chunk_ord", text: str = "text", q: prose.ProseParams = prose.ProseParams()) -> DataFrame:
    """key, places: prose texts with scan damage and the number of damaged places. Texts that are not prose, null and blank ones are left out. A
    repeated key gives one row with the sum."""
    kind = rows.schema[key].dataType.simpleString()
    hot = noise.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, known = Lexicon(*hot.value), prose.Words()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_places(b, lex, known, q))], [key, "places"])

    return _informed(rows, noise, key, text).mapInArrow(run, f"`{key}` {kind}, places bigint").filter("places > 0").groupBy(key).agg(F.sum("places").alias("places"))


# --- repair --------------------------------------------------------------------------------------------------------------------------

BREAK = re.compile(rf"([^\W\d_][\w'’|(]*)([{HYPHENS}])(?:[ \t]+|[ \t]*\n[ \t]*)([^\W\d_][\w'’|(]*)")


def _headless(text: str, title: str | None = None) -> str:
    """The text without its running headers."""
    spans: list[list[int]] = []
    for a, b in sorted([*headers(text), *running_titles(text, title)]):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        left, right = text[:a].rstrip(), text[b:].lstrip()
        blank = text[len(left) : a].count("\n") + text[b : len(text) - len(right)].count("\n")
        text = left + ("" if not left or not right else "\n\n" if blank > 2 else "\n" if blank else " ") + right
    return text


def repaired_text(text: str, lex: Lexicon, title: str | None = None) -> str:
    """The text as continuous paragraphs: headers out, broken words joined, misread, run-together and split words put right."""
    text = _headless(text, title)
    text = LIGATURE.sub(lambda m: LIGATURES[m[0]], text)
    text = BREAK.sub(lambda m: m[1] + m[3] if joins(m[1] + m[2], m[3], lex) else m[0], text)
    fixes = lex.fixes

    def word(m: re.Match) -> str:
        t = m[0]
        s = lex.state(t) & ~CAPITAL
        if s == OPEN and ")" not in text[m.end() : m.end() + 80]:
            return "c" + t[1:]
        if s == GLUE:
            g = PUNCT_GLUE.match(t.rstrip(EDGE)) or DIGIT_GLUE.match(t.rstrip(EDGE))
            at = g.end(2) if g.lastindex == 3 else g.end(1)
            return t[:at] + " " + t[at:]
        if s == BAD:
            c = core(t)
            fix, at = fixes[c], t.lower().find(c)
            if t[at : at + 1].isupper():
                fix = fix.upper() if t.isupper() and len(c) > 1 else fix[0].upper() + fix[1:]
            return t[:at] + fix + t[at + len(c) :]
        return t

    text = re.sub(r"\S+", word, text)
    halves = re.compile(r"(?<!\S)([A-Za-z][a-z]*|[A-Z]+) ([a-z]+|[A-Z]+)(?=[\s.,;:)]|$)")

    def half(m: re.Match) -> str:
        a, b = m[1].lower(), m[2].lower()
        if m[2].isupper() != (m[1].isupper() and len(m[1]) > 1):
            return m[0]
        if lex.split(m[1], m[2]):
            return m[1] + m[2]
        return m[1] + m[2] if len(a + b) > 4 and len(a) > 1 and lex.known(a + b) and not (lex.known(a) and (lex.known(b) or len(b) == 1)) else m[0]

    for _ in range(2):  # the second time for pairs that overlap
        text = halves.sub(half, text)
    out = []
    for para in re.split(r"\n[ \t]*\n", text):
        lines = [x.strip() for x in para.split("\n") if x.strip()]
        listed = sum(1 for x in lines if prose.BULLET.match(x)) * 2 > len(lines) or (len(lines) > 1 and max(map(len, lines)) < 40)
        out.append("\n".join(lines) if listed else " ".join(lines))
    return "\n\n".join(x for x in out if x)


def repaired(rows: DataFrame, noise: Noise, key: str = "chunk_ord", text: str = "text", q: prose.ProseParams = prose.ProseParams()) -> DataFrame:
    """key, clean_text, changed, one row per row. Sound texts, texts that are not prose, null and blank ones come out unchanged; each text is judged
    and repaired in the same pass."""
    kind = rows.schema[key].dataType.simpleString()
    hot = noise.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, known = Lexicon(*hot.value), prose.Words()
        for b in sliced(batches):
            old, new = b.column(1).to_pylist(), b.column(1).to_pylist()
            facts, titles = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i in np.flatnonzero(_places(b, lex, known, q)):
                new[i] = repaired_text(old[i], lex.knowing(facts[i]), titles[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array([x != y for x, y in zip(old, new)])], [key, "clean_text", "changed"])

    return _informed(rows, noise, key, text).mapInArrow(run, f"`{key}` {kind}, clean_text string, changed boolean")
