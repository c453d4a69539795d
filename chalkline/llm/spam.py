"""Pages of repeated keywords, links, tags and menu items.

For each page the words are counted that belong to links outside sentences, to phrases that the page repeats, and to menu, product and tag items;
with entropy, distinct words and function words they make a vector. Per language its centre and scale are the median and the median absolute
deviation over all pages, and its correlation that of the clipped deviations, all from mergeable aggregates over the whole table. A page is spam
if its robust Mahalanobis distance is large and so is its score along the spam axis, more links, items and repeats and less
variety, in robust standard deviations of that score. Tables, references and code are far from the centre too, but in other directions.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.store import saved, sliced

INVISIBLE = re.compile("[\\u200b-\\u200f\\u2060\\ufeff\\xad]")
URL = re.compile(r"(?:https?://|www\.)[^\s\x02\x03]+|(?<![\w@.])(?:[a-z0-9-]+\.){1,3}[a-z]{2,10}/[^\s\x02\x03]*")
#: Links with their text: HTML, Markdown, wiki.
LINK = re.compile(r"<a\s[^<>]*>([^<]*(?:<(?!/?a[\s>])[^<]*)*)</a>|!?\[([^\[\]\n]+)\]\([^()\s]*\)|\[(?:https?://)\S+ ([^\[\]\n]+)\]", re.I)
TAG = re.compile(r"<[/!]?[A-Za-z-][^<>]*>")
LEET = str.maketrans("013457@$", "oieastas")
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("аеорсухіјѕԁһոΑΕΟΡΧοαАЕОРСХТМНВК", "aeopcyxijsdhnaeopxoaaeopcxtmhbk")
#: A line of keywords or index terms, as papers have one at their end.
KEYLINE = re.compile(r"(?im)^.{0,3}(?:key ?words|index terms|schlagw[oö]rter|mots[- ]cl[eé]s|palabras clave)\s*:.*$|(?<=[.!?] )(?:Keywords|Index terms): [^.\n]*$")
LEETED = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
#: Words, marks of links, and what parts or marks a segment.
TOKEN = re.compile(r"[\x02-\x04]|#?[^\W_](?:\w*[^\W_])?(?:['’][^\W_]+)*|#\w+|\n+|(?<=\s)[|/·•»>*–—-](?=\s|$)|[;,…]|[.!?](?=\s)|[€$£]|[=()]|::|(?<=\s)[!&](?=\s)")
WORDLIKE = re.compile(r"\w|#\w")
PARTING = set("|/·•»>*–—-;,….!?")
SEPARATORS = set(",;|/·•»>*–—-")
COUNTED = re.compile(r"\(\d{1,3}\)")
#: Words of page menus.
MENU = set("home archive share help login logout rss sitemap contact next previous top more maps map about shop data search subscribe newsletter imprint impressum privacy cookies cart checkout menu back print email register account faq terms".split())
#: Function words of English, German, French and Spanish beyond the delivered list, so that short sentences are known.
MORE_WORDS = {
    "en": "over under into upon per among above below near since until unless although though whereas while rather so yet only still never always once either neither nor whether we it there".split(),
    "de": "dass oder aber wenn weil da zum zur vom am beim durch gegen ohne um noch nur schon kann sehr wird sind hat haben wir sie er ihr diese dieser dieses einen einem einer keine mehr vor über unter zwischen ob weder noch so".split(),
    "fr": "d l n s c j m qu on il elle ils nous vous mais ou donc car si ni même aussi très bien à aux cet ces son sa ses leur leurs comme depuis après avant entre sous vers chez sans quand dont où être".split(),
    "es": "ni si ya muy también pero o sin sobre hasta desde donde cuando cada su sus este esta estos estas ese esa lo le les me nos hay ser está antes después según durante".split(),
}
#: The least part of a page of a word that returns often, and of all such words together where none stands out: the most of it. Pages of
#: the domain stay under 0.35.
OFTEN, JOINT = 0.005, 0.5
#: Fixed value: the least part of a page that a dominant phrase covers.
PHRASE = 0.07
FEATURES = ("link_share", "repeat_share", "item_share", "entropy_gap", "sameness", "function_gap")


@dataclass(frozen=True)
class SpamParams:
    distance: float = 7.0  # robust Mahalanobis distance of an outlier
    direction: float = 4.05  # its score along the spam axis, in robust standard deviations of that score
    axis: tuple[float, ...] = (1.0, 0.45, 1.0, 1.4, 0.0, 0.0)  # the spam axis: weights of the features' deviations
    least_scale: tuple[float, ...] = (0.05, 0.05, 0.03, 0.03, 0.05, 0.1)  # of each feature, about a word or two of a short page: most pages have no links or items at all
    clip: float = 3.0  # deviations beyond count as so many scales in the correlation
    shrink: float = 0.2  # of the correlation towards none
    least_pages: int = 50  # of a language with an estimate of its own; rarer ones share one


def lexicon(common: DataFrame) -> dict[str, set[str]]:
    """Function words by language: the delivered table (a few hundred rows, checked) with the fixed list."""
    rows = common.select("lang", "word").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the table of common words is larger than 10,000 rows")
    out = {k: set(v) for k, v in MORE_WORDS.items()}
    for r in rows:
        if r["lang"] and r["word"]:
            out.setdefault(r["lang"], set()).add(r["word"].lower())
    return out


def _norm(w: str) -> str:
    w = w.lower()
    if not w.isascii():
        w = w.translate(ALIKE)
    if w.isalpha():
        return w
    return w.translate(LEET) if LEETED.search(w) and sum(c.isdigit() for c in w) * 2 < len(w) + 1 and not w[0].isdigit() else w


def _repeated(words: list[str], content: np.ndarray, total: float) -> np.ndarray:
    """Which words belong to the page's dominant phrases: runs of 1 to 4 content words that return often and each cover a part of the page. Where
    all content words that return often make up a large part together, these belong to them too, however small the part of each."""
    n = len(words)
    out = np.zeros(n, bool)
    once = Counter(w for w, c in zip(words, content) if c)
    top = max(once.values(), default=0)
    if top < max(4, OFTEN * n):
        return out
    often = {w for w, m in once.items() if m >= max(4, OFTEN * n)}
    many = np.zeros(n, bool)
    # in changing order: where a whole text is delivered over and over, each word has the same one after it
    if sum(once[w] for w in often) >= JOINT * total and len({x for x, c in zip(zip(words, words[1:]), content) if c and x[0] in often}) >= 3 * len(often):
        many |= np.array([c and w in often for w, c in zip(words, content)], bool)
    if top < max(4, 0.02 * n):
        return many
    strong = {w for w, m in once.items() if m >= 3}
    free = [c and w in strong for w, c in zip(words, content)]
    while True:  # each phrase found is a part of the page of its own, so there are at most 1 / PHRASE
        best, gain = None, 0.0
        for k in (4, 3, 2, 1):
            c = Counter(tuple(words[i : i + k]) for i in range(n - k + 1) if free[i] and all(free[i : i + k]))
            for p, m in c.most_common(3):
                if len(set(p)) == len(p):
                    if m >= 4 and m * k > gain * 1.1:
                        best, gain = p, m * k
                    break
        if best is None or gain < PHRASE * total:
            break
        k, i = len(best), 0
        while i <= n - k:
            if free[i] and all(free[i : i + k]) and tuple(words[i : i + k]) == best:
                out[i : i + k] = True
                free[i : i + k] = [False] * k
                i += k
            else:
                i += 1
    return out | many


def _runs(flag: np.ndarray, least: int, page: np.ndarray) -> np.ndarray:
    """Which of the set places lie in a run of at least `least` on one page; one gap in a row is allowed."""
    out = np.zeros(len(flag) + 1, np.int64)
    at = np.flatnonzero(flag)
    if len(at):
        new = np.concatenate([[True], (np.diff(at) > 2) | (page[at[1:]] != page[at[:-1]])])
        first = np.flatnonzero(new)
        long = np.diff(np.append(first, len(at))) >= least
        np.add.at(out, at[first[long]], 1)
        np.add.at(out, at[np.append(first[1:], len(at)) - 1][long] + 1, -1)
    return np.cumsum(out[:-1]) > 0


# bits of a token
LINKED, ADDRESS, HASH, SINGLE, SHORTCAP, NUMBER, FUNCTION, MENUWORD, PART, ITEMPART, ARROW, OPEN, CLOSE, CODEMARK, PRICE, ISWORD, CODEWORD, ENDWORD = (1 << i for i in range(18))
CODEWORDS = set("if then for call real return do while".split())


class Lexis:
    """Function words by language, and the bits, normal form and languages of every token seen, kept from batch to batch."""

    MOST = 400_000

    def __init__(self, lex: dict[str, set[str]]) -> None:
        self.lex = lex
        self.langs = sorted(lex, key=lambda k: (k == "en", k), reverse=True)  # of equals the first counts
        self.every = set().union(*lex.values())
        self.reset()

    def reset(self) -> None:
        self.of: dict[str, int] = {}
        self.norms: dict[str, int] = {}
        self.norm: list[str] = []
        self.bits, self.in_lang, self.norm_no, self.first = (array("i") for _ in range(4))

    def add(self, t: str) -> int:
        w, b = t, 0
        if t == "\x02":
            b = OPEN
        elif t == "\x03":
            b = CLOSE
        elif t == "\x04":
            b = ADDRESS | ISWORD
        elif WORDLIKE.match(t):
            w = _norm(t.lstrip("#"))
            b = ISWORD | HASH * (t[0] == "#") | SINGLE * (len(t) == 1 and t.isalpha()) | SHORTCAP * (len(t) < 6 and t.isupper()) | NUMBER * t.isdigit() | ENDWORD * (w == "end")
            b |= FUNCTION * (w in self.every and not b & (HASH | SINGLE)) | MENUWORD * (w in MENU) | PRICE * (w == "sku") | CODEMARK * ("_" in t and t[0] != "#" and t[0].islower()) | CODEWORD * (w in CODEWORDS)
        elif t[0] == "\n":
            b = PART
        elif t in PARTING:
            b = PART | ITEMPART * (t in SEPARATORS) | ARROW * (t == "»")
        elif t in "€$£":
            b = PRICE
        else:
            b = CODEMARK
        self.of[t] = n = len(self.bits)
        self.norm.append(w)
        self.norm_no.append(self.norms.setdefault(w, len(self.norms)))
        self.first.append(ord(w[0]))
        self.bits.append(b)
        self.in_lang.append(sum(1 << i for i, k in enumerate(self.langs) if b & ISWORD and w in self.lex[k]))
        return n

    def codes(self, tokens: list[str]) -> list[int]:
        get, add = self.of.get, self.add
        return [n if (n := get(t)) is not None else add(t) for t in tokens]


def _marked(text: str) -> str:
    """The text with marks for links and addresses in place of their markup, and without keyword lines and invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if ":" in text:
        text = KEYLINE.sub(" ", text)
    if "<" in text or "](" in text or "[http" in text:
        plain, at = [], 0
        for m in LINK.finditer(text):
            label = next((g for g in m.groups() if g is not None), "")
            plain += [text[at : m.start()], "\x02", TAG.sub(" ", label).replace("\n", " "), "\x03"]
            at = m.end()
        text = TAG.sub(" ", "".join([*plain, text[at:]]))
    return URL.sub("\x04", text) if "/" in text or "www." in text else text


def _phrased(doc: np.ndarray, word: np.ndarray, free: np.ndarray, pages: int) -> np.ndarray:
    """By page the most words that one phrase of 1 to 4 words covers, if it returns 4 times: no page's phrases cover more than this."""
    best = np.zeros(pages, np.int64)
    at = np.flatnonzero(free)  # first words of what may still be a phrase
    no = word[at].astype(np.int64)
    for k in range(1, 5):
        _, place, count = np.unique(doc[at] * (int(no.max(initial=0)) + 1) + no, return_inverse=True, return_counts=True)
        keep = count[place] >= 4
        at, no, count = at[keep], place[keep], count[place][keep]
        np.maximum.at(best, doc[at], k * count)
        more = at + k < len(doc)
        at, no = at[more], no[more]
        more = free[at + k] & (doc[at + k] == doc[at])
        at, no = at[more], no[more] * (int(word.max(initial=0)) + 1) + word[at[more] + k]
        if not len(at):
            break
        no = np.unique(no, return_inverse=True)[1]
    return best


def batch_features(texts: list[str], lexis: Lexis) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, words, the FEATURES as columns) of each page of a batch. Every word counts once: as link, as item, or as repeated. All pages
    are measured in one go: what is near a word never reaches beyond its page."""
    if len(lexis.bits) > lexis.MOST:
        lexis.reset()
    texts = [_marked(t) for t in texts]
    per = [lexis.codes(TOKEN.findall(t)) for t in texts]
    pages = len(per)
    size = np.fromiter(map(len, per), np.int64, pages)
    code = np.fromiter(chain.from_iterable(per), np.int32, int(size.sum()))
    of = lambda a, c: np.frombuffer(a, np.int32)[c] if len(a) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(pages), size)
    all_bits = of(lexis.bits, code)
    part = (all_bits & PART) != 0
    seg = np.cumsum(part) + doc  # number of the segment, of each token; a page begins a new one
    turns = np.concatenate([[0], np.cumsum(((all_bits & OPEN) != 0).astype(np.int64) - ((all_bits & CLOSE) != 0))])
    opened = turns[1:] - turns[np.concatenate([[0], np.cumsum(size)])[doc]]
    at = np.flatnonzero(all_bits & ISWORD)
    n_words = np.bincount(doc[at], minlength=pages)
    if not len(at):
        return ["none"] * pages, n_words, np.zeros((len(FEATURES), pages))
    doc, code = doc[at], code[at]
    bits = all_bits[at] | LINKED * (opened[at] > 0)
    bound = np.concatenate([[0], np.cumsum(n_words)])
    begin, end, pos = bound[doc], bound[doc + 1], np.arange(len(at))
    new = np.concatenate([[True], np.diff(seg[at]) != 0])
    sid, first = np.cumsum(new) - 1, np.flatnonzero(new)
    kept, m, page = seg[at][first], len(first), doc[first]
    length = np.bincount(sid)
    ended = np.zeros(seg[-1] + 2, np.int32)  # by segment the mark that ends it
    ended[seg[part] - 1] = all_bits[part]
    ends = ended[kept]
    among = lambda b: np.bincount(seg, (all_bits & b) != 0)[kept] > 0
    marked, priced = among(CODEMARK), among(PRICE)
    hits = np.stack([np.bincount(doc, (of(lexis.in_lang, code) >> i) & 1, pages) for i in range(len(lexis.langs))])
    langs = [lexis.langs[i] if h else "none" for i, h in zip(hits.argmax(0).tolist(), hits.max(0).tolist())]
    has = lambda b: (bits & b) != 0
    func, address, link, number, letter = has(FUNCTION), has(ADDRESS), has(ADDRESS | LINKED), has(NUMBER), has(SINGLE)
    # 'HF heat flux': short, in capitals, and the next word begins with its first letter
    after = lambda x: np.append(x[1:], x[:1])
    letters = of(lexis.first, code)
    acronym = has(SHORTCAP) & ~after(has(SHORTCAP)) & (pos + 1 < end) & (letters == after(letters))
    count = lambda x: np.bincount(sid, x, m)
    fs, ns, ac = count(func), count(number | letter), count(acronym)
    coded = marked | has(CODEWORD)[first] & (count(number) > 0) | (length == 2) & has(ENDWORD)[first] & after(has(CODEWORD))[first]

    def near(x: np.ndarray, reach: int = 12) -> np.ndarray:
        a, b = np.maximum(pos - reach, begin), np.minimum(pos + reach + 1, end)
        c = np.concatenate([[0], np.cumsum(x)])
        return (c[b] - c[a]) / (b - a)

    weight = np.where(address, 3, 1)  # an address counts as some words
    func_near, number_near, letter_near = near(func), near(number), near(letter)
    paper = (near(letter & ~func) >= 0.1) | (near(acronym) >= 0.18) | (number_near >= 0.3)  # names and references, glossaries, tables
    # links outside sentences, and lines that end in an address or a link arrow
    in_link = np.zeros(len(at), bool)
    arrow = (ends & ARROW) != 0
    if link.any() or arrow.any():
        seg_link = ((count(address) > 0) & (length <= 16) & (fs < 0.5 * length)) | (count(link) >= 0.8 * length) | arrow
        in_link = (near(link) >= 0.55) | (near(address) >= 0.08) & (func_near < 0.3) | _runs(seg_link, 3, page)[sid] & (near(link | arrow[sid]) >= 0.08)
    # menu, product, tag and keyword items in rows
    item = priced & (length <= 14) & (fs <= 0.34 * length)
    plain = ~coded & (ns == 0) & ((ac == 0) | (length == ac)) & ~paper[first]
    bare = (length <= 9) & (fs <= 0.25 * length) & plain
    short = (length <= 5) & (fs <= 0.5 * length) & plain & ((ends & ITEMPART) != 0)
    item |= _runs(bare, 6, page) & bare | _runs(short, 8, page) & short
    in_item = item[sid] | (near(has(MENUWORD)) >= 0.22) & (func_near < 0.15) & ~paper | (near(has(PRICE)) >= 0.075) | (near(has(HASH)) >= 0.4)
    clouds = np.array([len(COUNTED.findall(t)) if t.count("(") >= 4 else 0 for t in texts])
    for d in np.flatnonzero((clouds >= 4) & (n_words > 0)).tolist():
        own = slice(bound[d], bound[d + 1])
        if number_near[own].max() < 0.45:
            in_item[own] |= (number_near[own] >= 0.13) & (func_near[own] < (0.12 if clouds[d] < 8 else 0.4)) & (letter_near[own] < 0.05)
    # no function word far and wide, and no table, name list or code either
    in_item |= (n_words >= 15)[doc] & (func_near < 0.07) & (number_near < 0.06) & (letter_near < 0.06) & ~paper & ~coded[sid]
    in_item &= ~in_link
    total = np.bincount(doc, weight, pages)
    word = of(lexis.norm_no, code)
    content = ~(in_link | in_item | func | address | number | letter | paper)
    rep, stuffed = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for d in _may_repeat(doc, word, content, n_words, total).tolist():
        own = slice(bound[d], bound[d + 1])
        words = [lexis.norm[c] for c in code[own].tolist()]
        found = _repeated(words, content[own], total[d])
        if found.any():
            rep[own], n = found, len(words)
            varied = np.concatenate([np.full(len(b), len(set(b)) / len(b)) for b in (words[i : i + 50] for i in range(0, n, 50))])
            c, i = np.concatenate([[0], np.cumsum(found)]), np.arange(n)
            wide = (c[np.minimum(i + 26, n)] - c[np.maximum(i - 25, 0)]) / (np.minimum(i + 26, n) - np.maximum(i - 25, 0))
            stuffed[own] = ~(in_link | in_item)[own] & ((wide >= 0.26) & (varied < 0.56) | (wide >= 0.38))
    own = ~(paper | number | coded[sid])  # number series, glossaries and code repeat their labels
    share = lambda x: np.bincount(doc, weight * x, pages) / np.maximum(total, 1)
    gap = _gap(doc[own], word[own], pages)
    function_gap = np.where(n_words > 0, np.maximum(0.0, 0.35 - np.bincount(doc, func, pages) / np.maximum(n_words, 1)), 0.0)
    return langs, n_words, np.round(np.stack([share(in_link), share(stuffed), share(in_item), gap, share(rep), function_gap]), 6)


def _may_repeat(doc: np.ndarray, word: np.ndarray, content: np.ndarray, n_words: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pages that could have dominant phrases or many words that return often: those for which a bound on both does not rule it out."""
    at = np.flatnonzero(content)
    pages = len(n_words)
    key, place, count = np.unique(doc[at] * (int(word.max(initial=0)) + 1) + word[at], return_inverse=True, return_counts=True)
    page = key // (int(word.max(initial=0)) + 1)
    often = np.bincount(page, np.where(count >= np.maximum(4, OFTEN * n_words[page]), count, 0), pages)
    free = np.zeros(len(doc), bool)
    free[at] = count[place] >= 3
    return np.flatnonzero((often > 0) & ((often >= JOINT * total) | (_phrased(doc, word, free, pages) >= PHRASE * total)))


def _gap(doc: np.ndarray, word: np.ndarray, pages: int) -> np.ndarray:
    """By page how much less varied these words are than those of an ordinary text of as many words; 0 for under 20 words."""
    n = np.bincount(doc, minlength=pages).astype(float)
    wide = int(word.max(initial=0)) + 1
    key, count = np.unique(doc * wide + word, return_counts=True)
    page = key // wide
    p = count / n[page]
    entropy = np.bincount(page, -p * np.log(p), pages) / np.log(np.maximum(n, 2))
    return np.where(n < 20, 0.0, np.maximum(0.0, 0.90 - 0.055 * np.log(np.maximum(n, 60) / 60) - entropy))


# --- the corpus ----------------------------------------------------------------------------------------------------------------------


def measured(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_found, n_words and the FEATURES of each page; null, empty and wordless texts are left out. One Arrow pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.sparkSession.sparkContext.broadcast(lexicon(common))  # a few hundred words, checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexis = Lexis(own.value)
        for b in sliced(batches, 512):
            langs, n, x = batch_features([t or "" for t in b.column(1).to_pylist()], lexis)
            some = pa.array(np.flatnonzero(n))
            cols = [b.column(0), pa.array(langs, pa.string()), pa.array(n, pa.int64()), *[pa.array(c, pa.float64()) for c in x]]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in cols], [key, "lang_found", "n_words", *FEATURES])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_found string, n_words bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def centres(pages: DataFrame, p: SpamParams = SpamParams()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language (centre, scale, correlation) of the features, and of all pages under ''. Three aggregates with partial results; what
    comes to the driver is a row a language."""
    # pages without any function word have no language; they are measured against all pages
    own = F.when(F.col("lang_found") == "none", F.array(F.lit(""))).otherwise(F.array(F.col("lang_found"), F.lit("")))
    both = pages.withColumn("_l", F.explode(own))
    med = {r["_l"]: r for r in both.groupBy("_l").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES]).collect()}
    med = {k: r for k, r in med.items() if k == "" or r["n"] >= p.least_pages}
    if "" not in med:
        return {}
    at = lambda f, of: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, float(v))]), F.col("_l")), F.lit(0.0))
    kept = both.filter(F.col("_l").isin(*med))
    dev = [F.abs(F.col(f) - at(f, {k: r[f] for k, r in med.items()})).alias(f) for f in FEATURES]
    mad = {r["_l"]: r for r in kept.select("_l", *dev).groupBy("_l").agg(*[F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES]).collect()}
    scale = {k: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), np.array(p.least_scale)) for k, r in mad.items()}
    z = [
        F.least(F.lit(p.clip), F.greatest(F.lit(-p.clip), (F.col(f) - at(f, {k: r[f] for k, r in med.items()})) / at(f, {k: s[j] for k, s in scale.items()}))).alias(f)
        for j, f in enumerate(FEATURES)
    ]
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    cov = kept.select("_l", *z).groupBy("_l").agg(*[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in cov:
        m = np.eye(len(FEATURES))
        for i, j in pairs:
            both_vary = r[f"c{i}_{i}"] * r[f"c{j}_{j}"]
            if i != j and both_vary > 0:
                m[i, j] = m[j, i] = (1 - p.shrink) * r[f"c{i}_{j}"] / both_vary**0.5
        out[r["_l"]] = (np.array([med[r["_l"]][f] for f in FEATURES]), scale[r["_l"]], m)
    return out


def judged(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", p: SpamParams = SpamParams()) -> DataFrame:
    """key, lang_found, n_words, the FEATURES, distance, direction, is_spam of each page with words. distance is the robust Mahalanobis distance
    from the language's centre, direction the deviation's score along the spam axis over the robust standard deviation that the language's scales and
    correlation give this score. A page is spam if it is far enough out and lies far enough in that direction. Repeated rows are judged each; an empty table gives none."""
    pages = saved(measured(docs, common, key, text))
    own = docs.sparkSession.sparkContext.broadcast(centres(pages, p))

    @F.pandas_udf("distance double, direction double")
    def placed(lang: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x, axis = np.column_stack([c.to_numpy() for c in cols]), np.array(p.axis)
        out = np.zeros((len(x), 2))
        known = lang.map(lambda v: v if v in own.value else "")
        for k, where in known.groupby(known).indices.items():
            centre, scale, related = own.value[k]
            d, w = (x[where] - centre) / scale, scale * axis
            out[where, 0] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, np.linalg.inv(related), d), 0))
            out[where, 1] = d @ w / np.sqrt(w @ related @ w)
        return pd.DataFrame(np.round(out, 4), columns=["distance", "direction"])

    rows = pages.withColumn("_p", placed("lang_found", *FEATURES)).select("*", "_p.distance", "_p.direction").drop("_p")
    return rows.withColumn("is_spam", (F.col("distance") >= p.distance) & (F.col("direction") >= p.direction))
