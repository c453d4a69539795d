"""Column functions over text. All are built-in expressions, so they stay in the JVM and are pruned and pushed like any other column.

Null text gives a null string or an empty array, as each docstring states; an empty text is a text without words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, also the separators U+001C to U+001F; Java's and RE2's \s alone are ASCII.
WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
#: A token: a letter, then letters, digits, underscores and hyphens.
TOKEN = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_\-]*"
#: Characters that count as digits in a numeric word.
DIGIT = r"[\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
MIN_TOKEN = 2

#: The English stop words that tokenizing drops, in alphabetical order.
STOP_WORDS = tuple(
    """
a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and
another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being
below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire
first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein
hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less
ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no
nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone
something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore
therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
""".split()
)

#: The words in a section's title, in the order in which they are tried, and the type each stands for.
SECTION_KEYS = (
    ("introduction", "intro"), ("background", "intro"),
    ("method", "methods"), ("data", "methods"), ("experiment", "methods"),
    ("result", "results"), ("finding", "results"),
    ("discussion", "discussion"), ("conclusion", "discussion"),
)
NOISE_TITLES = ("references", "bibliography", "acknowledg")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once a row, however often it is named; in a plain expression Spark repeats it in each branch."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space at either end, by Unicode."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; null or blank text: an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, with repeats, without stop words and single characters; null text: an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*STOP_WORDS))


def stop_fraction(text: Column) -> Column:
    """Share of stop words among the ASCII words of the text; 0.0 if it has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return let(found, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda t: t.isin(*STOP_WORDS))) / F.size(ws)).otherwise(F.lit(0.0)))


#: The share of stop words from which a text is prose; the marks of each kind, and of all kinds together, from which another text is
#: a list of references; the share of words with digits above which it is a table.
PROSE, DOIS, ET_ALS, MARKS, TABLE = 0.32, 3, 4, 6, 0.5


def reference_like(text: Column) -> Column:
    """Whether a text is a reference list or a table rather than prose. Prose by its share of stop words is never one; then citation marks
    are counted, then words with digits. Null or empty text is kept (false)."""

    def judged(t: Column) -> Column:
        low = F.lower(t)
        years = F.regexp_count(t, F.lit(rf"(?:19|20)[0-9][0-9][a-z]?{WS}*\)"))
        cited = let(F.struct(F.regexp_count(low, F.lit("doi")).alias("d"), F.regexp_count(low, F.lit("et al")).alias("e")), lambda n: (n["d"] >= DOIS) | (n["e"] >= ET_ALS) | (n["d"] + n["e"] + years >= MARKS))
        table = let(words(t), lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.rlike(DIGIT))) / F.size(ws) > TABLE).otherwise(F.lit(False)))
        return F.when(stop_fraction(t) >= PROSE, F.lit(False)).when(cited, F.lit(True)).otherwise(table)

    return let(F.coalesce(text, F.lit("")), judged)


#: Left-overs of conversion from LaTeX, in the order in which they are blanked.
SCRUB_STEPS = (
    (rf"<{WS}*cit\.?{WS}*>", " "),
    (f"<{WS}*" + f"{WS}*".join("graphics") + f"{WS}*>", " "),
    (rf"§(?:{WS}*\.{WS}*§)*", " "),
    ("={4,}", " "),
    (rf"{WS}+([.,;:])", "$1"),
    (f"{WS}+", " "),
)


def scrub(text: Column) -> Column:
    """Text without conversion stubs, rules and blanks before punctuation; white space becomes one blank. Null stays null."""
    for pattern, to in SCRUB_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def section_type(title: Column) -> Column:
    """Type of a section by the first key its title contains, in the fixed order; null or other titles: 'other'."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F
    for key, kind in SECTION_KEYS:
        out = out.when(low.contains(key), F.lit(kind))
    return out.otherwise(F.lit("other"))


def noise_section(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(False)
    for key in NOISE_TITLES:
        out = out | low.contains(key)
    return out


def overlap(question: Column, chunk: Column) -> Column:
    """Share of the question's distinct tokens that the chunk has; 0.0 for a question without tokens."""
    return let(F.array_distinct(tokens(question)), lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(chunk))) / F.size(q)).otherwise(F.lit(0.0)))


def tex_body(tex: Column) -> Column:
    r"""Between the first \begin{document} and the last \end{document}; the whole text without a begin, up to the end without an end."""
    begin, end = r"\begin{document}", r"\end{document}"
    start = F.locate(begin, tex)
    back = F.locate(end[::-1], F.reverse(tex))
    stop = F.when(back > 0, F.length(tex) - back - len(end) + 2).otherwise(F.length(tex) + 1)
    first = start + len(begin)
    return F.when(start == 0, tex).otherwise(F.substring(tex, first, F.greatest(stop - first, F.lit(0))))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def cache_key(*parts: Column | str) -> Column:
    """SHA-1 of the parts joined by a bar. A null part counts as empty, so that a key never depends on the columns beside it."""
    cols = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.concat_ws("|", *cols))


def clip01(value: Column) -> Column:
    """Number in [0, 1] from a string or number; what is no number, and NaN, gives 0.0."""
    v = F.expr("1").cast("double") if value is None else value.try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))


def text_flag(value: Column) -> Column:
    """0, 1 or null from a judge's word."""
    v = F.lower(strip(value))
    return F.when(v.isin("1", "true", "yes", "relevant"), 1).when(v.isin("0", "false", "no", "irrelevant"), 0)


#: From LaTeX to text, in order: comments, what shows nothing, marks that stand for signs, commands by their arguments from the inside out, the rest.
TEX_STEPS = (
    (r"(^|[^\\])%[^\n]*", "$1"),
    (r"\\(?:cite[a-z]*|label|ref|eqref|includegraphics|bibliography(?:style)?|usepackage|documentclass|vspace|hspace|input)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}", " "),
    (r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]]*\])?", "\n"),
    (r"\\(?:par|item|newline|linebreak)\b|\\\\", "\n"),
    *((r"\\[A-Za-z]+\*?(?:\[[^\[\]]*\])?\{([^{}]*)\}", "$1"),) * 3,
    (r"\\([%&_#$])", "$1"),
    (r"\\[A-Za-z]+\*?|\\[,;:!]", " "),
    (r"[{}$]", ""),
    ("~", " "),
    (r"[ \t]+", " "),
    (r" ?\n[ \n]*", "\n"),
)


def plain_tex(tex: Column) -> Column:
    """Text of a LaTeX source without an external converter: arguments up to three commands deep stay, layout and references go. Null stays null."""
    for pattern, to in TEX_STEPS:
        tex = F.regexp_replace(tex, pattern, to)
    return strip(tex)


#: From an HTML page to text, in order: what is no text, breaks, other tags, named signs; blanks come last.
PAGE_STEPS = (
    (r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " "),
    (r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/table|/ul|/ol)\b[^<>]*>", "\n"),
    (r"</?[A-Za-z][^<>]*>", ""),
    ("&nbsp;|&#160;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    (r"[ \t]+", " "),
    (r" ?\n[ \n]*", "\n"),
)


def page_text(page: Column) -> Column:
    """Text of an HTML page, one line per block; null stays null, a page without tags keeps its words."""
    for pattern, to in PAGE_STEPS:
        page = F.regexp_replace(page, pattern, to)
    return strip(page)
