r"""Markup residue: finding it, and turning it into clean text that still shows headings, lists, code and formulas.

A text becomes a tree of its elements, and every residue, of whatever markup, is a mark on the node where it stands; a text has residue if its tree
has marks. Paragraphs pass points for their length and commas to their parent and half as many to the grandparent; a container's points are
discounted by its share of link text, of HTML, Markdown and wiki links alike; the best container is kept with those of its siblings that come near
it, the rest is page furniture. Running text outside any element counts for the root, so a chunk with inline tags keeps all its sentences. What
Markdown, wiki and LaTeX mean inside of a node is rewritten by rules. Building, scoring and writing a tree take one walk each, of any depth.

In the clean text a heading is a line that starts with '§ ', a list item one that starts with '• ', a line of code one with four blanks, a table
row has its cells joined by a tab, and a formula stands between '⟨' and '⟩'.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm import prose
from chalkline.llm.store import sliced

ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});")
ATTRIBUTE = r"(?:href|src|alt|class|id|name|title|style|width|height|align|border|colspan|rel)"
#: What counts as residue, by kind. Each pattern also fits when the edge of a window has cut the construct. It is tried only in
#: texts that have one of the fixed parts beside it, which every match holds.
RESIDUE = (
    ("html", ("<",), r"</?[A-Za-z][A-Za-z0-9]*(?=[\s/>]|$)|<!--"),
    ("html", ("-->", "/>"), r"-->|/>"),
    ("html", ("=",), rf"(?<![\w$]){ATTRIBUTE}=(?:[\"']|\w)|=\"[^\"]*\">"),
    ("entity", ("&",), ENTITY.pattern),
    ("markdown", ("](", "][", "]:", "[^", "!["), r"\]\(|\]\[|\]:\s|\[\^|!\["),
    ("markdown", ("*",), r"\*\*|(?<![\w*])\*(?=[A-Za-z0-9])"),
    ("markdown", ("~~", "`"), r"~~|`"),
    ("markdown", ("__",), r"(?<![A-Za-z0-9])__(?=[A-Za-z0-9])|(?<=[A-Za-z0-9.,])__(?![A-Za-z0-9_])"),
    ("markdown", ("#",), r"(?:^|(?<=\s))#{1,6}(?=\s+\S)"),
    ("markdown", ("|",), r"\|(?:\s*:?-{2,}:?\s*\|)+|(?m:^[ \t]*\|.*\|[ \t]*$)"),
    ("wiki", ("[[", "]]", "{{", "}}", "{|", "|}", "''", "||"), r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}|''|\|\|"),
    ("wiki", ("|",), r"(?:^|(?<=\s))\|-(?=\s|$)|\|[a-z]+=|\|(?:thumb|left|right|frame)\|"),
    ("wiki", ("==",), r"(?:^|(?<=\s))={2,6}(?=\s|$)"),
    ("wiki", ("[http", "[ftp"), r"\[(?:https?|ftp)://"),
    ("latex", ("\\",), r"\\(?:[A-Za-z]+|[%,&_#$\;:!{}\[\]()])|\{\\|[A-Za-z.]~\\"),
    ("latex", ("$",), r"\$(?=[A-Za-z\\^_{$])|(?<=[A-Za-z}])\$(?!\d)"),
    ("latex", ("&",), r"\s&\s+-?\d|\d\s+&\s"),
    ("latex", ("}",), r"(?<![\w{])[A-Za-z][a-z]+[.,]?\}|(?<![\w.])-?\d+(?:\.\d+)?\}"),
    ("latex", ("~",), r"[A-Za-z.]~[A-Za-z]"),
)
KINDS = ("html", "entity", "markdown", "wiki", "latex")
TRIED = tuple((kind, fixed, re.compile(pattern)) for kind, fixed, pattern in RESIDUE)
#: What any residue holds; most texts are passed after this one scan.
HINT = re.compile(r"<[A-Za-z/!]|&[#A-Za-z\s]|\][(\[:\]]|\[[\[^hf]|!\[|\*|~[~A-Za-z\\]|__|`|#+\s|\||''|=[\"'=\w]|\\|\$(?:\D|$)|\}|-->|/>")


#: The word before a star, at its end.
STARRED = re.compile(r"(?<![\w-])([a-z]+)[.,]?$")


def _closing_star(text: str) -> int:
    """Place of a star that ends an emphasis opened before the window: the first of the text, behind a function word, which no significance is marked
    on; -1 if there is none."""
    i = text.find("*")
    if i < 1 or text[i + 1 : i + 2].isalnum():
        return -1
    m = STARRED.search(text, max(0, i - 40), i)
    return i if m and m[1] in prose.SETS[prose.FUNC] else -1


def marks(text: str | None) -> list[tuple[int, str]]:
    """Place and kind of every residue, in order of place."""
    if not text or not HINT.search(text):
        return []
    found = [(m.start(), kind) for kind, fixed, pattern in TRIED if any(x in text for x in fixed) for m in pattern.finditer(text)]
    if (i := _closing_star(text)) >= 0:
        found.append((i, "markdown"))
    return sorted(found)


def residues(text: str | None) -> dict[str, int]:
    """Number of residues of each kind."""
    out = dict.fromkeys(KINDS, 0)
    for _, kind in marks(text):
        out[kind] += 1
    return out


# --- the tree ------------------------------------------------------------------------------------------------------------------------

TAG = re.compile(r"<!--(?:[^-]|-(?!->))*(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*)?)(/?)(?:>|$)")
#: The last of a tag whose beginning the window's edge has cut: attributes up to the bracket.
CUT_TAG = re.compile(rf"(?<![\w$]){ATTRIBUTE}=(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+)(?:\s+[\w-]+=(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))*\s*/?$")
CUT_VALUE = re.compile(r"^[^\"'<>]*[\"']\s*/?$|--$|^\s*/$")
BLOCKS = {"p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "li", "table", "tr", "td", "th", "pre", "blockquote", "figure", "body", "html", "dl", "dt", "dd", *(f"h{i}" for i in range(1, 7))}
#: Blocks that are paragraphs of their container, and what each one ends when it begins.
PARAGRAPHS = {"p", "td", "pre", "blockquote", "li", "dd"}
ENDS = {"p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p")} | {h: ("p",) for h in ("div", "ul", "ol", "table", "section", "h1", "h2", "h3", "h4", "pre")}
#: Where such an end is not looked for any further.
HOLDERS = {"ul", "ol", "table", "dl", "div", "section", "article", "main", "aside", "nav", "body", "blockquote", "root"}
VOID = {"br", "hr", "img", "input", "meta", "link"}
DROPPED = {"script", "style", "ref", "gallery", "noscript"}
ALT = re.compile(r"alt=[\"']([^\"']*)")
#: Characters that no text has, round what is put into its form at the end: headings and code.
HEAD, HEAD_END, CODE, CODE_END = "\ufdd0\ufdd1\ufdd2\ufdd3"


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None" = None
    parts: list = field(default_factory=list)  # text or Node
    closed: bool = False
    marks: int = 0
    points: float = 0.0
    size: int = 0
    commas: int = 0
    linked: int = 0


def parse(text: str, found: list[tuple[int, str]] = ()) -> list[Node]:
    """The nodes of a tolerant tree, the root first, each before those inside of it. A closing tag closes the nearest open element of its name, if
    there is one; paragraphs, items, rows and cells end where the next one begins; what stays open ends with the text. Marks go to the node that
    is open at their place."""
    root = node = Node("root")
    nodes, opened = [root], Counter()
    at = mark = 0
    first, left = text.find("<"), text.find(">")
    if left >= 0 and (first < 0 or left < first):
        cut = CUT_TAG.search(text, 0, left)
        if cut or CUT_VALUE.search(text, 0, left):
            at = left + 1
            if cut and cut.start() > 60 and "\"" not in text[: cut.start()]:
                root.parts.append(text[: cut.start()])

    def noted(end: int) -> None:
        nonlocal mark
        while mark < len(found) and found[mark][0] < end:
            node.marks += 1
            mark += 1

    def up_to(end: Node) -> None:
        """Closes the open nodes up to this one."""
        nonlocal node
        while True:
            opened[node.tag] -= 1
            last, node = node, node.parent
            if last is end:
                return

    for m in TAG.finditer(text, at):
        if m.start() > at:
            node.parts.append(text[at : m.start()])
        noted(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if name in VOID:
            alt = ALT.search(m[3] or "")
            node.parts.append("\n" if name in ("br", "hr") else alt[1] if alt else "")
        elif name and m[1]:
            if opened[name]:
                up = node
                while up.tag != name:
                    up = up.parent
                up.closed = True
                up_to(up)
            elif name in BLOCKS:
                node.parts.append("\n\n")
        elif name:
            ends = ENDS.get(name, ())
            while any(opened[t] for t in ends):
                up = node
                while up.tag not in ends and up.tag not in HOLDERS:
                    up = up.parent
                if up.tag not in ends:
                    break
                up_to(up)
            child = Node(name, node)
            nodes.append(child)
            node.parts.append(child)
            if not m[4] and not (m[3] or "").endswith("/"):
                node, opened[name] = child, opened[name] + 1
        noted(m.end())
    node.parts.append(text[at:])
    noted(len(text) + 1)
    return nodes


def walked(root: Node) -> Iterator[tuple[str | Node, bool]]:
    """Texts, and nodes as they begin (True) and end (False), in the order of the text."""
    stack: list[tuple[str | Node, bool]] = [(root, True)]
    while stack:
        part, begins = stack.pop()
        yield part, begins
        if begins and isinstance(part, Node):
            stack.append((part, False))
            stack.extend((p, True) for p in reversed(part.parts))


def score(root: Node) -> Node:
    """The best container. Sets size, commas, linked characters and points of every node."""
    blocks, links, boxes = [root], 0, [root]
    run = [0, 0]  # characters and commas of the running text of the open block

    def passes(box: Node, above: Node | None, size: int, commas: int) -> None:
        if size >= 25:
            points = 1 + commas + min(size / 100, 3)
            box.points += points
            if above is not None:
                above.points += points / 2

    def flush() -> None:
        passes(blocks[-1], blocks[-2] if len(blocks) > 1 else None, *run)
        run[:] = 0, 0

    holder = root  # the innermost open node
    for part, begins in walked(root):
        if isinstance(part, str):
            size, commas = len(part.strip()), part.count(",")
            run[0], run[1] = run[0] + size, run[1] + commas
            holder.size, holder.commas, holder.linked = holder.size + size, holder.commas + commas, holder.linked + size * (links > 0)
        elif begins:
            holder, links = part, links + (part.tag == "a")
            if part.tag in BLOCKS:
                flush()
                blocks.append(part)
                if part.tag not in PARAGRAPHS:
                    boxes.append(part)
        else:
            links -= part.tag == "a"
            if part.tag in BLOCKS:
                flush()
                blocks.pop()
                if part.tag in PARAGRAPHS:
                    passes(blocks[-1], blocks[-2] if len(blocks) > 1 else None, part.size, part.commas)
            if part.parent is not None:
                holder = up = part.parent
                up.size, up.commas, up.linked = up.size + part.size, up.commas + part.commas, up.linked + part.linked
            else:
                flush()
    for b in boxes:
        b.points *= 1 - b.linked / max(1, b.size)
    return max(boxes, key=lambda b: b.points)


def _furniture(p: Node) -> bool:
    return p.tag in ("nav", "footer", "aside") or (p.tag in BLOCKS and p.size > 0 and p.linked / p.size > 0.6 and p.commas < 2)


BEFORE = {"li": "\n• ", "dt": "\n• ", "dd": "\n• ", "pre": "\n\n" + CODE, "tr": "\n", "td": "", "th": ""} | {f"h{i}": "\n\n" + HEAD for i in range(1, 7)}
AFTER = {"li": "\n", "dt": "\n", "dd": "\n", "pre": CODE_END + "\n\n", "tr": "\n", "td": "\t", "th": "\t"} | {f"h{i}": HEAD_END + "\n\n" for i in range(1, 7)}


def render(parts: list) -> str:
    out: list[str] = []
    top = Node("root", None, parts)
    skip: Node | None = None
    for p, begins in walked(top):
        if isinstance(p, str):
            if skip is None:
                out.append(p)
        elif p.tag in DROPPED and p.closed and p is not top:  # one that was cut may hold the rest of the text
            skip = p if begins and skip is None else None if p is skip else skip
        elif skip is None and p is not top:
            if p.tag == "sub" and begins and len(p.parts) == 1 and isinstance(p.parts[0], str) and re.fullmatch(r"\w{1,3}", p.parts[0]):
                out.append("_")
            elif p.tag in BLOCKS:
                out.append((BEFORE if begins else AFTER).get(p.tag, "\n\n"))
    text = re.sub(r"\n{3,}", "\n\n", "".join(out))
    text = re.sub(f"{HEAD}([^{HEAD}{HEAD_END}]*){HEAD_END}", lambda m: f"§ {' '.join(m[1].split())}", text)
    text = re.sub(f"{CODE}([^{CODE}{CODE_END}]*){CODE_END}", lambda m: "\n".join("    " + x for x in m[1].strip("\n").split("\n")), text)
    text = re.sub(r"(?m)^• \s+|^•\s*$", lambda m: "• " if m[0].strip() and m[0] != "•" else "", text)
    return re.sub(f"[{HEAD}{HEAD_END}{CODE}{CODE_END}]", "", text)


def from_tree(root: Node) -> str:
    best = score(root)
    if best is root:
        return render([p for p in root.parts if isinstance(p, str) or p.tag not in BLOCKS or not _furniture(p)])
    return render([p for p in best.parent.parts if isinstance(p, str) or p is best or p.tag not in BLOCKS or p.points >= max(10, 0.2 * best.points) or (not _furniture(p) and p.size > 80)])


# --- Markdown, wiki, LaTeX -----------------------------------------------------------------------------------------------------------

#: LaTeX names of letters and signs.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ",
    "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Delta": "Δ", "Gamma": "Γ", "Lambda": "Λ", "Omega": "Ω", "Phi": "Φ", "Psi": "Ψ", "Sigma": "Σ", "Theta": "Θ",
    "partial": "∂", "nabla": "∇", "pm": "±", "times": "×", "cdot": "·", "circ": "°", "approx": "≈", "leq": "≤", "geq": "≥", "neq": "≠", "infty": "∞", "sum": "∑", "int": "∫", "rightarrow": "→", "sim": "~",
    "degree": "°", "ldots": "…", "dots": "…", "prime": "′",
}


def formula(src: str) -> str:
    """A formula's source with signs for names and without layout commands."""
    n = 1
    while n:  # inner fractions first
        src, n = re.subn(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", src)
    src = re.sub(r"\\([A-Za-z]+)", lambda m: SIGNS.get(m[1], "" if m[1] in ("left", "right", "quad", "label", "nonumber", "displaystyle", "mathrm", "text", "mathbf", "rm") else m[1]), src)
    src = re.sub(r"\\[,;:! ]", " ", src)
    src = re.sub(r"([_^])\{([^{}]*)\}", r"\1\2", src).replace("^°", "°")
    return " ".join(re.sub(r"[{}$\\]|&", " ", src).split())


def _code(src: str) -> str:
    return "\n\n" + "\n".join("    " + x for x in src.strip("\n ").split("\n")) + "\n\n"


def _cells(row: str, sep: str) -> str:
    return "\t".join(c.strip() for c in row.split(sep))


RULES: list[tuple[re.Pattern, object]] = [
    # blocks whose inside is kept
    (re.compile(r"```[a-z]*\s?(.*?)(?:```|$)", re.S), lambda m: _code(m[1])),
    (re.compile(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)(?:\\end\{(?:verbatim|lstlisting)\}|$)", re.S), lambda m: _code(m[1])),
    (re.compile(r"\\begin\{(?:equation|align|eqnarray|displaymath)\*?\}(.*?)(?:\\end\{(?:equation|align|eqnarray|displaymath)\*?\}|$)", re.S), lambda m: f"\n\n⟨{formula(m[1])}⟩\n\n"),
    (re.compile(r"\$\$(.+?)(?:\$\$|$)|\\\[(.+?)(?:\\\]|$)", re.S), lambda m: f"\n\n⟨{formula(m[1] or m[2])}⟩\n\n"),
    (re.compile(r"\$([A-Za-z\\^_{][^$\n]*)\$(?!\d)"), lambda m: formula(m[1]) if len(m[1]) < 14 and "\\frac" not in m[1] else f"⟨{formula(m[1])}⟩"),
    (re.compile(r"\\begin\{tabular\}\{[^}]*\}(.*?)(?:\\end\{tabular\}|$)", re.S), lambda m: "\n\n" + "\n".join(_cells(r, "&") for r in re.split(r"\\\\(?:\s*\\hline)?", m[1]) if r.strip()) + "\n\n"),
    # LaTeX
    (re.compile(r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{([^{}]*)\}"), r"\n\n§ \1\n\n"),
    (re.compile(r"\\item(?:\[[^\]]*\])?\s*"), "\n• "),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), "\n"),
    (re.compile(r"[~ ]?\\(?:cite[tp]?|label|footnote|vspace|hspace|includegraphics|bibitem)\*?(?:\[[^\]]*\])?\{[^{}]*\}?"), ""),
    (re.compile(r"~?\\(?:ref|eqref|pageref)\{([^{}:]*:)?([^{}]*)\}"), r" \2"),
    (re.compile(r"\\(?:href|url)\{[^{}]*\}"), ""),
    (re.compile(r"\\[a-zA-Z]+\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\{\\[a-z]+\s+([^{}]*)\}"), r"\1"),
    (re.compile(r"\\([%&_#${}])"), r"\1"),
    (re.compile(r"\\[,;:! ]"), " "),
    (re.compile(r"\\\\"), "\n"),
    (re.compile(r"\$?\^?\\([A-Za-z]+)\b\$?\s?"), lambda m: SIGNS.get(m[1], "")),
    (re.compile(r"``|''(?=[\s.,;:)]|$)(?<!'''')"), '"'),
    # wiki
    (re.compile(r"\{\{convert\|([^|{}]*)\|([^|{}]*)[^{}]*(?:\}\}|$)"), r"\1 \2"),
    (re.compile(r"\{\{[^{}]*(?:\}\}|$)"), ""),
    (re.compile(r"\[\[(?:File|Image):[^\[\]|]*(?:\|(?:thumb|left|right|frame|\d+px))*\|?([^\[\]|]*)(?:\]\]|$)"), r"\1"),
    (re.compile(r"\[\[[^\[\]|]*\|([^\[\]]*)(?:\]\]|$)"), r"\1"),
    (re.compile(r"\[\[([^\[\]]*)(?:\]\]|$)"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://\S+(?:\s+([^\[\]]*)(?:\]|$)|$)"), lambda m: m[1] or ""),
    (re.compile(r"(?:^|(?<=\s))={2,6}\s+([^\n=]+?)\s+={2,6}(?=\s|$)"), r"\n\n§ \1\n\n"),
    (re.compile(r"(?:^|(?<=\s))={2,6}(?=\s|$)"), ""),
    (re.compile(r"\{\|[^\n|]*"), "\n"),
    (re.compile(r"\|\}"), "\n"),
    (re.compile(r"(?:^|(?<=\s))\|-(?=\s|$)"), "\n"),
    (re.compile(r"(?<! )[ ]*\|\|[ ]*"), "\t"),
    (re.compile(r"'{2,5}"), ""),
    # Markdown
    (re.compile(r"!\[([^\[\]]*)\](?:\([^()]*\)?|\[[^\[\]]*\]?)"), r"\1"),
    (re.compile(r"\[\^\w+\]:[^\n]*|\[\^\w+\]?"), ""),
    (re.compile(r"\[([^\[\]]*)\](?:\([^()\s]*\)?|\[[^\[\]]*\]?)"), r"\1"),
    (re.compile(r"(?m)^[^\S\n]*\[[^\[\]\n]+\]:[^\S\n]+\S+.*$"), ""),
    (re.compile(r"\]\((?:https?://|[\w.-]+\.(?:png|jpg|svg))[^()\s]*\)?"), ""),
    (re.compile(r"(?:^|(?<=\n)|(?<=\s))#{1,6}\s+([^\n]{1,100})(?=\n|$)"), r"\n\n§ \1\n\n"),
    (re.compile(r"(?:^|(?<=\s))#{1,6}(?=\s+\S)"), "\n\n§"),
    (re.compile(r"\|(?:\s*:?-{2,}:?\s*\|)+"), "\n"),
    (re.compile(r"(?m)^[^\S\n]*\|(.*?)\|?[^\S\n]*$"), lambda m: _cells(m[1], "|")),
    (re.compile(r"(?<=[\w.])[ ]+&[ ]+(?=-?\d)"), "\t"),
    (re.compile(r"\*\*|~~|`"), ""),
    (re.compile(r"(?<![A-Za-z0-9])__(?=[A-Za-z0-9])|(?<=[A-Za-z0-9.,])__(?![A-Za-z0-9_])"), ""),
    (re.compile(r"(?<![\w*])\*(?=[A-Za-z0-9])([^*\n]*?)\*(?!\w)"), r"\1"),
    (re.compile(r"(?<![\w*])\*(?=[A-Za-z0-9])"), ""),
    # what an edge has cut
    (re.compile(r"\]\]|\}\}|!\[|\[\[|\[(?:https?|ftp)://\S*"), ""),
    (re.compile(r"\]\[\w*\]?|\]\(\S*"), ""),
    (re.compile(r"(?<![\w{])([A-Za-z][a-z]+[.,]?|-?\d+(?:\.\d+)?)\}"), r"\1"),
    (re.compile(r"\{\\[a-z]*\s?|\\"), ""),
    (re.compile(r"\$(?=[A-Za-z^_{$])|(?<=[A-Za-z}])\$(?!\d)"), ""),
    (re.compile(r"(?<=[A-Za-z.])~(?=[A-Za-z])"), " "),
    (re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*)$|^[^\s<>]*(?<![-=])>(?=[A-Za-z])"), ""),
    (re.compile(r"(?<![\w$])(?:href|src|alt|class|id|name|title|style)=(?:\"[^\"]*\"?|'[^']*'?|\S+)\s*/?>?"), ""),
    (re.compile(r"-->|/>"), ""),
]
SPACES = ((re.compile(r"(?<![ \t])[ \t]*\n[ \t]*(?=\n)"), "\n"), (re.compile(r"\n{3,}"), "\n\n"), (re.compile(r"(?<=\S)  +(?=\S)"), " "), (re.compile(r"(?m)(?<! )[ ]+$"), ""))


#: Links of Markdown and wiki as elements, so that the tree weighs them like those of HTML.
LINKS = (
    (re.compile(r"(?<!!)\[([^\[\]\n]*)\]\([^()\s]*\)"), r"<a>\1</a>"),
    (re.compile(r"\[\[(?!(?:File|Image):)(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"<a>\1</a>"),
    (re.compile(r"\[(?:https?|ftp)://\S+\s+([^\[\]]*)\]"), r"<a>\1</a>"),
)


def once(text: str) -> str:
    """Signs for entities, the tree's best part, then the rules."""
    text = ENTITY.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), text)
    if "[" in text:
        for pattern, to in LINKS:
            text = pattern.sub(to, text)
    if "<" in text or ">" in text:
        text = from_tree(parse(text)[0])
    if (i := _closing_star(text)) >= 0:
        text = text[:i] + text[i + 1 :]
    for pattern, to in RULES:
        text = pattern.sub(to, text)
    return text


#: Rounds without a smaller number of residues after which the rest is reported as left.
IDLE = 3


def resolved(text: str, n: int) -> tuple[str, int]:
    """(clean text, residues left) of a text with n residues. Escaped markup shows only after a round, so there are rounds as long as they change the
    text and bring fewer residues than any before, or not for IDLE rounds."""
    least, idle = n, 0
    while n and idle < IDLE:
        before, text = text, once(text)
        if text == before:
            break
        n = len(marks(text))
        idle = 0 if n < least else idle + 1
        least = min(least, n)
    for pattern, to in SPACES:
        text = pattern.sub(to, text)
    return text.strip("\n"), n


def clean(text: str) -> str:
    return resolved(text, len(marks(text)))[0]


def judged(text: str | None) -> tuple[int, list[str], int, float]:
    """(marks on the tree, their kinds, elements, share of the characters in the best container and the siblings kept with it)."""
    found = marks(text)
    if not found:
        return 0, [], 0, 1.0
    nodes = parse(text, found)
    best = score(nodes[0])
    kept = nodes[0].size if best is nodes[0] else best.parent.size
    return sum(n.marks for n in nodes), [k for k in KINDS if any(k == x for _, x in found)], len(nodes) - 1, round(kept / max(1, nodes[0].size), 6)


def marked(rows: DataFrame, key: str = "chunk_ord", text: str = "text") -> DataFrame:
    """key, n_residues, kinds, elements, kept_share: the marks on each text's tree and what its scores keep, one row per row. A null, empty or plain
    text has none. One Arrow pass, no shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    names, types = ["n_residues", "kinds", "elements", "kept_share"], [pa.int32(), pa.list_(pa.string()), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = list(zip(*map(judged, b.column(1).to_pylist()))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(o), t) for o, t in zip(got, types)]], [key, *names])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_residues int, kinds array<string>, elements int, kept_share double")


def cleaned(rows: DataFrame, key: str = "chunk_ord", text: str = "text") -> DataFrame:
    """key, clean_text, n_residues, kinds, n_left, headings, items, code_lines, formulas, one row per row.

    A text without residue comes out unchanged, a null text as null with no residue. n_left counts what the rules could not resolve. Texts of any
    length are read whole; repeated rows come out each. Narrow: one Arrow pass, no shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["clean_text", "n_residues", "kinds", "n_left", "headings", "items", "code_lines", "formulas"]
    schema = f"`{key}` {kind}, clean_text string, n_residues int, kinds array<string>, n_left int, headings int, items int, code_lines int, formulas int"
    head, item, code = re.compile(r"(?m)^§ "), re.compile(r"(?m)^• "), re.compile(r"(?m)^ {4}\S")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list] = [[] for _ in names]
            for t in b.column(1).to_pylist():
                found = marks(t)
                n = len(found)
                c, left = resolved(t, n) if n else (t, 0)
                for o, v in zip(out, (c, n, [k for k in KINDS if any(k == x for _, x in found)], left, *((len(p.findall(c)) for p in (head, item, code)) if n else (0, 0, 0)), c.count("⟨") if n else 0)):
                    o.append(v)
            types = [pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, t) for o, t in zip(out, types)]], [key, *names])

    return rows.select(key, text).mapInArrow(run, schema)
