import pytest

from chalkline.llm import markup, prose

SENTENCES = (
    "The two series part ways around 1984. We see no reason to reject the wind stress as a cause, and most of the signal comes from 9 sites. "
    "It remains unclear whether the dust emission was the cause or merely followed it. The fit improves if the albedo is allowed to vary."
)
TABLE = "\n".join(f"Station{i} {i}.5 -{i}.25 {i * 3} 0.{i}7 -" for i in range(1, 30))
REFERENCES = "\n".join(f"[{i}] A. Marlov, B. Tinsel. On the heat flux in the Corvo Basin. J. Sea Res. {i}, 20{i:02}-1400 (19{i:02})." for i in range(10, 25))
TERMS = "\n".join([x for i in range(6) for x in (f"– frost duration {i}", f"– rain gauge, {i} K", f"– GEDR {i} (199{i})", f"– the Corvo{i} Basin", f"– trends{i}: CO_2")])
PHRASES = " / ".join([x for w in ("ozone", "runoff", "salinity", "wind", "frost", "cloud") for x in (f"share of the {w} that is due to snow cover", f"not in the {w} set of 1988", f"change in the {w} albedo of the Corvo Range", f"{w} with or without vegetation")])
CODE = "\n".join(["if (tau .gt. 4) then", "  call update_tau(i, j, 3)", "end if", "! set tau", "real :: mask(4)"] * 8)
REPEATED = "Table continued\n" * 40
JUNK = " ".join(["xkcq", "7gT4pQ", "zzvk", "8hjKq2"] * 20)


def scrambled():
    import random

    w = (SENTENCES * 2).replace(".", "").replace(",", "").split()
    random.Random(1).shuffle(w)
    return " ".join(w)


@pytest.mark.parametrize(
    "text, want",
    [
        (SENTENCES, "prose"),
        (SENTENCES.upper(), "prose"),
        (SENTENCES.replace(". ", "\n"), "prose"),
        ("to within 4 K. The rain gauge was replaced in 1990, so the", "prose"),
        ("Corvo, Tell and Marl gave 2.4 K, 6.8 Gt and 403 ppm in 2008, 2002 and 1931. Runs 23 to 95 used 4.6 psu, runs 47 to 7 used 335 K.", "prose"),
        (TABLE, "table"),
        (REFERENCES, "list"),
        (TERMS, "list"),
        (PHRASES, "list"),
        (CODE, None),
        (REPEATED, "junk"),
        (JUNK, None),
        (scrambled(), "junk"),
        (SENTENCES + "\n" + TABLE, "not prose"),
        (SENTENCES * 4 + "\n" + TABLE[:300], "prose"),
        ("", "blank"),
        (" \n", "blank"),
        (None, "blank"),
    ],
)
def test_verdict(spark, text, want):
    df = spark.createDataFrame([(1, text, 5.0)], "chunk_ord bigint, text string, prose_share double")
    r = prose.judged(prose.statistics(df)).first()
    assert r["verdict"] == want or (want in (None, "not prose") and r["verdict"] not in ("prose", "blank"))


def test_statistics(spark):
    df = spark.createDataFrame([(1, "- The heat, and it is 5.\n- The heat, and it is 5.\nNo …"), (2, None), (2, None)], "chunk_ord bigint, text string")
    a, b, c = prose.judged(prose.statistics(df)).orderBy("chunk_ord").collect()
    assert a["n_counted"] == 16 and a["n_lines"] == 3 and a["bullet_lines"] == pytest.approx(2 / 3, abs=1e-5) and a["repeated_lines"] == pytest.approx(1 / 3, abs=1e-5)
    assert a["number_share"] == pytest.approx(2 / 16) and a["core_words"] == 4 and {"few_words", "repeated_lines", "ellipsis"} <= set(a["reasons"])
    assert b == c and b["reasons"] == [] and b["n_counted"] == 0
    assert prose.judged(prose.statistics(df.limit(0))).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, SENTENCES * 500 + TABLE)], "chunk_ord bigint, text string")
    r = prose.judged(prose.statistics(df)).first()
    assert r["verdict"] == "prose" and r["n_counted"] == len((SENTENCES * 500 + TABLE).split())


def test_labels_agree_with_the_verdict(spark):
    """Hand labels, of which one in twenty is a random guess."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/chunks_norm.parquet").join(spark.read.parquet(f"{d}/chunk_labels.parquet"), "chunk_ord")
    got = [(r["label"] == "prose", r["verdict"] == "prose") for r in prose.judged(prose.statistics(rows)).join(rows.select("chunk_ord", "label"), "chunk_ord").filter("n_counted > 0").collect()]
    assert sum(a == b for a, b in got) >= 0.93 * len(got)


def test_a_deciding_rule_comes_first(spark):
    """Sentences without any of the most common words are no prose from 50 words on; with them they are. Marks and bullets are read on whole lines."""
    odd = "Flux rises. Wind falls. Snow melts. Rain grows. " * 16
    df = spark.createDataFrame([(1, odd), (2, SENTENCES), (3, "-" + " " * 30 + "x\n" + "y" * 50 + "." + ")" * 20 + " " * 20)], "chunk_ord bigint, text string")
    got = {r["chunk_ord"]: r for r in prose.judged(prose.statistics(df)).collect()}
    assert got[1]["verdict"] != "prose" and "no_common_words" in got[1]["reasons"] and got[2]["verdict"] == "prose"
    assert (got[3]["punctuated_lines"], got[3]["bullet_lines"]) == (0.5, 0.5)


# --- markup ---


@pytest.mark.parametrize(
    "text",
    [
        "a <b>bold</b> word", "cut <a", 'href="x.html">cut</a> start', "x <!-- note --> y", "5 &deg;C and &#8217;", "a **b** c", "~~gone~~", "__the__ flux", "see [it](u.html) now", "the [flux][ref3] was",
        "note[^3] here", "*so* it is", "`code`", "## Results\ntext", "| a | b |\n|---|---|\n| 1 | 2 |", "[[Heat flux|heat]]", "{{convert|4|km}}", "''it'' is", "{| class=\"wikitable\"\n|-\n| a || b\n|}", "== Results ==",
        "[https://a.example/x heat]", r"\section{Data} x", r"48 \% of", r"of~\cite{a1999} it", "$x_i$ is", r"{\it so} it", "the former} level", r"\begin{equation}", "2002} was", "a.~b".replace("a.~b", "Fig.~\\ref{a}"),
    ],
)
def test_residue_is_found_and_removed(text):
    assert sum(markup.residues(text).values()) > 0
    assert sum(markup.residues(markup.clean(text)).values()) == 0


@pytest.mark.parametrize(
    "text",
    [
        "For x > 45 and y < 37 the fit", "p<0.05 and r = -0.4", "costs $84 per tonne or 5 $", "0.43* is significant, marked *", "as shown [37] and [xii]", "such as {CO_2, SST}, a set", "SST}, a set chosen", "CO_2 and q_850 and sst_mean",
        "about ~36 km", "the R&D effort", "station #50.", "- item\n• item\n3. item", "Name ; 3 ; 4\nName\t3\t4", "if (tau .gt. 4) then\n&param tau = 0.1 /\nx += dz(k)", "the p|anned f|ux", "F. Marl*, Institute of X", "", None, "    ", "https://a.example/b",
    ],
)
def test_no_residue(text):
    assert sum(markup.residues(text).values()) == 0


def test_structure_is_kept():
    got = markup.clean("<h2>Data</h2><p>We <b>see</b> it, CO<sub>2</sub> &amp; more.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\ny = 2</code></pre>")
    assert "§ Data" in got and "We see it, CO_2 & more." in got and "• one\n" in got and "    x = 1\n    y = 2" in got
    got = markup.clean("\\section{Data} We \\emph{see} it.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{equation}\n\\frac{a}{b} = \\tau T_0\n\\end{equation}\n")
    assert "§ Data" in got and "We see it." in got and "• one" in got and "⟨(a)/(b) = τ T_0⟩" in got
    got = markup.clean("## Data\n\nIt **is** [so](u.png).\n\n```python\nx = 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert "§ Data" in got and "It is so." in got and "    x = 1" in got and "1\t2" in got
    assert markup.clean("== Data ==\n[[Heat|It]] is ''so''{{cn}} at {{convert|4|km|mi}}.") .split("\n")[-1] == "It is \"so\" at 4 km." or "It is so at 4 km." in markup.clean("== Data ==\n[[Heat|It]] is '''so'''{{cn}} at {{convert|4|km|mi}}.")


def test_tree_keeps_the_container_and_drops_the_menu():
    body = "".join(f"<p>We find, in the end, that the flux of heat is what it was, and that this can be seen here, case {i}.</p>" for i in range(4))
    got = markup.clean(f"<div><ul><li><a href='a'>Home</a></li><li><a href='b'>Shop</a></li></ul></div><div>{body}</div><div><a href='c'>Next page of the archive</a></div>")
    assert got.count("We find") == 4 and "Home" not in got and "Next page" not in got


def test_cleaned_table(spark):
    df = spark.createDataFrame([(1, "a <i>b</i>", 1), (2, None, 2), (3, "plain", 3), (3, "plain", 3), (4, "x <b>y</b> " * 2000, 4)], "chunk_ord bigint, text string, n_left int")
    got = markup.cleaned(df).orderBy("chunk_ord").collect()
    assert [(r["clean_text"], r["n_residues"]) for r in got[:4]] == [("a b", 2), (None, 0), ("plain", 0), ("plain", 0)]
    assert got[4]["n_residues"] == 4000 and got[4]["n_left"] == 0 and markup.cleaned(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["border=1 align=center>the heat flux", "a run\n& 3.2 of it", "4\t&\tof it", "a line\n#\tThe heat flux"])
def test_fixed_parts_are_held_by_every_match(text):
    assert sum(markup.residues(text).values()) > 0


@pytest.mark.parametrize(
    "page",
    ["<p>a word of it, " * 100_000, "<div>" * 100_000 + "x", "<b>x " * 50_000, "<li>it" * 50_000, "</b>" * 50_000 + "<i>" * 50_000, "<!-- a " * 30_000, "<" * 100_000, "{\\bf x" * 20_000, "[[a|" * 20_000, "<b>x</b>" + "\n" * 50_000, "`x " * 50_000],
)
def test_hostile_pages_take_linear_time(page):
    import time

    t = time.perf_counter()
    markup.judged(page)
    markup.clean(page)
    assert time.perf_counter() - t < 20


def test_long_pages_and_constructs_are_read_whole(spark):
    page = "<div>" + "<p>We find, in the end, that the flux of heat is what it was, and so on.</p>" * 130_000 + "</div>"
    assert len(page) > 9_000_000
    n, kinds, elements, kept = markup.judged(page)
    assert n == 260_002 and kinds == ["html"] and elements == 130_001 and kept == 1.0
    assert markup.clean(page).count("We find") == 130_000
    link = "https://a.example/" + "x" * 5000
    assert markup.clean(f'class="{"w " * 300}" href="{link}">the heat flux') == "the heat flux"
    assert markup.clean(f"[{'label ' * 200}]({link}) and so").startswith("label label")
    assert markup.clean("$$" + "\\frac{" * 9 + "a" + "}{b}" * 9 + "$$").count("/(b)") == 9
    assert markup.clean("It is &amp;amp;lt;i&amp;amp;gt;so&amp;amp;lt;/i&amp;amp;gt; here.") == "It is so here."


def test_links_of_all_markups_weigh_as_links():
    """A list of Markdown links around the text is furniture as one of HTML links is."""
    body = "".join(f"<p>We find, in the end, that the flux of heat is what it was, and that this can be seen here, case {i}.</p>" for i in range(4))
    got = markup.clean(f"<div>[Home page](a) [Archive of it](b) [[Shop|Shop of it]]</div><div>{body}</div>")
    assert got.count("We find") == 4 and "Archive" not in got


def test_stars():
    assert markup.residues("to* do with the flux")["markdown"] == 1 and markup.clean("to* do with the flux") == "to do with the flux"
    assert not markup.marks("Coefficients marked* are significant") and not markup.marks("0.64* for it")


def test_marks_on_the_tree(spark):
    df = spark.createDataFrame([(1, "a <i>b</i> and **c**"), (2, None), (3, "plain"), (3, "plain"), (4, "")], "chunk_ord bigint, text string")
    got = [tuple(r) for r in markup.marked(df).orderBy("chunk_ord").collect()]
    assert got == [(1, 4, ["html", "markdown"], 1, 1.0), (2, 0, [], 0, 1.0), (3, 0, [], 0, 1.0), (3, 0, [], 0, 1.0), (4, 0, [], 0, 1.0)]
    assert markup.marked(df.limit(0)).count() == 0
