"""LaTeX: projects, macros, tables, bibliographies."""

from sheaf.sources import formats, latex


def test_projects(spark):
    rows = [("p", "main.tex", "a \\input{parts/one} z % \\input{no}\n\\include{gone}"), ("p", "parts/one.tex", "[\\input{main}\\input{two}]"), ("p", "two.tex", "2"), ("q", "other.tex", "x"), ("r", "main.tex", None)]
    got = {r.project: (r.text, r.missing) for r in latex.projects(spark.createDataFrame(rows, "project string, name string, text string")).collect()}
    assert got == {"p": ("a [2] z ", ["main", "gone"]), "q": ("", ["main.tex"]), "r": ("", [])}


def test_macros():
    assert latex.substituted("#1 ## #2 #3", ["a#2", "b"]) == "a#2 # b #3"
    assert latex.expanded(r"\newcommand{\pair}[2]{(#1, #2)}\def\one#1{<#1>}\pair{a}{\one b} \other{x} 5\% % gone") == r"(a, <b>) \other{x} 5\% "
    assert latex.expanded(r"\newcommand\opt[2][d]{#1#2}\opt{x}\opt[y]z\providecommand{\opt}{no}\opt w") == "dxyzdw"
    assert latex.expanded(r"\newcommand{\x}{\x}\x") == r"\x"


TABLE = r"""\begin{tabular}{|l|*{2}{c}p{3cm}@{ }|} \hline a & b\&c & \textbf{d & e} & f \\[2pt] \hline
\multicolumn{2}{r}{wide} & \multirow{2}{*}{tall} & \begin{tabular}{c} x & y \\ z \end{tabular} \\ \cline{1-2} 1 & 2 % no & no
& & 4 \\ \bottomrule \end{tabular} \begin{tabularx}{5cm}[t]{X} \\ only \end{tabularx} \begin{tabular}{*{9999}{c}} a \end{tabular}"""


def test_tables():
    got = list(latex.tables(TABLE))
    assert [r[:7] for r in got if r[0] == 0 and r[1] == 0] == [(0, 0, 0, 1, 1, "l", "a"), (0, 0, 1, 1, 1, "c", r"b\&c"), (0, 0, 2, 1, 1, "c", r"\textbf{d & e}"), (0, 0, 3, 1, 1, "p", "f")]
    assert [r[:6] for r in got if r[0] == 0 and r[1] == 1] == [(0, 1, 0, 2, 1, "r"), (0, 1, 2, 1, 2, "c"), (0, 1, 3, 1, 1, "p")]
    assert [r[6] for r in got if r[0] == 0 and r[1] == 2] == ["1", "2", "", "4"] and [r[6] for r in got if r[0] == 1] == ["only"]
    assert [(r[0], r[7]) for r in got if r[7]] == [(2, "beyond the limits")]


BIB = r"""Free text @article{key1, Title = {A {B} \} c}, year = 1999, author = "X and {"}Y{"} Z", month = jan}
@book(k2, title={(x)}, note="(y)") @string{a = "b"} @comment{@no} @misc{bad key%, a=1} @misc{nokey} @ noentry @misc{k3, title = {open"""


def test_bibliography(spark):
    got = list(latex.bibliography(BIB))
    entries = {r[2]: r[3] for r in got if r[2]}
    assert entries["key1"] == {"title": r"A {B} \} c", "year": "1999", "author": 'X and {"}Y{"} Z', "month": ""} and entries["k2"] == {"title": "(x)", "note": "(y)"}
    assert [r[4] for r in got if r[4]] == ["string-expression", "string-definition", "invalid-key", "entry-key", "entry-header", "unterminated-entry", "unterminated-field"]
    files = spark.createDataFrame([("a.bib", BIB.encode())], "path string, content binary")
    rows = formats.each(files, lambda c: latex.bibliography(c.decode()), latex.BIBLIOGRAPHY).filter("key = 'key1'").collect()
    assert rows[0].fields["year"] == "1999" and rows[0].ord == 1
