"""Small cases per operator: what goes in, what comes out."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import blocks, footnotes, html, inline, spans, tables, wrap
from quire.operators.lines import join_lines, split_lines
from quire.plans.pipeline import Options, normalize, normalize_texts
from quire.sources import files
from quire.streaming.files import normalize_stream


def run(spark, change, *docs):
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, lines array<string>")
    found = {r.doc_id: r.lines for r in change(frame).collect()}
    assert sorted(found) == list(range(len(docs)))
    return [found[i] for i in range(len(docs))]


TABLES = [
    (["|A|B|", "|---|:-:|", "|1|22|"], ["| A   | B   |", "| --- | :-: |", "| 1   | 22  |"]),
    (["|river|sea|  |", "|Po|Adria||Elbe|North|"], ["| river | sea   |", "| Po    | Adria |", "| Elbe  | North |"]),
    (["| sort --unique"], ["| sort --unique"]),
    (["| a | b |", "| c |"], ["| a | b |", "| c |"]),
    (["| A | B | C |", "| --- | --- |", "| 1 | 2 | 3 |"], ["| A | B | C |", "| --- | --- |", "| 1 | 2 | 3 |"]),
    (["| 漢字 | é |", "| a | 🙂 |"], ["| 漢字 | é  |", "| a    | 🙂 |"]),
    (["```", "|a|b|", "```"], ["```", "|a|b|", "```"]),
    (["    |a|b|"], ["    |a|b|"]),
    (["| a |bb|", "| c | d |", "> note | with pipe"], ["| a | bb |", "| c | d  |", "> note | with pipe"]),
    (["|cat \\| wc|q|", "|r|s|"], ["| cat \\| wc | q |", "| r         | s |"]),
    ([], []),
    ([""], [""]),
]


def test_tables(spark):
    assert run(spark, tables.reflow_tables, *[a for a, _ in TABLES]) == [b for _, b in TABLES]


def test_setext(spark):
    cases = [
        (["Heading", "==="], ["# Heading"]),
        (["> Quote", "> ----"], ["> ## Quote"]),
        (["A", "===", "---"], ["# A", "---"]),
        (["A", "=="], ["A", "=="]),
        (["```", "A", "===", "```"], ["```", "A", "===", "```"]),
        (["> A", "==="], ["> A", "==="]),
        (["\tTide", " ---"], ["## Tide"]),
        ([" \t-Tide", "  ---"], [" ## -Tide"]),
        (["> Tide", "  ==="], ["# > Tide"]),
        (["  Tide", "> ==="], ["  Tide", "> ==="]),
        (["\u2003Tide", " ==="], ["\u2003Tide", " ==="]),
    ]
    assert run(spark, blocks.setext_headings, *[a for a, _ in cases]) == [b for _, b in cases]


def test_lists(spark):
    cases = [
        (["1. a", "4. b"], ["1. a", "2. b"]),
        (["3. a", "   9. x", "   9. y", "5. b", "   7. z"], ["1. a", "   1. x", "   2. y", "2. b", "   1. z"]),
        (["2. a", "# H", "5. b"], ["1. a", "# H", "1. b"]),
        (["2. a", "", "Text.", "", "5. b"], ["1. a", "", "Text.", "", "1. b"]),
        (["1. a", "```", "7. code", "```", "9. b"], ["1. a", "```", "7. code", "```", "2. b"]),
        (["0. a", "1) b"], ["0. a", "1) b"]),
    ]
    assert run(spark, blocks.renumber_lists, *[a for a, _ in cases]) == [b for _, b in cases]


def test_breaks(spark):
    cases = [(["a", "***", "- - -", "*-*", "\t___"], ["a", "_" * 70, "_" * 70, "*-*", "_" * 70]), (["```", "---", "```"], ["```", "---", "```"])]
    assert run(spark, blocks.format_breaks, *[a for a, _ in cases]) == [b for _, b in cases]


def test_fences(spark):
    cases = [
        (["````rust", "x", "````"], ["```rust", "x", "```"]),
        (["````rust", "x"], ["```rust", "x"]),
        (["~~~~null", "x", "~~~~"], ["```", "x", "```"]),
        (["~~~~", "```", "~~~~"], ["~~~~", "```", "~~~~"]),
        (["```", "x", "```", "y"], ["```", "x", "```", "y"]),
    ]
    assert run(spark, blocks.compress_fences, *[a for a, _ in cases]) == [b for _, b in cases]
    cases = [(["Rust", "", "```", "x", "```"], ["```rust", "x", "```"]), (["a", "Rust", "```", "x", "```"], ["a", "Rust", "```", "x", "```"])]
    assert run(spark, blocks.attach_orphan_specifiers, *[a for a, _ in cases]) == [b for _, b in cases]


def test_footnotes(spark):
    cases = [
        (["Rain fell all week.4"], ["Rain fell all week.[^1]"]),
        (["the third valve  6 : shut"], ["the third valve[^1]: shut"]),
        (["# Title.7 x"], ["# Title.7 x"]),
        (["B[^9] a[^4] b[^9]", "", "[^4]: four", "[^9]: nine", "  more"], ["B[^1] a[^2] b[^1]", "", "[^1]: nine", "  more", "[^2]: four"]),
        # empty lines between definitions travel with the next one, that of the first goes behind it
        (["B[^9] a[^4] b[^9] c[^2]", "", "[^2]: two", "", "[^4]: four", "", "[^9]: nine"], ["B[^1] a[^2] b[^1] c[^3]", "", "[^1]: nine", "", "", "[^2]: four", "[^3]: two"]),
        (["x[^2] y[^1]", "", "[^1]: one", "", "", "[^2]: two"], ["x[^1] y[^2]", "", "[^1]: two", "", "[^2]: one", ""]),
        (["T", "", "## Footnotes", "", "1. one", "2. two"], ["T", "", "## Footnotes", "", "[^1]: one", "[^2]: two"]),
        (["1. one", "2. two"], ["1. one", "2. two"]),
        (["`a.3 ` b"], ["`a.3 ` b"]),
    ]
    assert run(spark, footnotes.convert_footnotes, *[a for a, _ in cases]) == [b for _, b in cases]


def test_ellipsis(spark):
    cases = [
        (["a.... b", "`x...y` z..."], ["a….  b".replace("  ", " "), "`x...y` z…"]),
        (["```", "...", "```", "    ...", "a", "    b..."], ["```", "...", "```", "    ...", "a", "    b…"]),
        (["[a...b](http://x/...) c..."], ["[a...b](http://x/...) c…"]),
    ]
    assert run(spark, inline.replace_ellipsis, *[a for a, _ in cases]) == [b for _, b in cases]


def test_code_emphasis(spark):
    cases = [
        (["Low water: `tide`** and `noon`"], ["Low water: **`tide` and `noon`"]),
        (["at ``a`b``_ sea_"], ["at _``a`b`` sea_"]),
        (["**`a`**"], ["**`a`**"]),
        (["plain `a` text"], ["plain `a` text"]),
    ]
    assert run(spark, inline.fix_code_emphasis, *[a for a, _ in cases]) == [b for _, b in cases]


def test_html(spark):
    cases = [
        (["<table>", "<tr><th>A</th><th>B</th></tr>", "<tr><td>1<td>22</table>", "after"], ["| A   | B   |", "| --- | --- |", "| 1   | 22  |", "after"]),
        (["x <table><tr><td>1</td></tr></table>"], ["x <table><tr><td>1</td></tr></table>"]),
        (["<table>", "<tr><td>open"], ["<table>", "<tr><td>open"]),
        (["```", "<table></table>", "```"], ["```", "<table></table>", "```"]),
    ]
    assert run(spark, html.convert_html_tables, *[a for a, _ in cases]) == [b for _, b in cases]


MALFORMED = [
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c"]]),
    ("<table>stray<tr><td>a</td>text<b>z</b><td>b</table>", [["a", "b"]]),
    ("<table><td>a<td>b</table>", [["a", "b"]]),
    ("<table><tr><td>a</tr></td><td>b</table>", [["a"], ["b"]]),
    ("<table><tr><td>a</div></p>b</td></th><td>c</tbody></table>", [["ab", "c"]]),
    ("<table><tr><td>a</td><table><tr><td>b</table></table>", [["a"]]),
    ("<table><tr><td>a<table>o<tr><td>in</table>y</table>", [["aoiny"], ["in"]]),
    ("<table><tr><td>a<template><td>q</td><tr></template>b</table>", [["ab"]]),
    ("<td>x</td><table><caption>c<tr></table>", [[]]),
    ("<table><thead><td>h<tbody><tr><th>x</table>", [["h"], ["x"]]),
    ("<table><colgroup><col><col><tr><td>1<br>2</table>", [["12"]]),
    ("<table>" * 3 + "x", []),
]


@pytest.mark.parametrize(("source", "rows"), MALFORMED)
def test_tables_are_repaired(source, rows):
    tables_ = html.tables_of(source)
    assert [[text for _, text in row] for row in tables_[0]] == rows


@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<tbody>", "</thead>", "<b>", "</b>", "<template>", "</template>", "<caption>", "x", " ", "<p>", "</p>"]), max_size=30))
def test_repaired_trees_are_well_formed(parts):
    """Cells stand in rows, rows in groups, groups in tables, and tables hold nothing else but blanks."""
    builder = html.TreeBuilder()
    builder.feed("".join(parts))
    builder.close()
    within = {"tr": {"tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "tbody": {"table"}, "thead": {"table"}, "caption": {"table"}}
    for node in [builder.root, *builder.root.below()]:
        if isinstance(node, html.Element) and node.name != "template":
            for child in node.children:
                if isinstance(child, html.Element) and child.name in within:
                    assert node.name in within[child.name]
                if node.name in ("table", "tbody", "tr"):
                    assert isinstance(child, html.Element) and child.name in {"template", *within} or child == "" or str(child).isspace()


def test_wrap(spark):
    words = " ".join(["abcd"] * 30)
    got = run(spark, wrap.wrap, [words], ["- " + words], ["> " + words], ["# " + words], ["a  ", "b"], [], ["x `" + "y " * 40 + "z` w"])
    assert [len(x) for x in got[0]] == [79, 69] and " ".join(got[0]) == words
    assert got[1][0].startswith("- abcd") and all(x.startswith("  abcd") for x in got[1][1:])
    assert all(x.startswith("> ") and len(x) <= 80 for x in got[2])
    assert got[3] == ["# " + words] and got[4] == ["a  ", "b"] and got[5] == []
    assert any("`" + "y " * 40 + "z`" in x for x in got[6])


def test_wrap_units(spark):
    pad = "x" * 68
    got = run(spark, wrap.wrap, [pad + " 7th October 1998 was dry"], [pad + " [a b](u) [c](v) z"], ["[l]:", "  http://x.y", '  "Some title"', "a", "b"], ["Point. [^1] more"])
    assert got[0] == [pad, "7th October 1998 was dry"] and got[1] == [pad, "[a b](u) [c](v) z"]
    assert got[2] == ["[l]:", "  http://x.y", '  "Some title"', "a b"] and got[3] == ["Point.[^1] more"]


def test_wrap_open_code(spark):
    got = run(spark, wrap.wrap, ["- [ ] run `a b", "  c d` then", "next"], ["- one `x` two", "three"])
    assert got == [["- [ ] run `a b c d` then", "next"], ["- one `x` two", "three"]]


def test_wrap_links_dates_and_code(spark):
    pad = "x" * 60
    for unit in ("[a [b] \\] c](u(v(w)) \\) z)", "![^n](u v)", "(4 May 2021).[^n]", "“March 3rd, 1999[^x].", "pre-`a b`, (`c d`);"):
        assert wrap.fit(f"{pad} {pad[:10]} {unit} end", 80)[1].startswith(unit[: unit.find(",") + 1 or None]), unit
    one, other = "word " * 8 + "`" + "alpha " * 6, "beta " * 12 + "`"
    got = run(spark, wrap.wrap, [one.strip(), other, "after it"], ["- a ` ", "b", "` c"], ["- a `", "b", "` c"])
    # a span that is too wide stands apart from the words around it
    assert got == [[("word " * 8).strip(), ("`" + "alpha " * 6).strip(), other, "after it"], ["- a `b` c"], ["- a `b` c"]]


CASES = [
    (["- Call `outer(inner(", "  arg))` at once."], ["- Call `outer(inner(arg))` at once."]),
    (["- Call `f(", "  x)` at once."], ["- Call `f( x)` at once."]),
    (["* The path `D:\\tmp\\` is full.", "Second."], ["* The path `D:\\tmp\\` is full.", "Second."]),
    (["> > The `wide", "> > span` of it", "> and out."], ["> > The `wide span` of it", "> and out."]),
    (["> Open `one", ">> Other` depth."], ["> Open `one", ">> Other` depth."]),
    (["- a `b", "  ", "  c` d"], ["- a `b", "", "  c` d"]),
    (["- a `b", "- c` d"], ["- a `b", "- c` d"]),
    (["- a `b", "  c` d  ", "  e"], ["- a `b c` d  ", "  e"]),
    (["- a `b", "  c`d e", "f"], ["- a `b", "  c`d e", "f"]),
    (["- a `b", "  c`d e", "  f"], ["- a `b c`d e f"]),
    (["- x ``a ` b", "  c`` y"], ["- x ``a ` b c`` y"]),
    (["> - quoted" + " word" * 15], ["> - quoted " + "word " * 12 + "word", ">   word word"]),
    (["> # Title", "> text", "> more"], ["> # Title", "> text", "> more"]),
    (["a `b", "```", "x", "```", "c`"], ["a `b", "```", "x", "```", "c`"]),
]


def test_items_with_open_code(spark):
    assert run(spark, wrap.wrap, *[a for a, _ in CASES]) == [b for _, b in CASES]


def block(lines):
    """wrap.wrapped() of items and plain lines, as wrap() deals them."""
    rows = []
    for line in lines:
        own = re.match(r"(?:[-*] |> |)", line)[0]
        quote = "> " if own == "> " else None
        inner = line[2:] if quote else line
        rows.append({"line": line, "quote": quote, "inner": inner, "kind": "bullet" if own and not quote else None, "as_is": False, "prefix": own or None, "repeats": quote is not None, "rest": line[len(own) :]})
    return wrap.wrapped(rows, 40)


ITEM = ["word", "longer-words", "`code`", "`open", "close`", "``two", "two``", "(`x`).", "f(g(", "))", "[a](b c)", "end.[^1]", "`", "x" * 30]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["- ", "* ", "> "]), st.lists(st.lists(st.sampled_from(ITEM), min_size=1, max_size=8), min_size=1, max_size=4))
def test_items_keep_their_text_and_prefix(prefix, parts):
    lines = [(prefix if not i or prefix == "> " else "  ") + " ".join(x) for i, x in enumerate(parts)]
    once = block(lines)
    bare = lambda lines: "".join("".join(x.removeprefix("> ") for x in lines).split())
    assert bare(once) == bare(lines)
    assert once[0].startswith(prefix.strip())


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["- ", "* ", "> "]), st.lists(st.sampled_from(["word", "longer-words", "a", "`code`", "(`x`).", "end.", "[a](b)"]), min_size=1, max_size=40), st.integers(0, 39), st.integers(0, 9))
def test_wrapping_an_item_with_a_span_over_two_lines_twice_changes_nothing(prefix, words, at, more):
    """A span that the first line opens and the second closes."""
    at = min(at, len(words))
    first, second = [*words[:at], "`open"], ["close`", *words[at : at + more]]
    behind = prefix if prefix == "> " else "  "
    once = block([prefix + " ".join(first), behind + " ".join(second)])
    assert block(once) == once


@given(st.text(alphabet="a`\\ ", max_size=30))
def test_code_spans_take_the_right_closing_run(text):
    for start, end, size in spans.code_spans(text):
        runs = [m for m in re.finditer("`+", text[start + size :]) if len(m[0]) == size]
        odd = [len(re.search(r"\\*\Z", text[: start + size + m.start()])[0]) % 2 for m in runs]
        plain = odd.index(0) if 0 in odd else None
        want = runs[-1] if plain is None else runs[plain] if not plain or plain + 1 == len(runs) else runs[plain - 1]
        assert end == start + size + want.end()


def brute_link(text, start):
    """End of a link at start, by counting."""
    at = start + 1
    while at < len(text) and text[at] != "]":
        at += 1 + (text[at] == "\\")
    if text[at + 1 : at + 2] != "(":
        return None
    depth, at = 0, at + 1
    while at < len(text):
        c = text[at]
        depth += (c == "(") - (c == ")")
        at += 1 + (c == "\\")
        if not depth:
            return at
    return len(text)


@given(st.text(alphabet="[]()\\a", max_size=30))
def test_links_of_any_depth(text):
    text = "[" + text
    want = brute_link(text, 0)
    if want is not None:
        assert spans.Brackets(text).link_end(0) == want


@given(st.text(alphabet="ab `[](!\\.-:^1)\"漢 ", max_size=60))
def test_fragments_are_the_text(text):
    assert "".join(spans.tokens(text)) == text
    assert "".join("".join(f.text for f in spans.fragments(text)).split()) == "".join(text.split())


def test_wrapping_is_linear():
    for text in ("[" * 50_000, "[a](" * 20_000, "`a" * 20_001, "(" * 50_000, "\\`" * 30_000, "[^" * 30_000, "a " * 50_000, "`" + "\\` " * 20_000):
        began = time.time()
        wrap.fit(text, 80)
        spans.literal_spans(text + "...")
        assert time.time() - began < 5, text[:10]


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "bad.md").write_bytes(b"a \xff\xfe b\n")
    (tmp_path / "_cut.md").write_bytes("é".encode()[:1])
    (tmp_path / ".good.md").write_text("|a|b|\n|1|é|\n")
    names = [str(tmp_path / x) for x in ("bad.md", "_cut.md", ".good.md")]
    got = files.read_texts(spark, names).orderBy("doc_id").collect()
    assert [(r.ok, r.text, r.error) for r in got] == [(False, None, "is not UTF-8"), (False, None, "is not UTF-8"), (True, "|a|b|\n|1|é|\n", None)]
    from quire.__main__ import main

    assert main(["--in-place", *names]) == 1
    assert (tmp_path / "bad.md").read_bytes() == b"a \xff\xfe b\n" and (tmp_path / ".good.md").read_text() == "| a | b |\n| 1 | é |\n"


PIECES = ["word", "a", "of", "`code span`", "`x`", "[link text](http://u)", "4 May 2021", "longer-word-than-others", "end.", "漢字", "[^1]", "(`in it`),", "x" * 45]


@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(20, 80))
def test_fitting_twice_changes_nothing(pieces, width):
    once = wrap.fit(" ".join(pieces), width)
    text, ends = wrap.joined(once, False)
    assert wrap.fit(text, width, ends) == once
    assert "".join(text.split()) == "".join(" ".join(pieces).split())


def test_front_matter_of_many_documents(spark):
    docs = [["---", f"k: {i}", "---", "1. a", "3. b"] if i % 2 else [f"| {i} | bb |", "| c | d |"] for i in range(6)]
    got = run(spark, lambda d: normalize(d, Options(renumber=True)), *docs)
    assert got == [["---", f"k: {i}", "---", "1. a", "2. b"] if i % 2 else [f"| {i} | bb |", "| c | d  |"] for i in range(6)]


def test_tables_with_hidden_rows_and_promoted_separators(spark):
    cases = [
        (["|k|v|", "\\- note", "|--|--|", "|1|2|"], tables.reflow_tables),
        (["|k|v|", "|:-|-:|", "|wide cell|2|"], tables.reflow_tables),
    ]
    got = [run(spark, change, lines)[0] for lines, change in cases]
    assert got[1] == ["| k         | v   |", "| :-------- | --: |", "| wide cell | 2   |"]
    # dot runs are replaced before the columns are measured
    assert run(spark, lambda d: tables.reflow_tables(d, True), ["|a...|b|", "|c|d|"])[0] == ["| a… | b |", "| c  | d |"]


def test_nested_html_tables(spark):
    doc = ["<table><tr><th>o</th></tr><tr><td>a <b>b</b>", "<table><tr><td>in</td></tr></table></td></tr></table>", "end"]
    got = run(spark, html.convert_html_tables, doc)[0]
    assert got[-1] == "end" and got[0].startswith("| o") and "a b" in " ".join(got) and "in" in " ".join(got)


def test_cells_after_a_nested_table(spark):
    doc = ["<table><tr><td>a<table><tr><td>x<td>y</table></td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"]
    assert run(spark, html.convert_html_tables, doc)[0] == ["| axy | b   |", "| --- | --- |", "| x   | y   |", "| c   | d   |", "| x | y |"]


def test_process_tokens(spark):
    upper = lambda t: t[1].upper() if t[0] == "text" else t[1]
    assert run(spark, lambda d: inline.process_tokens(d, upper), ["a `b` c", "```", "d", "```", ""], [], ["", ""]) == [["A `b` C", "```", "d", "```", ""], [], ["", ""]]
    assert run(spark, lambda d: inline.process_tokens(d, lambda t: ""), ["a", "b", ""]) == [[]]
    assert run(spark, lambda d: inline.process_tokens(d, lambda t: t[1].strip("\n")), ["a", "b", "", ""]) == [["ab", "", ""]]
    assert inline.text_lines("a\r\nb\r") == ["a", "b\r"] and inline.text_lines("a\n", 2) == ["a", "", ""]
    line = "x \\`y ``a`b``s z"
    assert "".join(map(inline.original, inline.tokens_of([line, "```", "`", "```"]))) == "\n".join([line, "```", "`", "```"])


def test_html_in_fences(spark):
    doc = ["```", "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", "```"]
    assert run(spark, lambda d: html.convert_html_tables(d, fences=False), doc)[0][1:4] == ["| 1   |", "| --- |", "| 2   |"]


def test_command_line(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "a.md").write_text("1. a\n4. b\n")
    assert main(["--renumber", str(tmp_path / "a.md")]) == 0 and capsys.readouterr().out == "1. a\n2. b\n"
    assert main([str(tmp_path / "no.md")]) == 1 and "no such file" in capsys.readouterr().err


def test_command_line_in_place(spark, tmp_path, capsys):
    from quire.__main__ import main

    for name, text in (("a é.md", "| a | bb |\n| ccc | d |\n"), ("_b.md", "x\n\ny"), ("empty.md", "")):
        (tmp_path / name).write_text(text)
    names = [str(tmp_path / x) for x in ("a é.md", "none.md", "_b.md", "empty.md")]
    assert main(["--in-place", *names]) == 1 and "none.md" in capsys.readouterr().err
    assert {x.name: x.read_text() for x in tmp_path.iterdir() if not x.name.startswith(".")} == {
        "a é.md": "| a   | bb |\n| ccc | d  |\n", "_b.md": "x\n\ny\n", "empty.md": ""
    }
    with pytest.raises(SystemExit):
        main(["--in-place"])


@pytest.mark.parametrize(("line", "kind"), [("#123", "heading"), ("- a", "bullet"), ("1. a", "bullet"), ("> a", "blockquote"), ("[^1]: x", "footnote_definition"), ("[a]: u", "link_reference_definition"), ("2024 a", "digit_prefix"), ("    - a", None), ("a", None)])
def test_block_kind(spark, line, kind):
    assert spark.createDataFrame([(line,)], "x string").select(X.block_kind(F.col("x"))).first()[0] == kind


def test_lines_round_trip(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\n", "a\n\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r[0]: r[1] for r in frame.select("doc_id", join_lines(split_lines(F.col("text")))).collect()}
    assert [out[i] for i in range(6)] == ["", "\n", "a\n", "a\n", "a\nb\n", "a\n\n"]


def test_pipeline_and_frontmatter(spark):
    every = Options(*[True] * 8)
    doc = ["---", "x: |a|b|", "---", "Title", "=====", "|a|b|", "|1|22|", "", "7. x...", "***"]
    want = ["---", "x: |a|b|", "---", "# Title", "| a | b  |", "| 1 | 22 |", "", "1. x…", "_" * 70]
    once, empty = run(spark, lambda d: normalize(d, every), doc, [])
    assert once == want and empty == []
    assert run(spark, lambda d: normalize(d, every), once)[0] == want


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("|a|b|\n|1|22|\n")
    paths = [str(tmp_path / "none.md"), str(tmp_path / "in" / "a.md")]
    got = {r.doc_id: r for r in files.rewrite(spark, paths, Options()).collect()}
    assert not got[0].ok and got[0].error and got[1].ok and got[1].text == "| a | b  |\n| 1 | 22 |\n"
    files.write_texts(files.rewrite(spark, paths, Options()), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    normalize_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["| a | b  |\n| 1 | 22 |\n"]


def test_null_text(spark):
    frame = spark.createDataFrame([(0, None)], "doc_id long, text string")
    assert normalize_texts(frame).collect() == [(0, "")]
