"""The pN_ queries: against SQL or brute force, and that all of them run."""

import math
import re

import numpy as np
import pytest
from oracle import compare

from equirank.llm import catalog, common, knn, lookalike, markup, mojibake


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, name, catalog.QUERIES[name], catalog.ORACLE[name])


FOUND = {
    "p1_found": ["paper_id_a", "paper_id_b"], "p2_found": ["cell_id"], "p3_found": ["source_table", "row_id", "ref_id"], "p4_found": ["vec_id_a", "vec_id_b"],
    "p5_found": ["source_table", "row_id", "field_name"], "p6_found": ["vec_id", "field_name"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs_and_rows_are_distinct(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in FOUND:
        assert df.columns == FOUND[name]
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows))
    else:
        assert df.count() >= 0


def vectors(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in common.read(spark, sf, "fairsearch_arxiv").select("vec_id", "embedding").collect() if r["embedding"] is not None]
    rows.sort()
    x = np.array([v for _, v in rows], dtype=np.float64)
    return np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    ids, x = vectors(spark, sf)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :10]
    pairs = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in top[a] if s[a, b] >= 0.9}
    found = {tuple(r) for r in catalog.p4_found(spark, sf).collect()}
    assert len(found & pairs) >= 0.99 * len(pairs) and len(found - pairs) <= 0.02 * len(pairs)
    # small cells, so that queries must cross them
    df = common.read(spark, sf, "fairsearch_arxiv").select("vec_id", "embedding")
    near = knn.nearest(df, "vec_id", "embedding", queries="vec_id % 20 = 0", cell=128).collect()
    got = {}
    for r in near:
        got.setdefault(r["key"], set()).add(r["other"])
    at = {v: i for i, v in enumerate(ids)}
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked) and all(len(g) == 10 for g in got.values())
    assert np.mean([len(got[i] & set(ids[top[at[i]]])) / 10 for i in asked]) >= 0.9


def test_markup_of_plain_signs():
    plain = [
        "at $4 per item, or $4153 in total for", "p < 0.04 whenever n > 5986 for", "R&D teams ported C# to F# in C++", "max_iter_1 and top_k_3", "A*-style search, 8*9 to 1104",
        "studies [3, 1433] relied", "item #64; the tuple (a1, b2)", "rewards ~ as expected.", "Noisy gradients [extended version 7]", "", None, "a & b", "x = 3", "List<String> of 5",
    ]
    assert [t for t in plain if markup.markup_kinds(t)] == []
    marked = {
        "<i>x</i> y": "html", "a &amp; b": "html", "line<br/>two": "html", "<jats:p>x</jats:p>": "html", "a &#8211; b": "html", "# Title": "markdown", "a **b** c": "markdown",
        "a `b` c": "markdown", "x\n- one\n- two": "markdown", "| a | b |\n|---|---|\n| c | d |": "markdown", "see [x](https://a.example/b)": "markdown", "~~a~~ b": "markdown",
        "a [[b|c]] d": "wiki", "''a'' b": "wiki", "== H ==\ntext": "wiki", "a {{cite|x|year=2}}": "wiki", "the \\emph{b}": "latex", "$\\alpha$-fair": "latex", "$n^2$ time": "latex",
        "M\\\"{o}rk": "latex", "``a'' b": "latex", "5\\% of": "latex", "\\[ x = 1 \\] y": "latex",
    }
    assert {t: markup.markup_kinds(t) for t in marked} == {t: [k] for t, k in marked.items()}


def test_markup_to_text():
    page = (
        "<nav><a href='x'>home</a> <a href='y'>about</a></nav><div><h2>Results</h2><p>We find, after long tests, that it works well and is cheap.</p>"
        "<ul><li>one item</li><li>two &amp; more</li></ul><pre><code>for q in qs:\n    rank(q)</code></pre><p>With <b>bold</b> and $x^2$, also <a href='z'>links</a>.</p></div>"
        "<div><a href='1'>link one</a> <a href='2'>link two</a></div>"
    )
    want = "# Results\nWe find, after long tests, that it works well and is cheap.\n- one item\n- two & more\n```\nfor q in qs:\n    rank(q)\n```\nWith bold and $x^2$, also links."
    assert markup.clean_text(page) == want
    assert markup.clean_text("\\begin{itemize} \\item One \\item M\\\"{o}rk \\end{itemize} \\[ a = b \\]") == "- One\n- Mörk\n$$a = b$$"
    assert markup.clean_text("== H ==\nSee [[a|the b]] and ''c''.{{cite|x}}") == "# H\nSee the b and c."
    assert markup.clean_text("| a | b |\n|---|---|\n| c | d |") == "a | b\nc | d"
    assert markup.clean_text("plain text stays, $4 or $5") == "plain text stays, $4 or $5"
    assert markup.clean_text(None) is None and markup.clean_text("") == ""
    long = "word, " * 50_000 + "<b>x</b>"
    assert len(markup.clean_text(long)) > 290_000


#: Structure as it is planted in the raw texts, and how it must read in the clean ones.
STRUCTURE = {
    "heading": (r"(?m)^(?:#{1,6}|={1,6}) *([^\n=<`$*_\[{\\]+?) *=*$|<h[1-6]>([^<\n`$*_\[{\\&]+)</h[1-6]>|\\(?:sub)*section\*?\{([^{}\n`$*_\[\\]+)\}", "# {}"),
    "item": (r"(?m)^[-*+] +([^\n<`$*_\[{\\&]+)$|<li>([^<\n`$*_\[{\\&]+)</li>|\\item +([^\n\\`$*_\[{<&]+)", "- {}"),
    "code": (r"(?<!`)`([^`\n]+)`(?!`)|<code>([^<\n&]+)</code>", "`{}`"),
    "block of code": (r"(?ms)^```[^\n]*\n([^`]+?)\n```", "```\n{}\n```"),
    "formula": (r"\$\$(.+?)\$\$|\\\[([^$]+?)\\\]", "$${}$$"),
    "inline formula": (r"(?<![\w$\\])\$(\\[a-z]+[^$\n]*)\$(?![\w$])", "${}$"),
}


def test_structure_of_planted_markup_is_kept(spark):
    df = common.read(spark, "/root/testdata/sf0.1", "fairsearch_arxiv").select("title", "abstract")
    texts = {v for r in df.collect() for v in r if v}
    seen, lost = dict.fromkeys(STRUCTURE, 0), []
    for text in texts:
        clean, kinds = markup.clean(text)
        for what, (pattern, form) in STRUCTURE.items():
            for found in re.findall(pattern, text) if kinds else ():
                inner = next(x for x in found if x) if isinstance(found, tuple) else found
                seen[what] += 1
                if form.format(" ".join(inner.split()) if what in ("heading", "item") else inner.strip()) not in clean:
                    lost.append((what, inner, text, clean))
    assert all(n >= 10 for n in seen.values()) and not lost, (seen, lost[:2])


def test_look_alikes():
    same = {
        "Сokvоsvrer": "Cokvosvrer", "Ｌａｂ ｆｏｒ": "Lab for", "Norkolﬁ": "Norkolfi", "été": "été", "a​b­c": "abc", "x y　z": "x y z",
        "Α-fair λ": "Α-fair λ", "H. Щелинский": "H. Щелинский", "Методы": "Методы", "а tool": "a tool", "naïve “x” – y": "naïve “x” – y", "": "",
    }
    assert {k: lookalike.unify(k) for k in same} == same


def test_encoding_repair():
    clean = ["Größe", "für", "Möllgård", "été", "déjà", "wartość", "средняя", "качество", "“", "”", "–", "’", "°", "€"]
    d = mojibake.Decoder({w: 50 for w in clean})
    for wrong in ("cp1252", "latin-1", "cp437", "mac-roman", "cp850"):
        for word in ("Größe", "für", "Möllgård", "été"):
            bad = word.encode().decode(wrong)
            assert d.text(f"see {bad} now")[:2] == (f"see {word} now", 1), (wrong, bad)
    assert d.text("средняя".encode().decode("cp1251"))[0] == "средняя"
    assert d.text("средняя".encode("cp1251").decode("cp1252"))[0] == "средняя"
    assert d.text("wartość".encode("iso8859-2").decode("latin-1"))[0] == "wartość"
    assert d.text("été".encode().decode("cp1252").encode().decode("cp1252"))[0] == "été"
    assert d.text("M�llg�rd")[:2] == ("Möllgård", 1)
    assert d.text("zzz�q")[1:] == (1, True)
    for fine in ("INFORMAÇÃO", "SÃO-1", "L’étude de l’équité", "¿Por qué?", "„Ä“ und «É»", "°C ± 5 €", "Âge", "“second look”", "чем тем", "naïve"):
        assert d.text(fine) == (fine, 0, False), fine


def test_chi_square_quantiles():
    assert knn.chi_square_quantile(0.9, 1) == pytest.approx(2.705543, abs=1e-4)
    assert knn.chi_square_quantile(0.9, 8) == pytest.approx(13.361566, abs=1e-4)
    assert math.isclose(knn.chi_square_quantile(0.5, 2), 2 * math.log(2), rel_tol=1e-6)


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_near_duplicates_at_other_widths(spark, sf):
    from equirank.llm import neardup

    rows = common.read(spark, "/root/testdata/sf0.01", "fairsearch_arxiv").select("paper_id", "title", "abstract")
    classes, links = neardup.near_duplicates(rows, "paper_id", ["title", "abstract"])
    got = {tuple(r) for r in neardup.near_duplicate_pairs(classes, links, 5).collect()}
    texts = {}
    for r in rows.collect():
        w = words(f"{r['title'] or ''} {r['abstract'] or ''}")
        texts[r["paper_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = sorted(texts)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]) and texts[a] & texts[b]}
    assert got == want
    groups = neardup.near_duplicate_groups(classes, links)
    work = {r["key"]: r["work"] for r in groups.collect()}
    assert set(work) == set(ids) and all(work[a] == work[b] for a, b in want)


def test_lost_bytes_are_read_as_any_byte():
    clean = ["Índia", "India", "Ásia", "éndia", "средняя", "Möllgård", "été", "”", "“"]
    d = mojibake.Decoder({w: 50 for w in clean})
    want = {
        "Ã�ndia": "Índia", "“Ã�ndiaâ€�": "“Índia”", "â€œÃ�siaâ€�": "“Ásia”", "средняя".encode().decode("cp1252", "replace"): "средняя",
        "M�llg�rd": "Möllgård", "M��llg��rd": "Möllgård", "�t�": "été", "��t��": "été", "M�¶llgÃ�rd": "Möllgård",
    }
    assert {t: d.text(t)[0] for t in want} == want and not any(d.text(t)[2] for t in want)
    assert d.text("Ã�zzz") == ("Ã�zzz", 1, True)
    d = mojibake.Decoder({"Índia": 3, "Éndia": 9})
    assert d.text("Ã�ndia")[0] == "Éndia"  # the likelier word of two that fit


def test_table_cells_keep_all_they_hold():
    row = "<table><tr><td><p>first cell</p></td><td><div><p>second</p><ul><li>an item</li></ul></div></td><td>plain</td></tr></table>"
    assert markup.clean_text(row) == "first cell | second an item | plain"
    layout = "<table><tr><td><h2>Results</h2><div><p>It works.</p></div></td><td><table><tr><td><p>a</p></td><td>b</td></tr></table></td></tr></table>"
    assert markup.clean_text(layout) == "# Results\nIt works.\na | b"


def test_unclosed_dropped_elements_lose_no_text():
    for name in ("ref", "nav", "head", "select", "button", "svg", "iframe", "script", "style"):
        assert markup.clean_text(f"We find <b>much</b><{name}> and more behind.") == "We find much and more behind.", name
        assert markup.clean_text(f"We find <b>much</b><{name}>dropped</{name}> and more.") == "We find much and more.", name
    assert markup.clean_text("One <ref>open, two <ref>gone</ref> three <ref name='x'/> four.") == "One open, two three four."


def edited_pairs(kind, n=400, seed=7):
    """Pairs of made texts with one kind of edit, their share of common three-word sequences just at or above one half."""
    rng = np.random.default_rng([seed, *kind.encode()])
    vocabulary = [f"w{i}" for i in range(20_000)]
    for i in range(n):
        a = list(rng.choice(vocabulary, 150))
        order = rng.permutation(150)
        for m in range(150, 0, -1):  # the largest edit that keeps the pair
            new = [f"x{j}" for j in range(m)]
            at = int(rng.integers(0, 150))
            b = {
                "replaced": a[:at] + new + a[at + m :], "appended": a + new, "inserted": a[:at] + new + a[at:], "deleted": a[:at] + a[at + m :],
                "scattered": [new[j] if j < m else w for j, w in zip(order, a)],
                "reordered": [w for part in np.random.default_rng(i).permutation(m) for w in a[150 * part // m : 150 * (part + 1) // m]],
            }[kind]
            s, t = ({tuple(x[j : j + 3]) for j in range(len(x) - 2)} for x in (a, b))
            if len(s & t) >= 0.5 * len(s | t):
                break
        yield f"{kind}{i:03}", " ".join(a), " ".join(b)


def test_near_duplicates_of_each_kind_of_edit_at_the_threshold(spark):
    from equirank.llm import neardup

    kinds = ("replaced", "appended", "inserted", "deleted", "scattered", "reordered")
    data = [row for kind in kinds for k, a, b in edited_pairs(kind, 150) for row in ((f"{k}a", a), (f"{k}b", b))]
    df = spark.createDataFrame(data, "paper_id string, title string")
    want = {(data[i][0], data[i + 1][0]) for i in range(0, len(data), 2)}
    for dimension in (2, 3):
        near = neardup.near_duplicates(df, "paper_id", ["title"], width=3, similarity=0.5, dimension=dimension)
        got = {tuple(r) for r in neardup.near_duplicate_pairs(*near, 3).collect()}
        assert got <= want
        for kind in kinds:
            lost = {p for p in want - got if p[0].startswith(kind)}
            assert len(lost) <= 2, (dimension, kind, len(lost))  # 150 pairs at the threshold


def test_dimension_follows_the_records_and_keeps_comparisons_bounded():
    from equirank.llm import neardup

    rng = np.random.default_rng(3)
    symbols = rng.zipf(1.3, (5000, 24)).clip(max=2**30).astype(np.int32)
    chosen = [neardup.choose_dimension(symbols, n, 0.5, 1e-4) for n in (10**3, 10**5, 10**7, 10**9)]
    assert chosen == sorted(chosen) and chosen[0] == 2 and chosen[-1] > 2
    for k in neardup.DIMENSIONS:
        code = neardup.code_for(k, 0.5, 1e-4)
        met = neardup._at_least(k, k + 1, 0.5) * neardup._at_least(code.agree, neardup.LANE, 0.5 + 0.5 / 16)
        assert (1 - met) ** code.blocks <= 1e-4 and code.symbols >= code.length + neardup.LANE


def test_anchors_are_code_words_within_the_covering_radius():
    from equirank.llm import neardup

    rng, code = np.random.default_rng(4), neardup.code_for(2, 0.5, 1e-4)
    x = rng.integers(0, 2**32, (50, code.symbols), dtype=np.uint32)
    y = x.copy()
    for b in range(code.blocks):  # any one symbol of each block differs
        y[:, b * 3 + b % 3] ^= np.uint32(12345)
    at = lambda s: np.stack([a for a, _ in neardup._anchors(s, code)], axis=1).reshape(50, code.blocks, 3)
    a, b = at(x), at(y)
    assert all(set(a[i, j]) & set(b[i, j]) for i in range(50) for j in range(code.blocks))
    assert not any(set(a[i].ravel()) & set(a[i + 1].ravel()) for i in range(49))


def test_long_and_wrapped_inline_formulas_are_kept():
    long = "x = " + " + ".join(f"\\frac{{a_{i}}}{{b_{i}}}" for i in range(30))
    assert len(long) > 200 and markup.clean_text(f"We set ${long}$ here.") == f"We set ${long}$ here."
    assert markup.clean_text("We set $y = \\frac{a}{b}\n+ c$ here.") == "We set $y = \\frac{a}{b} + c$ here."
    assert markup.markup_kinds("It costs $4 here. " + "word " * 60 + "and now US$5 there") == []
    assert markup.markup_kinds("one $x = 1\n\nnext y$ end") == []
    assert markup.clean_text("from (A$)($x^2$) on") == "from (A$)($x^2$) on"


def test_texts_garbled_here_are_restored(spark):
    import random

    docs = common.read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    bad = {r[0] for r in mojibake.restore_texts(docs).select("doc_id").collect()}
    rng, kinds = random.Random(5), ["cp1252", "latin-1", "cp437", "mac-roman", "cp850", "cp1251", "cp1250", "twice", "lost", ("cp1251", "cp1252"), ("iso8859-2", "latin-1"), ("cp1250", "cp1252")]
    rows, truth = [], {}
    for r in docs.where("text is not null").orderBy("doc_id").collect():
        text = r["text"]
        if r["doc_id"] in bad:
            continue
        if not text.isascii() and rng.random() < 0.15:
            kind = kinds[len(truth) % len(kinds)]
            try:
                if kind == "twice":
                    wrong = text.encode().decode("cp1252").encode().decode("cp1252")
                elif kind == "lost":
                    wrong = text.encode("latin-1").decode("utf-8", "replace")
                else:
                    wrong = text.encode().decode(kind) if isinstance(kind, str) else text.encode(kind[0]).decode(kind[1])
            except UnicodeError:
                wrong = text
            if wrong != text:
                truth[r["doc_id"]], text = (kind, text, wrong), wrong
        rows.append((r["doc_id"], text))
    got = {r["doc_id"]: r["restored"] for r in mojibake.restore_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert set(got) <= set(truth) and len(got) >= 0.98 * len(truth) and len(truth) > 150, [truth[d] for d in set(truth) - set(got)]
    spoilt, restored = {}, {}
    for d, (kind, text, wrong) in truth.items():
        group = kind if kind in ("lost", "twice") else "mixed up" if isinstance(kind, tuple) else "misread"
        for a, b, c in zip(*(re.split(r"[ \t\r\n]+", x) for x in (text, got.get(d, wrong), wrong)), strict=True):
            spoilt[group] = spoilt.get(group, 0) + (a != c)
            restored[group] = restored.get(group, 0) + (a == b != c)
    share = {g: restored[g] / spoilt[g] for g in spoilt}
    assert share["misread"] == share["twice"] == 1 and share["mixed up"] >= 0.99 and share["lost"] >= 0.9, share


def test_doubtful_pieces_follow_their_document():
    reading = lambda pair, text, gain: {"pair": pair, "reading": text, "gain": gain}
    known = {
        "A1": {"restored": "a1", "pairs": [0], "others": []}, "A2": {"restored": "a2", "pairs": [0, 3], "others": []},
        "d": {"restored": None, "pairs": [], "others": [reading(0, "D", -0.5), reading(3, "X", 9.0)]}, "u": {"restored": "u!", "pairs": [], "others": []},
    }
    assert mojibake._context(["A1", "d", "A2", "d", "?", "d"], known) == {1: "D", 3: "D", 5: "D"}
    assert mojibake._context(["A1", "d", "A1", "u"], known) == {} == mojibake._context(["d"], known) == mojibake._context([], known)
    weak = {**known, "d": {"restored": None, "pairs": [], "others": [reading(0, "D", -9.0)]}}
    assert mojibake._context(["A1", "A2", *["d"] * 4], weak) == {}
