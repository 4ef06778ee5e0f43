from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from plugload.llm import maintext as M, quoting as Qt
from plugload.llm.queries import ORACLE_SQL, QUERIES
from plugload.settings import Settings

MESSAGES = "conv_id bigint, turn bigint, role string, text string, level string, position string"


def messages(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "l", "p") for c, t, r, x in rows], MESSAGES)


def sql_rows(name, **tables):
    con = duckdb.connect()
    for key, frame in tables.items():
        con.register(key, frame)
    return con.sql(ORACLE_SQL[name]).fetchall()


def quoted_rows():
    return [
        (1, 0, "user", "Hello there, all of you\nHow is  the Weather?"), (1, 1, "assistant", "> how is the weather?\nIt is fine"),
        (1, 2, "user", "Unrelated"), (1, 3, "assistant", ">> How is the weather?\n> It is fine\n>\nGood to hear"),
        (1, 4, "user", "> Unrelated\n> Good to hear\nboth"), (1, 5, "user", "> Good to hear\n> both\n> never said"), (1, 6, "user", "> hello there, all of you\nback to the start"),
        (2, 0, "user", "Good to hear"), (2, 1, "user", " > > > deep words\n   >  It is fine\n    > code"), (3, 0, "system", None), (3, 1, "user", ""),
        (3, 2, "user", "> > only a quote"), (3, 3, "user", "\n\nblank lines\n\n"), (4, 0, "user", "> Good to hear"), (4, 1, "user", "> same\nsame"), (4, 2, "user", "> same"),
    ]


def test_links_and_order(spark):
    df = messages(spark, quoted_rows()).repartition(3)
    got = Qt.without_quotes(df)
    rows = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert rows[1, 1]["parent_turn"] == 0 and rows[1, 1]["reply"] == "It is fine"
    assert rows[1, 3]["parent_turn"] == 1 and rows[1, 3]["root_turn"] == 0 and rows[1, 3]["n_quoted"] == 2
    assert rows[1, 4]["parent_turn"] == 3 and rows[1, 2]["root_turn"] == 2
    assert [t for t in sorted(range(7), key=lambda t: rows[1, t]["position"])] == [0, 1, 3, 4, 5, 6, 2]
    assert rows[4, 0]["n_linked"] == 1 and rows[4, 0]["parent_turn"] is None and rows[4, 1]["n_linked"] == 0 and rows[4, 2]["parent_turn"] == 1
    want = sql_rows("op4_quotes", conversations=df.toPandas()[["conv_id", "turn", "role", "text"]])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    small = Qt.without_quotes(df, Settings(window_rows=2, block_rows=2))
    assert Counter(map(tuple, small.collect())) == Counter(want)


def test_odd_messages(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "> a"), (5, None, "user", "> a"), (5, 1, None, "x" * 100_000), (6, 0, "user", "t"), (6, 0, "user", "t"), (6, 1, "user", "> t")]
    got = Qt.without_quotes(messages(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["position"] for r in got if r["conv_id"] == 6) == [1, 2, 3]
    assert [r["reply"] for r in got if r["conv_id"] == 5 and r["turn"] is None] == [""]
    assert Qt.without_quotes(messages(spark, rows).limit(0)).count() == 0


def test_long_chain_of_answers(spark):
    rows = [(1, t, "user", f"> line {t - 1}\nline {t}") for t in range(40)]
    got = Qt.without_quotes(messages(spark, rows)).collect()
    assert all(r["root_turn"] == 0 for r in got) and [r["position"] for r in sorted(got, key=lambda r: r["turn"])] == list(range(1, 41))


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_quotes"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, d)
    columns = sorted(got.columns)
    assert sorted(found.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(found.select(*columns).fetchall())


PAGE = "page_id bigint, url string, html string, text string, page string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "p") for i, u, h in rows], PAGE)


def article(text):
    return f"<html><head><title>T</title></head><body><nav><ul><li><a>menu</a></ul></nav><div class='ad big'>buy</div><article>{text}</article><footer>&copy; x</footer>"


@pytest.mark.parametrize("page, want", [
    (article("<h1>Title</h1><p>One &amp; two &eacute;&#233;&nbsp; x<br>next\n line<p>Three <b>bold</b>ly</p>"), ["Title", "One & two éé x next line", "Three boldly"]),
    (article("<p><b>lost<br><p>two</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"), ["lost", "two", "a", "b", "c", "d"]),
    (article("<script>var t='</p>';</script>a<!-- > --> b<style>p{}</style><form><p>f</form><aside>s</aside><p class='x user-comments'>c</p><section id=comments><p>d</section>e"), ["a b", "e"]),
    (article("<header><h1>H</h1></header><p hidden>no</p><p style='display: none'>no</p><p title='a > b'>yes</p>text <p>1 < 2 and 3 > 2</p>"), ["H", "yes", "text", "1 < 2 and 3 > 2"]),
    ("<main><p>in</main><p>out", ["in"]), ("<div role=main>in</div>out", ["in"]), ("plain text", ["plain text"]), ("", []), ("<p>", []), ("<article>open <p>end", ["open", "end"]),
    ("<body><div class='cookie-notice'>accept</div><header>h</header><p>a</p></body>", ["a"]), ("<p>a</p><script>never closed <p>x", ["a"]), ("<p>a<p>b<nav", ["a", "b"]),
    ("<P>Upper<DIV CLASS=Sidebar>no</DIV><p data-class='ad'>kept</p>&lt;p&gt; &#x41;", ["Upper", "kept", "<p> A"]),
])
def test_blocks(page, want):
    assert M.page_blocks(page)[0] == want


@pytest.mark.parametrize("page, want", [
    ("<p title='it's'>Hello</p><p>there isn't</p>", ["Hello", "there isn't"]),
    ('<p class="x" ">Lost text</p><p>"quoted"</p>', ["Lost text", '"quoted"']),
    ("<article><p>text</p><article class='comment'><p>reader</p></article><p>end</p></article>", ["text", "end"]),
    ("<div class='has-ads-below no-sidebar'>real text</div><div class='top-ads'>buy</div><div class=siteHeader>h</div>", ["real text"]),
    ("<article class='post comment-open'>kept</article><article id=related>other</article>", ["kept"]),
    ('<p class="x>never closed</p><p>next', ["never closed", "next"]), ("<p a=b'c>one</p><p d='e>f'>two</p>", ["one", "two"]),
    ("<svg/><p>after</p><svg><title>t</title><path d='x'/></svg><p>end", ["after", "end"]), ("<!-->a<!--->b<!-- c --!>d", ["abd"]),
    ("<title>T</title><p>a</p></>b</ x>c", ["a", "bc"]), ("<template><p>x<p>y</template>z<noscript><p>n</noscript>", ["z"]),
    ("<script data-x='</p>'>1</script >a<script src=x>2</script x>b<scripted>c", ["abc"]), ("<div role='main' role=search>in</div>out", ["in"]),
    ("<p " + "'" * 200_000 + ">long", ["long"]), ("<script " + "a" * 200_000, []), ("<p>x</p><p title='role=main'>y</p>", ["x", "y"]),
])
def test_stray_quotes_and_names(page, want):
    assert M.page_blocks(page)[0] == want


def naive_starts(streams, width):
    seen = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - width + 1):
            seen[tuple(s[i : i + width])].add((k, i))
    return seen


def test_suffix_order_groups_equal_heads():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 5, 8):
        streams = [list(rng.choice(list("abc"), n)) for n in (0, 5, 40, 200, 3)]
        stream, position, head = M.suffix_heads(streams, width)
        groups = defaultdict(set)
        for s, p, h in zip(stream, position, head):
            groups[h].add((s, p))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, naive_starts(streams, width).values()))
        assert (np.diff(np.unique(head, return_index=True)[1]) != 0).all()


def test_host_suffix_array(spark):
    menu = "home news sport weather money travel food video music"
    rows = [(i, "http://Host.example/a", f"<div>{menu}</div><p>own text number {i} of this page alone</p><p>{menu} tail{i}</p>") for i in range(5)]
    rows += [(10 + i, "http://other.example/", f"<div>{menu}</div><p>words {i}") for i in range(2)]
    rows += [(20, "http://host.example/b", article(f"<p>{menu}</p>")), (30, None, None), (31, None, ""), (0, rows[0][1], rows[0][2])]
    rows += [(40 + i, "http://copy.example/", "<p>one two three four five six seven eight nine") for i in range(4)]
    rows += [(50, "http://long.example/", article("<p>" + "w " * 200_000))]
    got = M.extract(pages(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[0] == "own text number 0 of this page alone\n\ntail0" and by_id[10] == f"{menu}\n\nwords 0"
    assert by_id[20] == menu and by_id[30] == by_id[31] == "" and by_id[40].endswith("eight nine") and len(by_id[50]) == 399_999
    assert M.extract(pages(spark, rows).limit(0)).count() == 0


def test_given_pages(spark):
    import html, re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op5_main_text"](spark, "/root/testdata/sf0.01").collect()}
    for r in df.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("window_rows, block_rows", [(1 << 20, 1 << 20), (2, 4)])
def test_suffixes_of_a_host_form_one_array(spark, window_rows, block_rows):
    """The order over all tasks is that of the sorted suffixes, and runs are those of equal first words."""
    rng = np.random.default_rng(1)
    rows = [(h, k, [" ".join(rng.choice(list("abc"), 7)), " ".join(rng.choice(list("ab"), 5))]) for h in ("x", "y", "") for k in range(6)]
    df = spark.createDataFrame(rows, "host string, page bigint, blocks array<string>").repartition(5)
    got = M.host_suffix_array(df, 3, Settings(window_rows=window_rows, block_rows=block_rows)).collect()
    want = []
    for host in ("x", "y", ""):
        found = sorted((" ".join(w[i : i + 3]), k, i) for h, k, b in rows if h == host for w in [" ".join(b).split()] for i in range(len(w) - 2))
        runs = {text: n for n, text in enumerate(sorted({text for text, _, _ in found}), 1)}
        want += [(host, k, i, runs[text]) for text, k, i in found]
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_array_is_that_of_all_pages(spark):
    """Pages that declare their text count for the others of their host, within and outside of it, and keep theirs."""
    menu = "home news sport weather money travel food video music"
    own = "a sentence that three articles of this host quote word by word"
    box = "sign up now for our weekly letter of the best stories"
    rows = [(i, "http://a.example/", f"<div>{box}</div><article><p>body {i}</p><p>{menu}</p><p>{own}</p></article>") for i in range(3)]
    rows += [(20, "http://a.example/", f"<p>{menu}</p><p>no article here</p><p>{box}</p><p>my {own} too</p>")]
    rows += [(21, "http://b.example/", f"<p>{menu}</p><p>no article here</p>"), (0, *rows[0][1:])]
    got = {r["page_id"]: r["text"] for r in M.extract(pages(spark, rows).repartition(4)).collect()}
    assert got[20] == "no article here\n\nmy too" and got[21] == f"{menu}\n\nno article here"
    assert all(got[i] == f"body {i}\n\n{menu}\n\n{own}" for i in range(3))


def test_keys_rule_out_no_repeat(spark):
    """Counted by packs and by parts of a host, keys give what brute force over all windows gives."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(h, k, [" ".join(rng.choice(words, 30))], [" ".join(rng.choice(words, 9))], bool(k % 3)) for h in ("x", "y") for k in range(40)]
    df = spark.createDataFrame(rows, "host string, page bigint, blocks array<string>, outside array<string>, declared boolean").repartition(5)
    maps = M.removable_maps(df, 3, 3)
    found = {(r["host"], r["run"], r["page"], r["position"]) for r in M.host_suffix_array(df, 3, maps=maps).collect()}
    places = {(h, p, at) for h, _, p, at in found}
    seen = defaultdict(lambda: (set(), set()))
    for host, page, blocks, outside, declared in rows:
        for part, text in ((0, blocks[0]), (1, outside[0])):
            w = text.split()
            for i in range(len(w) - 2):
                at, opened = seen[host, tuple(w[i : i + 3])]
                at.add((page, i if part == 0 else -1 - i))
                opened.add(not declared)
    want = {(host, *place) for (host, _), (at, opened) in seen.items() if len({p for p, _ in at}) >= 3 and True in opened for place in at}
    assert len(want) > 100 and want == places
