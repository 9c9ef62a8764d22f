import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources import files, markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sentences_and_blanks(spark):
    assert one(spark, T.sentences(F.lit("One. Two!  Three?\n\nfour"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.sentences(F.lit(None).cast("string"))) == []
    assert one(spark, T.sentences(F.lit("   \n"))) == []


@given(st.lists(st.text(alphabet=" \t\n\x1c  ab.", max_size=12), min_size=1, max_size=8))
@settings(max_examples=15, deadline=None)
def test_strip_and_tokens_follow_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("k")).collect()
    assert all(r["s"] == r["t"].strip() and r["k"] == r["t"].lower().split() for r in rows)


@pytest.mark.parametrize("text,n", [("", 1), ("a", 1), ("a b c", 3), ("a b c d", 5), (None, 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate(F.lit(text).cast("string"))) == n


def test_names(spark):
    assert one(spark, T.base_name(F.lit("/a/b/c.TXT"))) == "c.TXT"
    assert [one(spark, T.extension(F.lit(p))) for p in ("/a/c.TXT", "/a/c", "/a.b/c", ".bashrc", "x.tar.gz", "..a.b")] == [".txt", "(no ext)", "(no ext)", "(no ext)", ".gz", ".b"]
    assert one(spark, T.chunk_name(F.lit("f.md"), F.lit(3))) == "f.md_chunk_3"
    assert [one(spark, T.counted(F.lit(n), "file")) for n in (0, 1, 2)] == ["0 files", "1 file", "2 files"]
    assert one(spark, T.shown_time(F.lit(None).cast("timestamp"))) == "—"


def test_fingerprint_is_stable():
    assert T.config_fingerprint({"b": 1, "a": "x"}) == T.config_fingerprint({"a": "x", "b": 1})
    assert len(T.config_fingerprint({})) == 8 and T.config_fingerprint({"a": 1}) != T.config_fingerprint({"a": 2})


def test_row_prose(spark):
    row = {"k": F.lit(" 1 "), "v": F.lit(""), "w": F.lit(None).cast("string"), "z": F.lit("y")}
    assert one(spark, T.row_prose(row)) == "k: 1, z: y."
    assert one(spark, T.row_prose({"k": F.lit(" "), "v": F.lit("")})) == "."
    assert one(spark, T.row_prose(row, header=False)) == "col_0: 1, col_1: , col_2: , col_3: y."


def test_table_text(spark):
    table = lambda rows: one(spark, T.table_text(F.from_json(F.lit(rows), "array<array<string>>")))
    assert table('[["a"," b "],["",null],["c",null]]') == "| a | b |\n| --- | --- |\n| c |  |"
    assert table('[["a","b"]]') == "| a | b |"
    assert table('[[" "]]') == "" and table("[]") == ""


def test_html_text():
    assert markup.html_text("a<br>b") == "ab"
    assert markup.html_text("<p>a</p><p>b  c</p><script>x</script>d") == "a b c d"
    assert markup.html_text(None) == ""


def test_html_blocks():
    page = "<head><title>t</title></head><p>one<b>two</b></p><h1>First <i>part</i></h1>three<br>four<h2> </h2><div>five</div><script>no</script>"
    assert markup.html_blocks(page) == [(None, "one two"), ("First  part", "three"), ("First  part", "four"), ("First  part", "five")]


def test_html_rules():
    # Pieces are joined by a space, and what is between them stays.
    assert markup.html_blocks("<p><b>a</b> <i>b</i></p>") == [(None, "a   b")]
    assert markup.html_blocks("<p>w<b>or</b>d</p>") == [(None, "w or d")]
    # The end of an inner skipped element turns text on again.
    assert markup.html_text("<head><script>x</script>seen</head>y") == "seeny"
    assert markup.html_blocks("<p>before<h2>T</h2>after<br>more<td>cell") == [(None, "before"), ("T", "after"), ("T", "more"), ("T", "cell")]
    assert markup.html_blocks("<h1>A</h1><h2> </h2><p>x</p><h3>B<div>C</div></h3>y") == [("A", "x"), ("B C", "y")]
    assert markup.html_text("a<br/>b<li>c</li>d") == "a bc d" and markup.html_text("<tr><td>1</td><td>2</td></tr>3") == "12 3"
    assert markup.html_blocks(None) == [] and markup.html_blocks("<p>y</p>x &am") == [(None, "y")]


def test_bad_bytes():
    bad = b"a,b\n1,\xff\n"
    assert files.blocks_of("x.csv", bad) == [("whole", None, None, "a: 1, b: \ufffd.")]
    assert files.blocks_of("x.md", b"# T\n\n\xff x") == [("split", None, "T", "\ufffd x")] and files.plain_text("x.md", b"\xff x") == "\ufffd x"
    with pytest.raises(UnicodeDecodeError):
        files.blocks_of("x.txt", bad)
    assert files.csv_prose("1,2\n\n3,4\n", header=False, most=2) == "col_0: 1, col_1: 2.\n."


def test_markdown_blocks():
    source = "intro **bold**\n\n# Head *one*\ntext\nmore\n\n```\ncode\n```\n- item\n- other\n\nUnder\n-----\n> said\n\n<div>\nraw\n</div>\n\nend"
    assert markup.markdown_blocks(source) == [(None, "intro **bold**"), ("Head one", "text\nmore"), ("Head one", "item"), ("Head one", "other"), ("Under", "said"), ("Under", "end")]


def test_csv_prose():
    assert files.csv_prose("a,b\n1, x \n,\n2,\n") == "a: 1, b: x.\n.\na: 2."
    assert files.csv_prose("1,2\n", header=False) == "col_0: 1, col_1: 2."
    assert files.csv_prose("a\n1\n2\n", most=1) == "a: 1."
    with pytest.raises(ValueError):
        files.csv_prose("a\n1,2\n")


def test_html_text_equals_its_sql_where_references_are_cut_off(spark, tmp_path):
    import duckdb

    from millrace.plans import queries as plans

    pages = ["<title>x&amp</title></head><h1>one&amp;&amp</h1><p>two &copy three &lt;b&gt; &amp;amp; a & b &", "<p>&copy; R&D &middot;</p>&amp", "<script>a &amp b</script>c&ampd"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: r["text"] for r in plans.html_text(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert found == dict(db.execute(plans.ORACLES["html_text"]).fetchall())
    assert markup.html_text("one&amp;&amp</h1>") == "one&&"
