import re

from pyspark.sql import functions as F

from sievelake.functions import text as X
from sievelake.functions.html import clean_html, html_to_markdown


def _one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("out")).first().out


def test_clean_text_is_stable(spark):
    raw = "a\n\n\n\nb   c ____ d [http://x](y) httpd\n---\n***\nhttps://e.org/a\n  \nend  "
    once = _one(spark, X.clean_text(F.col("t")), t=raw)
    assert once == "a\n\nb c --- d  \n\n \nend"
    raw = once = _one(spark, X.clean_text(F.col("t")), t=raw.replace("[http://x](y)", ""))
    assert _one(spark, X.clean_text(F.col("t")), t=once) == once


def test_word_tokens_are_unicode(spark):
    assert _one(spark, X.words(F.col("t")), t="Ärger_1, straße ÉTÉ!") == ["ärger_1", "straße", "été"]


def test_hints_and_category(spark):
    hints = _one(spark, X.keyword_hints(F.col("t")), t="A SQL injection, then XSS and a padding oracle; no sqlix")
    assert hints == ["crypto", "padding_oracle", "sql_injection", "sqli", "xss"]
    given = F.array(F.lit(" "), F.lit(" Web "))
    assert _one(spark, X.categorise(given, F.array(F.lit("x"))), t="") == "web"
    assert _one(spark, X.categorise(F.lit(None).cast("array<string>"), F.array().cast("array<string>")), t="") == "uncategorized"


def test_lcs_ratio_equals_brute_force(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    pairs = [("kitten", "sitting"), ("php_disable", "php_disabled"), ("a", "b"), ("", "x"), ("", ""), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.lcs_ratio(F.col("a"), F.col("b")).alias("r"))
    for a, b, r in df.collect():
        assert abs(r - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


def test_antonyms(spark):
    swap = X.antonym_swap(F.col("a"), F.col("b"))
    for a, b, want in [("heap_overflow", "heap_underflow", True), ("underflow", "overflow", True), ("read_file", "write_data", False), ("a_b", "a_b", False), ("pack", "unpack_x", False)]:
        assert _one(spark, swap, a=a, b=b) is want


def test_infer_title(spark):
    title = X.infer_title(F.col("u"), F.col("t"))
    assert _one(spark, title, u="https://e.org/writeups/htb-forest", t="") == "Htb Forest"
    assert _one(spark, title, u="https://e.org/", t="\n# First heading\nx") == "First heading"
    assert _one(spark, title, u="https://e.org/index", t="") == "https://e.org/index"


def test_html(spark):
    page = """<html><head><style>x{}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li>menu</li></ul></nav>
    <h1>Title &amp; more</h1><div class="meta tags">gone<p>too</p></div><p>Some <b>bold</b> <a href="http://x">link</a><br>text</p>
    <ul><li>one</li><li>two</li></ul><div id="comments">gone</div><pre>code
      kept</pre><footer>f</footer></body></html>"""
    text = _one(spark, clean_html(F.col("t")), t=page)
    assert "# Title & more" in text
    assert "Some **bold** link\ntext" in text
    assert re.search(r"\* one\n\* two", text)
    assert "```\ncode\n kept\n```" in text
    assert not re.search("gone|menu|too|var a|x{}", text)
    assert html_to_markdown(None) == html_to_markdown("  ") == ""
    assert html_to_markdown("<div><p>open <b>and</i> wrong</div> end").strip().endswith("end")
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert html_to_markdown(deep).strip() == "deep"
