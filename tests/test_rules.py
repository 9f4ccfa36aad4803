"""Single functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from merchloom.functions import categories as C
from merchloom.functions import html as H
from merchloom.functions import language as L
from merchloom.functions import similarity as S
from merchloom.functions import text as T
from merchloom.functions import urls as U
from merchloom.operators import dedup
from merchloom.operators import rules as R
from merchloom.operators.lexicon import Lexicon


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(text):
    return F.lit(text)


@pytest.mark.parametrize("price,ok", [(1.0, False), (2.99, False), (3.0, True), (29.99, True), (6000.0, True), (9999.0, False), (None, False)])
def test_price_bounds(spark, price, ok):
    assert value(spark, R.price_range(lit(price).cast("double"))) is ok


@pytest.mark.parametrize("title,ok", [("ab", False), ("  abcd  ", False), ("Great Shirt", True)])
def test_title_length(spark, title, ok):
    assert value(spark, R.title_length(lit(title))) is ok


@pytest.mark.parametrize("images,ok", [
    (["https://x/coming-soon.png"], False), (["https://x/a.jpg", "https://x/brand-LOGO.png"], False), (["https://x/a.jpg"], True), ([], True)])
def test_placeholder_images(spark, images, ok):
    array = F.array(*[lit(i) for i in images]).cast("array<string>")
    assert value(spark, R.image_valid(array)) is ok


@pytest.mark.parametrize("text,english", [
    ("A plain shirt for summer", True), ("这是一件衬衫", False), ("これはシャツです", False), ("Une chemise d'été", False), ("", True), ("12345", True)])
def test_language(spark, text, english):
    assert value(spark, L.is_english(lit(text))) is english


def test_cleaning(spark):
    assert value(spark, T.strip_html(lit("<p>Hello <b>bold</b></p>\n<i>x</i>"))) == "Hello bold x"
    assert value(spark, T.clean_title(lit("  two\nlines 　"))) == "two lines"
    assert value(spark, T.clean_tags(F.array(lit("a"), lit("  b  "), lit(" ")))) == ["a", "b"]
    assert len(value(spark, T.clean_description(F.repeat(lit("ab "), 4000)))) == 5000
    assert value(spark, T.sanitize_cell(F.repeat(lit("x"), 40000))).endswith("...(truncated)")


@pytest.mark.parametrize("word,core,strict", [
    ("women", "woman", "woman"), ("berries", "berry", "berry"), ("boxes", "box", "box"), ("running", "run", "running"), ("glass", "glass", "glass"),
    ("dresses", "dress", "dress"), ("used", "used", "used"), ("tried", "try", "tried"), ("wolves", "wolf", "wolve"), ("bus", "bus", "bus")])
def test_singular(spark, word, core, strict):
    assert value(spark, T.singularize(lit(word))) == core
    assert value(spark, T.singularize(lit(word), "strict")) == strict


def test_duplicate_titles(spark):
    rows = spark.createDataFrame([(1, "Shirt"), (2, " shirt "), (3, "Hat"), (4, ""), (5, "SHIRT"), (6, "Sock")], "id int, title string")
    kept = dedup.by_title_first(rows, "title", ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 6]
    assert dedup.by_title_first(kept, "title", ["id"]).count() == 3


@pytest.mark.parametrize("html,total", [("About 1,234 results", 1234), ("约 56 条结果", 56), ("nothing here", None)])
def test_result_totals(spark, html, total):
    assert value(spark, H.result_total(lit(html))) == total


@pytest.mark.parametrize("raw,path", [
    ("A &amp; Bee", "Bee"), ("Home > Shirts", "Shirts"), ("12.3 > Tools > Saws", "Tools|||Saws"), ("n/a", "Other"), ("裙子", "DROP_ROW"), ("", "Other"), ("Men_Shoes/Boots", "Men Shoes|||Boots")])
def test_category_paths(spark, raw, path):
    assert value(spark, C.clean_category_path(lit(raw))) == path


def test_prices_and_keys(spark):
    assert value(spark, U.convert_price(lit("1,234.50"), lit(2.0))) == 2469.0
    assert value(spark, U.convert_price(lit("free"), lit(2.0))) is None
    assert value(spark, U.unique_key(lit("a.com"), lit(" 7 "), lit("T"), lit("I"))) == "a.com|||id|||7"
    assert value(spark, U.unique_key(lit("a.com"), lit(""), lit(" Tee "), lit("I.PNG"))) == "a.com|||fallback|||tee|||i.png"


def test_lexicon_contexts(spark):
    lexicon = Lexicon(terms=("gun", "stun gun", "刀"), safe={"gun": ("glue gun",)})
    assert value(spark, lexicon.hits(lit("A stun-gun, and a gun"))) == ["stun gun", "gun"]
    assert value(spark, lexicon.hits(lit("a glue gun"))) == []
    assert value(spark, lexicon.hits(lit("begun stun, gun 刀具"))) == ["gun", "刀"]
    assert value(spark, lexicon.hits(lit("begun"))) == []


def test_scores(spark):
    assert value(spark, S.token_set(lit("red ring"), lit("big red ring box"))) == 100.0
    assert value(spark, S.token_sort(lit("ring red"), lit("red ring"))) == 100.0
    assert value(spark, S.partial(lit("ring"), lit("earrings"))) == 100.0
    assert value(spark, S.keyword_overlap(lit("red ring set"), lit("a red thing"))) == pytest.approx(100 / 3 + 50)
    assert value(spark, S.fuzzy_score(lit("abc"), lit(""))) == 0.0


def test_python_rule(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "no")], "id int, word string")
    rules = R.RuleSet().add_python_rule("word", lambda w: w == "ok", "word").add_rule("id", lambda d: d["id"] > 0)
    assert [r["id"] for r in rules.valid(rows).collect()] == [1]
    assert {r["id"]: r["failed_rule"] for r in rules.verdict(rows).collect()} == {1: "", 2: "word"}


def test_strict_rejects_what_core_rejects(spark):
    rows = spark.createDataFrame([(t, d, p) for t in ("abc", "a longer title here", "12345678901234567") for d in ("", "x" * 40) for p in (1.0, 50.0)],
                                 "title string, description string, price double")
    both = rows.select(*[R.basic_reject_reason("title", "description", ["price"], R.PROFILES[p]).alias(p) for p in ("core", "strict")]).collect()
    assert all(r["strict"] != "" for r in both if r["core"] != "")


def test_blank_scope_is_an_error(spark):
    from merchloom.sources.readers import scoped

    rows = spark.range(3).withColumn("category", F.lit("a"))
    with pytest.raises(ValueError):
        scoped(rows, "category", " ")
    assert scoped(rows, "category", "__all__").count() == 3


def test_malformed_json_lines(spark, tmp_path):
    from merchloom.sources.readers import read_products_jsonl

    file = tmp_path / "in.jsonl"
    file.write_text('{"标题": "T", "折扣价": ""}\n{broken\n', encoding="utf-8")
    lenient = read_products_jsonl(spark, str(file), strict=False).collect()
    assert [r["title"] for r in lenient] == ["T", None] and lenient[1]["_corrupt"] == "{broken"
    with pytest.raises(Exception, match="(?i)malformed"):
        read_products_jsonl(spark, str(file)).collect()
