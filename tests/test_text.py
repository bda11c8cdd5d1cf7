import sys

from pyspark.sql import functions as F

from slotweave.functions import annotation as A
from slotweave.functions import text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_casefold_equals_python_for_every_code_point(spark):
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    rows = ["".join(chars[i:i + 4096]) for i in range(0, len(chars), 4096)]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    for r in df.select("x", X.casefold(F.col("x")).alias("y")).collect():
        assert r["y"] == r["x"].casefold()


def test_text_key_equals_python(spark):
    texts = ["  Go\t SECRET\n", "Straße", "ΣΑΣ ς", "İstanbul", "a b", "a　b", "a\x1cb", "a\x85b",
             "a​b", "ﬁsh", "fly 𝒳yz", "", "   ", "plain Text"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", X.text_key(F.col("x")).alias("y")).collect():
        assert r["y"] == " ".join(r["x"].casefold().split())


def test_strip_equals_python(spark):
    for t in ["　 a b \x85", "\x1f\ta", ""]:
        assert one(spark, t, X.strip) == t.strip()
        assert one(spark, t, X.rstrip) == t.rstrip()


def test_parse_annotation(spark):
    parts = one(spark, "go [city : Rome] or [ city :  Paris x] [literal]", A.parse_annotation)
    assert [(p["value"], p["kind"]) for p in parts] == [
        ("go ", None), ("Rome", "city"), (" or ", None), ("Paris x", "city"), (" [literal]", None)]
    assert one(spark, "[literal]", lambda c: A.parts_to_text(A.parse_annotation(c))) == "[literal]"
    assert one(spark, "a [x : y] [ country ]", X.generic_mask) == "a {SLOT} {SLOT}"
    assert one(spark, "a [x : y]", lambda c: A.parts_to_annotation(A.parse_annotation(c))) == "a [x : y]"


def test_strict_mask(spark):
    assert one(spark, "go [city:Rome]", A.strict_mask) == "go {SLOT}"
    assert one(spark, "go [city Rome]", A.strict_mask) is None


def spans_df(spark, text, spans):
    return spark.createDataFrame([(text, spans)], f"text string, spans {A.SPANS_TYPE}")


def test_spans_code_points(spark):
    df = spans_df(spark, "fly Zürich to 東京", [(14, 16, "to", "東京"), (4, 10, "from", "Zürich")])
    r = df.select(A.parts_to_pattern(A.spans_to_parts(F.col("text"), F.col("spans"))).alias("p")).first()
    assert r["p"] == "fly {SLOT} to {SLOT}"
    df = spans_df(spark, "fly 𝒳yz", [(4, 7, "c", "𝒳yz")])
    assert df.select(A.parts_to_text(A.spans_to_parts(F.col("text"), F.col("spans"))).alias("p")).first()["p"] == "fly 𝒳yz"
    bad = spans_df(spark, "fly Rome", [(4, 8, "c", "Rome"), (5, 7, "c", "om")])
    assert bad.select(A.spans_to_parts(F.col("text"), F.col("spans")).alias("p")).first()["p"] is None


def test_repair_and_offset_mask(spark):
    df = spans_df(spark, "Rome", [(1, 5, "c", "Rome")])
    r = df.select(A.parts_to_pattern(
        A.spans_to_parts(F.col("text"), A.repair_whole_span(F.col("text"), F.col("spans")))).alias("p")).first()
    assert r["p"] == "{SLOT}"
    df = spans_df(spark, "go Rome to Oslo", [(3, 7, "from.city", "Rome"), (11, 15, "city", "Oslo")])
    r = df.select(A.offset_mask(F.col("text"), F.col("spans")).alias("m"),
                  A.offset_mask(F.col("text"), F.col("spans"), typed=True).alias("t")).first()
    assert r["m"] == "go {SLOT} to {SLOT}"
    assert r["t"] == "go [from.city : Rome] to [city : Oslo]"
    assert one(spark, "from.city", A.strip_role) == "city"
    assert one(spark, "city", A.strip_role) == "city"


def test_small_text_functions(spark):
    assert one(spark, "a,b", X.commas_to_spaces) == "a b"
    assert one(spark, "x {city} {SLOT}", X.collapse_curly_slots) == "x {SLOT} {SLOT}"
    assert one(spark, "{a} {b} {c}", lambda c: X.keep_topk_slot_tokens(c, ["{b}", "{a}", "{c}"], 1)) == "{SLOT} {b} {SLOT}"
    assert one(spark, "{SLOT} x {SLOT}", X.slot_count) == 2
    assert one(spark, "dev", X.normalise_split) == "valid"
    assert one(spark, "a\nb", X.physical_lines) == 2
    assert one(spark, None, X.null_to_space) == " "
    df = spark.createDataFrame([("1", "{SLOT}"), ("1.0", "{SLOT}"), ("0", "{SLOT}")], "n string, p string")
    assert [r[0] for r in df.select(X.strict_slot_count(F.col("n"), F.col("p"))).collect()] == [1, None, None]
