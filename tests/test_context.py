from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions import text
from changelens.operators import context

ROWS = [("a", "Add Parameter", 0.9, None, "first", "int a; // note\n// gone\nint b;"), ("b", "Add Parameter", 0.2, 0.95, "se<cond", "x" * 50),
        ("c", "Move Class", 0.99, None, "other level", "y"), ("d", "Rename Parameter", 0.1, None, "", "z;")]


def exemplars(spark):
    schema = f"e array<{schemas.EXEMPLAR}>"
    full = [(i, t, s, r, d, c, None, None, None, None, None, None, None) for i, t, s, r, d, c in ROWS]
    return spark.createDataFrame([(full,)], schema)


def test_level_examples(spark):
    df = exemplars(spark)
    xml = df.select(context.level_examples_xml("e", "parameter_level", budget=F.lit(30))).first()[0]
    # the best-ranked exemplar does not fit the budget and is skipped, the smaller ones follow
    assert xml == (
        '<java_reference_examples>\n  <example type="Add Parameter">\n    <description>first</description>\n'
        "    <code_text>int a; // note\nint b;</code_text>\n  </example>\n"
        '  <example type="Rename Parameter">\n    <code_text>z;</code_text>\n  </example>\n</java_reference_examples>')
    assert df.select(context.level_examples_xml("e", "method_level")).first()[0] == "<java_reference_examples/>"
    ranked = df.select(context.rank_exemplars("e", 3).alias("r")).first()["r"]
    assert [x["id"] for x in ranked] == ["c", "b", "a"]


def test_messages_and_blocks(spark):
    df = spark.createDataFrame([([("Add Parameter", '+a "b"')], ["Move Class", "Add Parameter"])], "d array<struct<type:string,evidence:string>>, t array<string>")
    row = df.select(
        text.detections_xml("stage2_detected", "d").alias("d"), text.candidates_xml("t").alias("c"),
        context.confusion_hints_xml("t", {"Move Class": "a > b", "Move And Rename Class": "one"}).alias("h"),
        context.format_messages(context.message_pair(F.lit("sys \n"), F.lit("user"), True)).alias("m"),
        context.confusion_hints_text("t", {"Move Class": "a", "Invert Condition": "b"}).alias("p"),
        text.truncate(F.lit("x" * 1600)).alias("cut"), text.iso_millis(F.lit(1.5)).alias("ts")).first()
    assert row["d"] == '<stage2_detected>\n  <type evidence="+a &quot;b&quot;">Add Parameter</type>\n</stage2_detected>'
    assert row["c"].count("<type>") == 2
    assert row["h"] == ('<confusion_hints>\n  <hint type="Move Class">a &gt; b</hint>\n'
                        '  <hint type="Move And Rename Class" status="check_compound">one</hint>\n</confusion_hints>')
    assert row["m"] == "--- system ---\nsys\n\n/no_think\n--- user ---\nuser"
    assert row["p"] == "* **Move Class**: a\n* **Invert Condition** (not detected, check): b"
    assert len(row["cut"]) == 1514 and row["ts"] == "1970-01-01T00:00:01.500"


def test_trophies_and_retrieved(spark):
    t = spark.createDataFrame([([(["A", "A", "B"], "-x\n+y<z", 0.5)],)], "t array<struct<ground_truth:array<string>,diff_snippet:string,sim:double>>")
    assert t.select(context.trophies_xml("t")).first()[0] == (
        '<successful_examples>\n  <example sim="0.5" types="A, B">\n    <diff>\n      -x\n      +y&lt;z\n    </diff>\n  </example>\n</successful_examples>')
    r = spark.createDataFrame([([("A", "A", "d", "c;"), ("B", "B", "", "x" * 99), ("A", "A", "", "e;")],)],
                              "r array<struct<for_type:string,refactoring_type:string,description:string,code_text:string>>")
    xml = r.select(context.retrieved_examples_xml("r", F.lit(10))).first()[0]
    assert xml.count("<example ") == 2 and xml.count("<for_type ") == 1 and "B" not in xml


def test_case_text(spark):
    df = spark.createDataFrame([(" ", [("a.py", "1")], [("b.py", "2"), ("c.py", "3")]), ("-x", [], []), ("", [], [])],
                               f"d string, b {schemas.FILES}, a {schemas.FILES}")
    got = [r[0] for r in df.select(context.format_case("d", "b", "a")).collect()]
    assert got[0] == ("## Python Code Changes\n\n### File: a.py\n\n**Before:**\n```python\n1\n```\n\n**After:**\n```python\n2\n```\n")
    assert got[1] == "## Python Commit Diff\n\n```diff\n-x\n```" and got[2] == "## Python Code Changes\n\nN/A"


def test_page_size_of_transcripts(spark):
    df = spark.range(130).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    pages = context.transcript(df, "c", "turn", "role", "text", 64).orderBy("page").collect()
    assert [r["n_turns"] for r in pages] == [64, 64, 2]
    whole = context.transcript(df, "c", "turn", "role", "text").collect()
    assert [r["n_turns"] for r in whole] == [130] and whole[0]["transcript"] == "\n".join(r["transcript"] for r in pages)
    got = pages
    assert got[2]["transcript"] == "--- user ---\n128\n--- user ---\n129"
