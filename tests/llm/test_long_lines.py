"""op6: passages of many words in one or two lines are runs."""

from helpers import docs, prose

from changelens.llm import op6_lines as op6


def test_long_passages_of_few_lines(spark):
    one, a, b, short = prose(60, 1), prose(30, 2), prose(30, 3), prose(20, 4)
    texts = [f"{one}\nx", one, f"y\n{one}\nz", f"{a}\n\n{b}", f"p\n{a}\n{b}", f"{a}\nq", f"{short}\nr", f"s\n{short}"]
    got = {r.doc_id: (r.removed, r.clean_text) for r in op6.without_repeats(docs(spark, texts)).select("row.doc_id", "removed", "clean_text").collect()}
    want = {0: ([], texts[0]), 1: ([0], ""), 2: ([1], "y\nz"), 3: ([], texts[3]), 4: ([1, 2], "p"), 5: ([], texts[5]), 6: ([], texts[6]), 7: ([], texts[7])}
    assert got == want


def test_whole_table_against_all_stretches(spark):
    seen, want = set(), {}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in table.orderBy("doc_id").collect():
        lines = (r.text or "").split("\n")
        held = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        words = [len([w for w in lines[i].replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) for i in held]
        gone = set()
        for size in range(1, op6.RUN + 1):
            for s in range(len(held) - size + 1):
                if size < op6.RUN and sum(words[s : s + size]) < op6.LONG:
                    continue
                stretch = tuple(lines[i] for i in held[s : s + size])
                if stretch in seen:
                    gone |= set(held[s : s + size])
                seen.add(stretch)
        want[r.doc_id] = sorted(gone)
    assert {r.doc_id: r.removed for r in op6.without_repeats(table).select("row.doc_id", "removed").collect()} == want


def test_work_is_linear_in_lines(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(50_000))
    got = op6.without_repeats(docs(spark, [text, text + "\nend"])).selectExpr("row.doc_id", "size(removed) AS n", "clean_text").collect()
    assert {r.doc_id: (r.n, len(r.clean_text)) for r in got} == {0: (0, len(text)), 1: (50_000, 3)}
