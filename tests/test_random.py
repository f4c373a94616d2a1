"""Random inputs against plain loops; each test is one Spark job over many samples."""

import itertools
import random
import re

from changelens.functions import diffs, replies, text
from pyspark.sql import functions as F


def visible(line):
    kept, quote, escaped = [], "", False
    for ch in line:
        if escaped:
            escaped = False
        elif quote:
            escaped = ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "#":
            return "".join(kept).rstrip()
        kept.append(ch)
    return line.rstrip()


def test_comments_of_random_code(spark):
    rng = random.Random(11)
    samples = ["".join(rng.choice("ab#\"'\\ \n") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    samples = [s for s in samples if '"""' not in s and "'''" not in s and s.strip()]
    want = [re.sub(r"\n{3,}", "\n\n", "\n".join(visible(ln) for ln in s.split("\n"))).strip() for s in samples]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = [r["c"] for r in df.select("i", text.clean_python("s").alias("c")).orderBy("i").collect()]
    assert [(s, g, w) for s, g, w in zip(samples, got, want) if g != w][:3] == []


def random_diff(rng):
    lines = []
    for _ in range(rng.randint(1, 25)):
        kind = rng.random()
        name = rng.choice("abc")
        if kind < 0.08:
            lines.append(f"diff --git a/{name}.py b/{name}{name}.py")
        elif kind < 0.14:
            lines.append(rng.choice(["--- /dev/null", f"--- a/{name}.py", f"--- {name}"]))
        elif kind < 0.18:
            lines.append(f"+++ b/{name}.py")
        elif kind < 0.30:
            lines.append("@@ -1 +1 @@")
        elif kind < 0.34:
            lines.append(rng.choice(["", "odd", "\\ No newline"]))
        else:
            lines.append(rng.choice("+- ") + rng.choice(["x", "value = make(10)", "use(value)", "go(make(10))", "value"]))
    return "\n".join(lines)


def plain_hunks(diff):
    found, file, body, live = [], "", [], False
    for line in [*diff.split("\n"), "@@ end"]:
        git, old = re.match(r"diff --git a/\S+ b/(\S+)", line), re.match(r"--- (\S+)", line)
        if git or old or line.startswith("@@ "):
            if body:
                found.append((file, body))
            body, live = [], not git
            if git:
                file = git[1]
            elif old and old[1] != "/dev/null":
                file = re.sub("^a/(?=.)", "", old[1])
        elif line and live and not line.startswith("+++"):
            body.append(line if line[0] in "+- " else " " + line)
    return found


def plain_pairs(body):
    runs = [(sign, [ln[1:] for ln in group]) for sign, group in itertools.groupby(body, key=lambda ln: ln[0])]
    return [pair for (s1, a), (s2, b) in itertools.pairwise(runs) if s1 + s2 == "-+" for pair in zip(a, b)]


def plain_moves(body, sign):
    other, out = "+-".replace(sign, ""), []
    for i, line in enumerate(body):
        if line[0] == sign and " = " in line:
            var, expr = line[1:].split(" = ")
            after = body[i + 1:]
            uses = sum(ln[0] == sign and var in ln[1:] and expr not in ln[1:] for ln in after)
            if uses >= 2 and any(ln[0] == other and expr in ln[1:] for ln in after):
                out.append((var, expr, uses))
    return sorted(out, key=lambda x: -x[2])


def test_random_diffs(spark):
    rng = random.Random(5)
    samples = [random_diff(rng) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, d string").withColumn("h", diffs.hunks("d"))
    rows = df.select("i", "h", diffs.line_pairs("h").alias("p"), diffs.assignment_moves("h", "+").alias("ext"),
                     diffs.assignment_moves("h", "-").alias("inl")).orderBy("i").collect()
    hits = 0
    for diff, r in zip(samples, rows):
        plain = plain_hunks(diff)
        assert [(h["file"], h["body"].split("\n")[:-1]) for h in r["h"]] == plain, diff
        assert [tuple(p) for p in r["p"]] == [p for _, body in plain for p in plain_pairs(body)], diff
        for col, sign in (("ext", "+"), ("inl", "-")):
            want = sorted((m for _, body in plain for m in plain_moves(body, sign)), key=lambda x: -x[2])
            assert [tuple(m) for m in r[col]] == want, diff
            hits += len(want)
    assert hits > 5


def test_rendered_detections_parse_back(spark):
    rng = random.Random(3)
    pairs = [[(f"Type {i} {rng.choice('<>&x')}", "+" + "".join(rng.choice("ab<>&\" ") for _ in range(8)) + "z") for i in range(rng.randint(1, 4))] for _ in range(200)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pairs)], "i int, d array<struct<type:string,evidence:string>>")
    back = df.select("i", replies.parse_block(text.detections_xml("detections_so_far", "d"), "detections_so_far").alias("b"),
                     F.transform("d", lambda x: text.xml_unescape(text.xml_escape(x["evidence"]))).alias("e")).orderBy("i").collect()
    for p, r in zip(pairs, back):
        assert [(t.strip(), e) for t, e in p] == [tuple(x) for x in r["b"]]
        assert [e for _, e in p] == r["e"]
