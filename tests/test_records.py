"""Records against a parser that goes sign by sign."""

import random
import re

from cinegrid.operators import records as R

GOOD = "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f.mp4"


def brute(raw):
    """(reason or None) by a state machine."""
    s, fields, i, n = raw or "", [], 0, len(raw or "")
    while True:
        if i < n and s[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if s[i] == '"':
                    if i + 1 < n and s[i + 1] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + s[i], i + 1
            if i < n and s[i] != ",":
                return "quoting"
        else:
            j = s.find(",", i)
            j = n if j < 0 else j
            cell, i = s[i:j], j
            if '"' in cell:
                return "quoting"
        fields.append(cell)
        if i >= n:
            break
        i += 1
    if len(fields) != 6:
        return "columns"
    ok = re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.mp4", fields[0])
    ok = ok and re.fullmatch(r"([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)?", fields[3].strip(" "))
    ok = ok and not any(c == "�" or (c < " " and c not in "\t\n\r") for c in fields[2])
    return None if ok else "value"


CASES = [
    None, "", ",", ",,,,,", f"{GOOD},a,b,1,2,3", f'{GOOD},"a,b","c\nd",1,2,3', f'{GOOD},"a""b",c,1e5,2,3', f'{GOOD},a"b,c,1,2,3', f'"{GOOD}",a,b, 1 ,2,3',
    f'{GOOD},"a"b,c,1,2,3', f'{GOOD},"a,b,1,2,3', f"{GOOD},a,b,1.,2,3", f"{GOOD},a,b,.5,2,3", f"{GOOD},a,b,1_0,2,3", f"{GOOD},a,b,١,2,3", f"{GOOD}\n,a,b,1,2,3", f"{GOOD},a,b\x00,1,2,3", f"{GOOD},a,b\t\r\n,,2,3",
    f"{GOOD},a,�,1,2,3", f"{GOOD.upper()},a,b,1,2,3", f"{GOOD},a,b,1,2", f"{GOOD},a,b,1,2,3,4", '""', '"', '"""', '""""', 'a,"",b,"""","",c', f'{GOOD},~0,"~1,~","",2,3', "x" * 200_000, '"' + 'y""' * 50_000 + '"',
]


def test_reasons(spark):
    rng = random.Random(5)
    rows = CASES + ["".join(rng.choice('",a~\n1') for _ in range(rng.randrange(12))) for _ in range(3000)] + [f"{GOOD},a,b,1,2,3"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "line_id long, raw_line string").selectExpr("line_id", "raw_line", "'x' as id", "1 as errors", "2 as record", "3 as cells")
    got = {r[0]: r[1] for r in R.rejected(df, "line_id", "raw_line").select("line_id", "reason").collect()}
    assert got == {i: w for i, x in enumerate(rows) if (w := brute(x))}


def test_valid_rows_are_typed(spark):
    rows = [(1, f'{GOOD},"say ""hi"", ~1",two,  1.5e1 ,,junk'), (None, f"{GOOD},a,b,,1,2"), (2, "broken")]
    got = R.valid(spark.createDataFrame(rows, "line_id long, raw_line string"), "line_id", "raw_line").collect()
    assert sorted((r[0] or 0, r["Brief Description"], r["vtss_score"], r["video_clip_score"]) for r in got) == [(0, "a", None, 2.0), (1, 'say "hi", ~1', 15.0, None)]


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert R.rejected(df, "line_id", "raw_line").count() == 0 and R.valid(df, "line_id", "raw_line").count() == 0


def test_junk_is_told(spark):
    """Texts that are no numbers in columns without a rule give null and a warning, and the record stays valid."""
    name = "00000000-0000-4000-8000-000000000000.mp4"
    rows = [(1, f"{name},a,b,1, 2 ,x"), (2, f"{name},a,b,1,,  "), (3, f"{name},a,b"), (4, None)]
    got = {r.k: [(w.reason, w.column) for w in r.warnings] for r in R.parsed(spark.createDataFrame(rows, "k int, raw string"), "k", "raw").collect()}
    assert got == {1: [("junk", "video_clip_score")], 2: [], 3: [], 4: []}
    assert {r.k: r.motion_score for r in R.valid(spark.createDataFrame(rows, "k int, raw string"), "k", "raw").collect()} == {1: 2.0, 2: None}
