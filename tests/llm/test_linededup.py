import random

import pytest

from panelcast.llm.linededup import dedup_lines
from tests.llm.helpers import docs, prose


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, min_chars=20):
    lines = []
    for d, text in rows:
        for no, raw in enumerate((text if text is not None else "").split("\n") if text is not None else []):
            lines.append((d is not None, d or 0, no, raw, raw.strip(" \t\r\x0b\x0c")))
    out = {}
    for known, d, no, raw, line in lines:
        gone = line != "" and any(
            (k, e, n) < (known, d, no) and (o == line or (min(len(o), len(line)) >= min_chars and distance_at_most_one(o, line)))
            for k, e, n, _, o in lines)
        out.setdefault((known, d), []).append((no, raw, gone))
    return {k: "\n".join(raw for _, raw, gone in sorted(v) if not gone) for k, v in out.items()}


def _rows():
    rng = random.Random(5)
    base = [prose(i, rng.randint(3, 60)) for i in range(12)] + ["short", "short!", "exactly twenty chars"]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            kind = rng.random()
            if kind < 0.5 and s:
                at = rng.randrange(len(s))
                s = rng.choice([s[:at] + s[at + 1:], s[:at] + "Q" + s[at:], s[:at] + "Q" + s[at + 1:], s[:at] + "éQ"[rng.randint(0, 1)] + s[at + 1:]])
            lines.append(rng.choice(["", "  ", "\t"]) + s + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    return rows + [(70, ""), (71, "\n\n"), (72, prose(99, 3000)), (73, prose(99, 3000) + "x"), (74, "x" + prose(99, 3000)[1:])]


def test_equals_brute_force(spark):
    rows = _rows()
    got = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows).repartition(3)).collect()}
    want = brute(rows)
    assert got == {d: want.get((True, d), "") for d, _ in rows}


def test_nulls_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    line = "the same line of some length"
    rows = [(1, None), (None, line), (2, line), (2, line), (3, line + "\nother content that stays"), (3, "different text of the same id")]
    d = docs(spark, rows).select("*", *[F.lit(c).alias(c) for c in ("key", "id", "doc", "h1", "nos", "line")])
    out = dedup_lines(d, counts=True)
    assert out.columns == [*d.columns, "lines", "equal_dropped", "near_dropped"]
    got = sorted(((r.doc_id is None, r.doc_id, r.text, r.equal_dropped) for r in out.collect()), key=str)
    assert got == sorted([(False, 1, None, 0), (True, None, line, 0), (False, 2, "", 1), (False, 2, "", 1),
                          (False, 3, "other content that stays", 1), (False, 3, "different text of the same id", 0)], key=str)


def test_rows_equal_in_id_and_text_are_one_document(spark):
    line = "a line that occurs in two equal rows"
    assert [r.text for r in dedup_lines(docs(spark, [(4, line), (4, line)])).collect()] == [line, line]


def test_a_hot_line_is_kept_once(spark):
    rows = [(i, f"boilerplate in every single document\n{prose(i, 12)}") for i in range(300)]
    texts = [r.text for r in dedup_lines(docs(spark, rows)).orderBy("doc_id").collect()]
    assert sum("boilerplate" in t for t in texts) == 1 and "boilerplate" in texts[0]
    assert all(prose(i, 12) in t for i, t in enumerate(texts))


def test_empty_table(spark):
    assert dedup_lines(docs(spark, [])).count() == 0


def test_main_path_runs_no_python(spark):
    plan = dedup_lines(docs(spark, _rows()))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("a, b, near", [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "acb", False)])
def test_the_brute_force_distance(a, b, near):
    assert distance_at_most_one(a, b) is near
