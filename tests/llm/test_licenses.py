"""Cosines equal a plain computation; licences come down from the nearest directory."""

import math
from collections import Counter

from pyspark.sql import functions as F

from blockloom.llm import licenses
from tests.llm.helpers import LONG, TEXT

NOTICE = licenses.TEMPLATES
FILES = [
    (1, "a", True, NOTICE["MIT"] + "\n" + TEXT), (2, "a/b", True, NOTICE["GPL-3.0"] + "."), (3, "a/b/c", True, TEXT), (4, "a/x", True, TEXT),
    (5, "z", True, TEXT), (6, "z", False, NOTICE["MIT"]), (7, "a/b", True, TEXT + "\nlicensed under CC BY-NC 4.0!"), (8, None, True, TEXT), (9, "a/b/c", True, None),
    (10, "a/b/c", True, ""), (11, "a", True, NOTICE["ISC"]), (12, "a", True, NOTICE["ISC"]), (12, "a", True, NOTICE["ISC"]), (13, "q", True, LONG + "\n" + NOTICE["Apache-2.0"]),
    (14, "t", True, NOTICE["MIT"]), (15, "t", True, NOTICE["ISC"]), (16, "t/u", True, "released\nunder the\nMIT License")]


def plain_score(text, name):
    compiled = licenses.Templates()
    counts = Counter(w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split())
    weights = {t: n * compiled.idf.get(t, compiled.unseen) for t, n in counts.items()}
    return sum(w * compiled.unit[name].get(t, 0) for t, w in weights.items()) / math.sqrt(sum(w * w for w in weights.values()))


def test_scan(spark):
    files = spark.createDataFrame(FILES, "doc_id long, dir string, names_license boolean, text string").withColumn("license", F.lit("x")).withColumn("score", F.lit(2))
    rows = licenses.scan(files).collect()
    assert len(rows) == len(FILES)
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "own", None), 3: ("GPL-3.0", "inherited", "a/b"), 4: ("ISC", "inherited", "a"), 5: (None, None, None), 6: ("MIT", "own", None),
        7: ("CC-BY-NC-4.0", "own", None), 8: (None, None, None), 9: ("GPL-3.0", "inherited", "a/b"), 10: ("GPL-3.0", "inherited", "a/b"), 11: ("ISC", "own", None),
        12: ("ISC", "own", None), 13: ("Apache-2.0", "own", None), 14: ("MIT", "own", None), 15: ("ISC", "own", None), 16: ("MIT", "own", None)}
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert abs(scores[7] - plain_score("licensed under CC BY-NC 4.0!", "CC-BY-NC-4.0")) < 1e-6 and scores[2] == 1.0 and scores[3] is None


def test_every_template_is_found_among_the_others():
    for name, text in NOTICE.items():
        ranked = sorted(NOTICE, key=lambda other: (-round(plain_score(text, other), 9), other))
        assert ranked[0] == name


def test_empty_and_native(spark):
    none = spark.createDataFrame([], "doc_id long, dir string, names_license boolean, text string")
    out = licenses.scan(none)
    assert out.count() == 0
    plan = licenses.own_licences(none, licenses.Templates())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
