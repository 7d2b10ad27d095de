"""Counts equal plain ones; hosts with bad rates lose their documents, small hosts are drawn towards the mean."""

import random
import re

from pyspark.sql import functions as F

from blockloom.llm import quality
from tests.llm.helpers import ROWS, clashing, documents


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, inside = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            inside.update(p + k for p in places for k in range(5))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_plain_ones(spark):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice(["a", "b", " ", " ", "\n", "c ", "#", "|", "é", "\x0b", "😀 ", "a b a b "]) for _ in range(draw.randint(0, 150))), "en", "s", 0) for i in range(300)] + ROWS
    got = quality.measure(clashing(documents(spark, rows)).drop("n")).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(rows)
    for row in got:
        assert tuple(row)[1:] == plain(row["text"])


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(20))
    rows = [(i, good, "en", "fine", 0) for i in range(50)] + [(100 + i, "too short", "en", "bad", 0) for i in range(49)] + [(149, good, "en", "bad", 0)]
    rows += [(200, "short", "en", "small", 0), (201, good, "en", "small", 0), (202, "short", "en", "one", 0), (300, good, "en", None, 0), (None, good, "en", None, 0)]
    got = quality.judge(clashing(documents(spark, rows)))
    assert got.count() == len(rows)
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert kept == set(range(50)) | {201, 300, None}
    assert {r["doc_id"] for r in got.where("host_blocked AND NOT base_failed").collect()} == {149}
    rates = {r["host"]: r["rate"] for r in quality.host_rates(quality.measure(documents(spark, rows)), "source", F.col("n_words") < 10).collect()}
    assert rates["fine"] < 0.1 and rates["bad"] > 0.9 and rates["one"] < 1 and 0 < rates[None] < 0.5


def test_empty_and_native(spark):
    assert quality.judge(documents(spark, [])).count() == 0
    one = quality.judge(documents(spark, ROWS))
    assert one.count() == len(ROWS)
    plan = one._jdf.queryExecution().executedPlan().toString() + quality.measure(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_single_documents_are_drawn_to_the_mean(spark):
    """Ninety hosts of one document, a third failing: chance alone, so no host is above the limit; hosts that differ more than by chance keep their rates."""
    good, bad = " ".join(f"word{i}" for i in range(20)), "too short"
    rows = [(i, good if i % 3 else bad, "en", f"host{i}", 0) for i in range(90)]
    measured = quality.measure(documents(spark, rows))
    rates = [r["rate"] for r in quality.host_rates(measured, "source", F.col("n_words") < 10).collect()]
    assert max(rates) < 0.36 and min(rates) > 0.30
    assert quality.judge(documents(spark, rows)).where("host_blocked").count() == 0
    rows += [(1000 + i, bad if i % 10 else good, "en", "worst", 0) for i in range(200)]
    got = {r["host"]: r["rate"] for r in quality.host_rates(quality.measure(documents(spark, rows)), "source", F.col("n_words") < 10).collect()}
    assert got["worst"] > 0.85


def test_rates_are_kept_by_rule(spark):
    good, symbols = " ".join(f"word{i}" for i in range(20)), " ".join(f"# word{i}" for i in range(20))
    rows = [(i, "short" if i % 2 else symbols, "en", "mixed", 0) for i in range(40)] + [(100 + i, good, "en", f"h{i % 3}", 0) for i in range(60)]
    rates = quality.rule_rates(quality.measure(documents(spark, rows)), "source", quality.rules()).where("host = 'mixed'").first()
    assert (rates["failures_short"], rates["failures_symbols"], rates["failures_repeats"]) == (20, 20, 0)
    assert abs(rates["rate_short"] - 0.5) < 0.02 and rates["rate_repeats"] == 0
