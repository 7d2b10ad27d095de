"""Secret scans: fixed patterns, and a guess-cost model for the values that stand in a credential context.

The cost of a value is the least total of a segmentation into words, dates, repeats, keyboard walks and brute-force
spans, in powers of ten of guesses, found by dynamic programming over its positions. A value in a credential context
whose cost reaches the threshold is a span of its own kind, ``guess``; a cheap one is a placeholder or prose.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blockloom.llm import common

KINDS = ("assign", "access", "hex", "guess")
MASK = "[secret]"
LEAST_COST = 8.0
LEAST_LENGTH = 6
SEGMENT_COST = 0.3
LONGEST_WORD, LONGEST_UNIT = 20, 16
#: A word that no list holds: a whole run of letters in one case (or capitalised) with the shape of speech. Its cost is that of a large
#: vocabulary, and a little for each letter, so that several words in a row or a long run are still a passphrase.
SPOKEN_COST, SPOKEN_LETTER = 4.0, 0.25
SPOKEN = re.compile("[A-Z]?[a-z]{4,}|[A-Z]{5,}")
VOWELS = re.compile("[aeiouy]")
HARSH = re.compile("[^aeiouy]{5}|[aeiouy]{4}|(.)\\1\\1|[qwx][bcdfghjklmnpqrstvwxz][bcdfghjklmnpqrstvwxz]")
#: Common passwords and words of placeholders, most common first.
COMMON_WORDS = (
    "password 123456 admin qwerty letmein welcome test secret token example changeme default user root guest login master "
    "hello sample demo dummy placeholder your here value none null true false undefined string key api access private public "
    "pass word passwd dragon monkey football baseball sunshine princess shadow summer winter spring autumn love server "
    "system manager support service client data base office home work temp dev prod staging local host email mail name "
    "required missing unknown redacted hidden masked abc xyz foo bar baz the and for with from that this not you are was"
).split()
RANKS = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
#: Rows of a keyboard; a walk steps along a row, up or down a row.
KEY_ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
KEY_AT = {key: (row, column) for row, keys in enumerate(KEY_ROWS) for column, key in enumerate(keys) if key != " "}
LOOKS_LIKE = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts of the cost model: further names of credentials, and the same names in prose ("password is ...").
CONTEXT = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api[_-]?key|pwd|passphrase|passcode|credentials?|private[_-]?key|access[_-]?key|bearer))"""
    r"""["']?(?:\x20*(?P<sign>=>|:=|[:=])\x20*|\x20(?ai:is|was)\x20|\x20)["']?(?P<value>[^\s"'<>,;]+)""")
CONTEXT_WORDS = ("passw", "secret", "token", "key", "pwd", "passphrase", "passcode", "credential", "bearer")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False), T.StructField("cost", T.DoubleType())]), False))])


def guess_cost(value: str) -> float:
    """Least log10 of guesses over all segmentations; 0 for an empty value. Linear in the length of the value."""
    size = len(value)
    lower, unit = value.lower(), _alphabet_cost(value)
    if len(lower) != size:  # a letter whose small form is longer
        lower = value
    plain = lower.translate(LOOKS_LIKE)
    best = [0.0] + [math.inf] * size
    walks, runs = _walks(lower), _repeats(lower)
    for i in range(size):
        here = best[i] + SEGMENT_COST
        # Brute force goes on from any position and has no segment cost.
        best[i + 1] = min(best[i + 1], best[i] + unit)
        for length in range(3, min(LONGEST_WORD, size - i) + 1):
            rank = RANKS.get(lower[i:i + length])
            changed = rank is None and RANKS.get(plain[i:i + length])
            if rank or changed:
                case = 0.0 if value[i:i + length] == lower[i:i + length] else 0.5
                best[i + length] = min(best[i + length], here + math.log10((rank or changed) + 1) + case + (0.3 if changed else 0))
        if spoken := _spoken(value, i):
            best[i + spoken] = min(best[i + spoken], here + SPOKEN_COST + SPOKEN_LETTER * spoken)
        if (found := DATE.match(value, i)) and found.end() > i:
            best[found.end()] = min(best[found.end()], here + (2.1 if found.end() - i == 4 else 4.6))
        if (stop := walks[i]) - i >= 3:
            best[stop] = min(best[stop], here + 1.7 + 0.5 * math.log10(stop - i))
        for length, times in runs.get(i, ()):
            stop = i + length * times
            inner = unit * length
            best[stop] = min(best[stop], here + inner + math.log10(times + 1))
    return best[size]


def _spoken(value: str, i: int) -> int:
    """Length of the run of letters from ``i`` if it begins and ends there and has the shape of a word, else 0."""
    if i and value[i - 1].isalpha():
        return 0
    found = SPOKEN.match(value, i)
    if not found or (found.end() < len(value) and value[found.end()].isalpha()) or len(found[0]) > LONGEST_WORD:
        return 0
    word = found[0].lower()
    return len(word) if 0.2 <= len(VOWELS.findall(word)) / len(word) <= 0.7 and not HARSH.search(word) else 0


def _alphabet_cost(value: str) -> float:
    """Brute-force cost of one character by the kinds of characters in use."""
    size = (10 * bool(re.search("[0-9]", value)) + 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value))
            + 33 * bool(re.search("[^0-9A-Za-z]", value)))
    return math.log10(size or 1)


def _walks(lower: str) -> list[int]:
    """End of the keyboard walk or alphabet run that starts at each position."""
    def near(a: str, b: str) -> bool:
        if a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
            return True
        x, y = KEY_AT.get(a), KEY_AT.get(b)
        return bool(x and y and a != b and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1)

    ends = list(range(1, len(lower) + 1))
    for i in range(len(lower) - 2, -1, -1):
        if near(lower[i], lower[i + 1]):
            ends[i] = ends[i + 1]
    return ends


def _repeats(lower: str) -> dict[int, list[tuple[int, int]]]:
    """Start -> (unit length, times) of runs of a unit of up to 16 characters, each run at its first position only."""
    found: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, min(LONGEST_UNIT, len(lower) // 2) + 1):
        i = 0
        while i + 2 * unit <= len(lower):
            same = i
            while same + unit < len(lower) and lower[same] == lower[same + unit]:
                same += 1
            times = (same - i) // unit + 1
            if times >= 2 and unit * times >= 3:
                found.setdefault(i, []).append((unit, times))
            i = max(i + 1, same - unit + 1) if times >= 2 else same + 1
    return found


def spans_of(text: str, least_cost: float = LEAST_COST) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text in code points, by start and then kind."""
    folded, out = text.lower(), []
    if any(word in folded for word in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_LENGTH]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(word in folded for word in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".!?)]}:")
            # Behind a blank, "is" or "was" any word of prose may stand; behind a sign the cost alone decides.
            if len(value) >= LEAST_LENGTH and (m["sign"] or re.search(r"[0-9]", value)) and (cost := guess_cost(value)) >= least_cost:
                out.append(("guess", m.start("value"), m.start("value") + len(value), cost))
    return sorted(out, key=lambda span: (span[1], KINDS.index(span[0])))


def scan(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """Spans of every whole text: doc_id, spans (kind, start, end in code points, cost of guessed values).

    A null or empty text has none, repeated rows stay, other columns of ``docs`` are not read, an empty table gives an
    empty one. ``guess`` values behind a blank, "is" or "was" need a digit, as prose behind a credential word is not a secret;
    behind ``:``, ``=``, ``=>`` or ``:=`` their cost decides, which is that of a word for letters in the shape of one. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
        for batch in common.pieces(batches):
            found = [[dict(zip(("kind", "start", "end", "cost"), span)) for span in spans_of(text, least_cost)]
                     for text in common.text_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind)], names=SCHEMA.fieldNames())

    return common.few_rows(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def masked(text: str | None) -> str | None:
    """The text with each secret replaced; overlapping spans become one."""
    if not text or not (found := spans_of(text)):
        return text
    merged: list[list[int]] = []
    for _, start, end, _ in found:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], MASK]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets masked in ``text``; ``n_chars`` follows where a text changed.

    A null text stays null.
    """
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([masked(text) for text in texts.to_pylist()], pa.string())

    out = common.few_rows(docs).withColumn("text", clean(docs["text"]))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda span: span["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"), count("guess"))
