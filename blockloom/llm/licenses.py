"""License scans in DataFrame functions only: cosine of lines and files to templates, then inheritance along directories.

Template and text are sparse TF-IDF vectors over their terms; a file's own licence is the best template of any of its
lines or of the file as a whole. A licence file licenses its directory, and a file without a licence of its own takes that of
the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom.llm import common

THRESHOLD = 0.8
#: One notice for each licence, in this engine's own wording where the wording is free.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD three clause license",
    "ISC": "Released under the ISC License",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
#: Terms that are looked for first; where a template can be reached without them, its heaviest other terms join them.
KEY_TERMS = ("apache", "bsd", "cc", "cc0", "clause", "gnu", "isc", "license", "licensed", "mozilla", "public", "released")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda term: term != "")


class Templates:
    """Weights of the templates: tf * (ln((1 + T) / (1 + df)) + 1) over the T templates, df 0 for other terms."""

    def __init__(self, texts: dict[str, str] | None = None, threshold: float = THRESHOLD):
        cut = {name: Counter(re.findall(r"[^\W_]+", text.lower())) for name, text in sorted((texts or TEMPLATES).items())}
        df = Counter(term for counts in cut.values() for term in counts)
        self.unseen = math.log(1 + len(cut)) + 1
        self.idf = {term: math.log((1 + len(cut)) / (1 + n)) + 1 for term, n in sorted(df.items())}
        self.unit: dict[str, dict[str, float]] = {}
        for name, counts in cut.items():
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in counts.items()))
            self.unit[name] = {t: n * self.idf[t] / norm for t, n in sorted(counts.items())}
        keys = set(KEY_TERMS)
        for unit in self.unit.values():
            # What the other terms can give at most is their share of the template's length.
            others = sorted(((w, t) for t, w in unit.items() if t not in keys))
            while others and math.sqrt(sum(w * w for w, _ in others)) >= threshold:
                keys.add(others.pop()[1])
        self.key_terms = sorted(keys & set(self.idf))

    def may_match(self, lowered: Column) -> Column:
        """False where a text in small letters cannot reach the threshold."""
        found = lowered.contains(self.key_terms[0])
        for term in self.key_terms[1:]:
            found = found | lowered.contains(term)
        return found

    def best(self, found: Column) -> Column:
        """(score, name) of the best template for an array of terms; of equal scores the first name. Null without terms."""
        idf = F.create_map(*[F.lit(v) for pair in self.idf.items() for v in pair])
        weights = {name: F.create_map(*[F.lit(v) for pair in unit.items() for v in pair]) for name, unit in self.unit.items()}

        def total(column: Column, value) -> Column:
            return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + value(x))

        def weight(term: Column) -> Column:
            return F.coalesce(F.try_element_at(idf, term), F.lit(self.unseen))

        def step(state: Column, term: Column) -> Column:
            same, part = state["term"] == term, state["n"] * weight(state["term"])
            return F.struct(term.alias("term"), F.when(same, state["n"] + 1).otherwise(F.lit(1.0)).alias("n"),
                            F.when(same, state["sum"]).otherwise(state["sum"] + part * part).alias("sum"))

        # The norm runs over the sorted terms, adding a term's weight where its run ends.
        start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
        norm = F.sqrt(F.aggregate(F.sort_array(found), start, step, lambda s: s["sum"] + (s["n"] * weight(s["term"])) * (s["n"] * weight(s["term"]))))
        known = F.transform(F.array_sort(F.array_intersect(found, F.array(*[F.lit(t) for t in self.idf]))), lambda t: F.struct(
            t.alias("t"), (F.size(F.filter(found, lambda u: u == t)) * weight(t)).alias("w")))

        def ranked(bound: Column) -> Column:
            dots = [F.struct((total(bound["known"], lambda e, m=m: e["w"] * F.coalesce(F.try_element_at(m, e["t"]), F.lit(0.0))) / bound["norm"]).alias("score"),
                             F.lit(-place).alias("place"), F.lit(name).alias("name")) for place, (name, m) in enumerate(weights.items())]
            return F.array_max(F.array(*dots))

        # Bound to a variable, so that terms and norm are computed once for all templates.
        bound = F.array(F.struct(known.alias("known"), norm.alias("norm")))
        return F.when(F.size(found) > 0, F.get(F.transform(bound, ranked), 0))


def own_licences(files: DataFrame, templates: Templates, threshold: float = THRESHOLD) -> DataFrame:
    """Adds own_license, own_score, and first_line (the notice is the first line that has a term): whole texts, no shuffle.

    A line without any key term cannot reach the threshold, so only the others are cut into terms and scored; a file that
    is a notice over several lines is scored as a whole when it has no more terms than four times the longest template.
    """
    longest = 4 * max(len(unit) for unit in templates.unit.values())
    none, empty = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    out = files.withColumn("__low", F.lower(F.coalesce("text", F.lit(""))))
    out = out.withColumn("__lines", F.when(templates.may_match(F.col("__low")), F.split("__low", "\n")))
    out = out.withColumn("__near", F.coalesce(F.transform(F.filter("__lines", templates.may_match), terms), none))
    # The first line with a term, and all terms, matter only where some line may match.
    some = F.size("__near") > 0
    out = out.withColumn("__first", F.when(some, terms(F.get(F.filter("__lines", lambda line: line.rlike(r"[\p{L}\p{N}]")), 0))))
    out = out.withColumn("__all", F.when(some, terms(F.col("__low"))).otherwise(empty))
    units = F.concat("__near", F.when((F.size("__all") > 0) & (F.size("__all") <= longest), F.array("__all")).otherwise(none))
    scored = F.filter(F.transform(F.array_distinct(units), lambda unit: F.struct(templates.best(unit).alias("b"), (unit == F.col("__first")).alias("first"))),
                      lambda s: F.coalesce(s["b"]["score"] >= threshold, F.lit(False)))
    out = out.withColumn("__scored", scored)
    best = F.array_max(F.transform("__scored", lambda s: s["b"]))
    return out.select(*[F.col(c) for c in files.columns], best["name"].alias("own_license"), best["score"].alias("own_score"),
                      F.exists("__scored", lambda s: s["first"]).alias("first_line"))


def directory_licences(files: DataFrame) -> DataFrame:
    """The licence of each directory that holds licence files: the most frequent one, of equal ones the first name."""
    votes = files.where("is_license_file AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    return votes.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("n"), "own_license")).alias("license"))


def nearest(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """For each directory the licence of the nearest licensed directory at or above it: dir, license, from_dir."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    steps = dirs.select("dir", F.inline(above))
    found = steps.join(licensed.select(F.col("dir").alias("up"), "license"), "up")
    return found.groupBy("dir").agg(F.max_by("license", "depth").alias("license"), F.max_by("up", "depth").alias("from_dir"))


def scan(files: DataFrame, key: str = "doc_id", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: key, path, license, origin (own, inherited or null), from_dir, score (own licences, six digits).

    ``files`` has the key, ``dir``, ``text`` and ``names_license`` (the file's name or place marks it as a licence file if its first line
    is a notice). Null and empty texts have no licence of their own; a null directory inherits nothing and licenses nothing; repeated rows stay
    and vote again; other columns are not read; an empty table gives an empty one. Texts are read once, the small
    results are staged. Only different directories take part in the path join; a directory with a third of all files
    is pre-aggregated and, in the last join, broadcast or split by the adaptive skew join.
    """
    compiled = Templates(templates, threshold)
    own = own_licences(files.select(key, "dir", "names_license", "text"), compiled, threshold).drop("text")
    own = common.staged(own.withColumn("is_license_file", F.coalesce("names_license", F.lit(False)) & F.col("first_line")).drop("names_license", "first_line"), "licences")
    inherited = nearest(own.select("dir").distinct(), directory_licences(own))
    out = own.join(inherited, "dir", "left")
    has = F.col("own_license").isNotNull()
    return out.select(
        key, "dir", F.coalesce("own_license", "license").alias("license"),
        F.when(has, F.lit("own")).when(F.col("license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"), F.round("own_score", 6).alias("score"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/thousand of the id, notes of up to 50 blanks one level up; an opening notice makes a licence file."""
    short = F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), " ", "")) <= 50
    base = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return docs.select("doc_id", F.when(short, base).otherwise(F.concat(base, F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"))).alias("dir"),
                       F.lit(True).alias("names_license"), "text")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(common.table(spark, sf_dir, "documents")))


def _sql() -> str:
    compiled = Templates()
    idf = ", ".join(f"('{t}', {v!r})" for t, v in compiled.idf.items())
    unit = ", ".join(f"('{name}', '{t}', {w!r})" for name, ws in compiled.unit.items() for t, w in ws.items())
    longest = 4 * max(len(ws) for ws in compiled.unit.values())
    return rf"""
WITH idf(t, v) AS (VALUES {idf}), tpl(name, t, w) AS (VALUES {unit}),
f AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') ||
  CASE WHEN length(text) - length(replace(text, ' ', '')) <= 50 THEN '' ELSE '/' || CAST(doc_id // 1000 AS VARCHAR) END AS dir,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda l: list_filter(regexp_split_to_array(lower(l), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')), lambda l: len(l) > 0) AS lines FROM documents),
u AS (SELECT doc_id, dir, k, lines[k] AS terms FROM (SELECT doc_id, dir, lines, unnest(range(1, len(lines) + 1)) AS k FROM f)
  UNION ALL SELECT doc_id, dir, 0, flatten(lines) FROM f WHERE list_sum(list_transform(lines, lambda l: len(l))) <= {longest}),
cand AS (SELECT *, row_number() OVER () AS unit FROM u WHERE list_has_any(terms, [{', '.join(f"'{t}'" for t in compiled.key_terms)}])),
tf AS (SELECT unit, t, count(*) AS n FROM (SELECT unit, unnest(terms) AS t FROM cand) GROUP BY ALL),
w AS (SELECT unit, tf.t, n * coalesce(v, {compiled.unseen!r}) AS w FROM tf LEFT JOIN idf ON tf.t = idf.t),
norm AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
score AS (SELECT unit, name, sum(w.w * tpl.w) / any_value(norm) AS score FROM w JOIN tpl ON w.t = tpl.t JOIN norm USING (unit) GROUP BY unit, name),
best AS (SELECT unit, name, score FROM score WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round(score, 12) DESC, name) = 1),
hit AS (SELECT doc_id, dir, k, name, score, terms FROM cand JOIN best USING (unit)),
own AS (SELECT doc_id, name AS own, score FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, name) = 1),
file AS (SELECT f.doc_id, dir, own, score, EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = f.doc_id AND hit.terms = f.lines[1]) AS is_file FROM f LEFT JOIN own USING (doc_id)),
votes AS (SELECT dir, own, count(*) AS n FROM file WHERE is_file GROUP BY ALL),
lic AS (SELECT dir, own FROM votes QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own) = 1),
up AS (SELECT dir, n, array_to_string(string_split(dir, '/')[1:n], '/') AS up FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM file))),
near AS (SELECT up.dir, lic.own AS license, up.up AS from_dir FROM up JOIN lic ON up.up = lic.dir QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY n DESC) = 1)
SELECT doc_id, file.dir, coalesce(own, license) AS license, CASE WHEN own IS NOT NULL THEN 'own' WHEN license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own IS NULL THEN from_dir END AS from_dir, round(score, 6) AS score FROM file LEFT JOIN near ON file.dir = near.dir
"""


SQL = _sql()
