"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages of a file (its lines, and the file as a whole) and the templates are
sparse TF-IDF vectors; a passage takes the license of the most similar
template from ``THRESHOLD`` on. Document frequencies are counted over the whole
corpus for the terms of the templates; a term that no template has weighs as
much as one that occurs in no document. A file that is licence text for
``FILE_SHARE`` of its words or is named like one is a licence file: it holds
for its directory and all below. Files without a notice of their own inherit
from the nearest ancestor directory that has one: distinct directories are
joined with their ancestors' paths first, then files with their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.llm.common import cut, kept_names, text_of

THRESHOLD = 0.6
FILE_SHARE = 0.25
#: License ids and the notices that state them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
#: Names of licence files, without their ending.
FILE_NAMES = ("license", "licence", "copying", "copyright", "notice", "unlicense")
WORD = re.compile(r"[A-Za-z0-9]+")


def terms(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class Matcher:
    """Cosine of a passage to each template."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], documents: int):
        self.rare = math.log(1 + documents) + 1
        self.idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for x in templates.values() for t in terms(x)}
        self.templates = []
        for name in sorted(templates):
            vector = {t: n * self.idf[t] for t, n in Counter(terms(templates[name])).items()}
            self.templates.append((name, vector, math.sqrt(sum(w * w for w in vector.values()))))

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """The highest cosine and its license, the first by name of equals; (0, None) without a common term."""
        counts = Counter(words)
        known = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        if not known:
            return 0.0, None
        other = sum((n * self.rare) ** 2 for t, n in counts.items() if t not in self.idf)
        norm = math.sqrt(sum(w * w for w in known.values()) + other)
        best, found = 0.0, None
        for name, vector, size in self.templates:
            cosine = sum(w * vector[t] for t, w in known.items() if t in vector) / (norm * size)
            if cosine > best:
                best, found = cosine, name
        return round(best, 9), found

    def file(self, text: str, threshold: float) -> tuple[float, str | None, float]:
        """Best notice of a file (score, license), and the share of its words that are notices."""
        best, found, notice, total = 0.0, None, 0, 0
        for line in text.split("\n"):
            words = terms(line)
            total += len(words)
            # A cosine from the threshold on needs common terms; most lines have few or none.
            if not any(t in self.idf for t in words):
                continue
            score, name = self.best(words)
            if score >= threshold:
                notice += len(words)
                if score > best or score == best and name < (found or name):
                    best, found = score, name
        if found is None and total:
            score, name = self.best(terms(text))
            if score >= threshold:
                return score, name, 1.0
        return best, found, notice / total if total else 0.0


def document_frequencies(files: DataFrame, text_col: str, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many rows each term of the vocabulary occurs, and the number of rows; counted over all rows."""

    def run(batches):
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.intersection(terms(text.as_py() or "")))
                rows += 1
        names = [*seen, ""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*seen.values(), rows], pa.int64())], names=["term", "n"])

    counted = files.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long")
    found = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def _directory(path: Column) -> Column:
    """Everything before the last slash; the root is the empty path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(
    files: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    path_col: str = "path",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``files``: the columns ``keep``, path, license, how, score, from_dir.

    how is ``own`` (a notice in the file), ``inherited`` (from the licence
    files of from_dir, the nearest ancestor directory that has any) or
    ``none``. Of a directory's licence files the highest score counts, then
    the first license by name. Null text is empty; a null path lies in the
    root; repeated rows are rows of their own; an empty table gives an empty
    result. A kept column with the name of a result gets underscores before it.
    """
    names = kept_names(keep, ["path", "license", "how", "score", "from_dir"])
    held = [f"keep_{i}" for i in range(len(keep))]  # beside this function's own columns
    frequency, documents = document_frequencies(files, text_col, {t for x in templates.values() for t in terms(x)})
    matcher = Matcher(templates, frequency, documents)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = files.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held, strict=True)], path.alias("path"), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [matcher.file(t.as_py(), threshold) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([s for s, _, _ in found], pa.float64()),
                    pa.array([n for _, n, _ in found], pa.string()),
                    pa.array([x for _, _, x in found], pa.float64()),
                ],
                names=[*batch.schema.names[:-1], "score", "own", "share"],
            )

    added = [T.StructField("score", T.DoubleType()), T.StructField("own", T.StringType()), T.StructField("share", T.DoubleType())]
    marked = cut(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added])).withColumn("dir", _directory(F.col("path"))))

    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    licence_files = marked.where(F.col("own").isNotNull() & ((F.col("share") >= file_share) | name.isin(*FILE_NAMES)))
    of_dir = licence_files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("best"))
    of_dir = of_dir.select(F.col("dir").alias("ancestor"), F.col("best.own").alias("license"), (-F.col("best.s")).alias("dir_score"))
    # The path up to each slash as it stands: empty segments are kept, as directories keep them.
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    above = F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = marked.select("dir").distinct().select("dir", F.explode(F.array_union(F.array(F.lit("")), above)).alias("ancestor"))
    nearest = (
        ancestors.join(of_dir, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "license", "dir_score")).alias("near"))
        .select("dir", "near.*")
    )
    out = marked.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        *[F.col(h).alias(n) for h, n in zip(held, names.values(), strict=True)],
        "path",
        F.coalesce("own", "license").alias("license"),
        F.when(own, "own").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(~own, F.col("ancestor")).alias("from_dir"),
    )
