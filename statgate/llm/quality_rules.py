"""Quality rules as a short-circuit cascade.

A rule rejects a document by a few measures of its whole text. Measures are
made when a rule first asks for them and kept while the document is judged, so
rules share them; the first rule that rejects ends the document's cascade, and
what only later rules would have measured is never made.

The order decides the cost, not the verdict. ``plan`` takes a bounded sample,
times every measure and test there, notes which rules reject which sampled
documents, and puts next the rule that rejects the most of what is left for
the time it adds: its test and those of its measures that no earlier rule has
made (none of the measures that are wanted for every document anyway).
"""

from __future__ import annotations

import dataclasses
import re
import time
from collections.abc import Callable, Iterator, Sequence
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statgate.llm.common import free_name, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "●", "▪", "‣")
ELLIPSES = ("...", "…")
SAMPLE_ROWS = 2000


def repeated_words(words: Sequence[str], size: int = 3) -> int:
    """How many places of ``words`` lie in a window of ``size`` words that stands at two or more places."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) > len(words) - 1:
        return 0
    windows = ids[: len(ids) - size + 1]
    for j in range(1, size):
        windows = windows * len(number) + ids[j : len(ids) - size + 1 + j]
        windows = np.unique(windows, return_inverse=True)[1]  # below the number of words again, so no product overflows
    often = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered) > 0).sum())


class Document:
    """A text and the measures made of it so far."""

    def __init__(self, text: str):
        self.text = text
        self.made: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.made:
            self.made[name] = MEASURES[name][0](self)
        return self.made[name]


def _lines(d: Document) -> list[str]:
    return [line for line in d.text.split("\n") if WORD.search(line)]


def _share_of_letters(d: Document) -> tuple[int, int]:
    upper = len(re.findall("[A-Z]", d.text))
    return upper, upper + len(re.findall("[a-z]", d.text))


#: name -> (how it is made, the measures it is made of)
MEASURES: dict[str, tuple[Callable[[Document], object], tuple[str, ...]]] = {
    "words": (lambda d: WORD.findall(d.text), ()),
    "n_words": (lambda d: len(d["words"]), ("words",)),
    "word_chars": (lambda d: sum(map(len, d["words"])), ("words",)),
    "n_symbols": (lambda d: sum(d.text.count(c) for c in SYMBOLS), ()),
    "lines": (_lines, ()),
    "n_dup_lines": (lambda d: len(d["lines"]) - len(set(d["lines"])), ("lines",)),
    "n_repeat_words": (lambda d: repeated_words(d["words"]), ("words",)),
    "n_letter_words": (lambda d: sum(1 for w in d["words"] if any(map(str.isalpha, w))), ("words",)),
    "top_word": (lambda d: max(Counter(d["words"]).values(), default=0), ("words",)),
    "n_bullet_lines": (lambda d: sum(1 for x in d["lines"] if x.lstrip("\x20\x09\x0b\x0c\r").startswith(BULLETS)), ("lines",)),
    "n_ellipsis_lines": (lambda d: sum(1 for x in d["lines"] if x.rstrip("\x20\x09\x0b\x0c\r").endswith(ELLIPSES)), ("lines",)),
    "letters": (_share_of_letters, ()),
}


@dataclasses.dataclass(frozen=True)
class Rule:
    """``rejects(document)``, and the measures it may ask for."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[[Document], bool]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda d: d["n_words"] < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda d: 100 * d["n_repeat_words"] > 50 * d["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda d: not 2 * d["n_words"] <= d["word_chars"] <= 12 * d["n_words"]),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda d: 2 * d["n_dup_lines"] > len(d["lines"])),
    Rule("letter_words", ("n_words", "n_letter_words"), lambda d: 10 * d["n_letter_words"] < 8 * d["n_words"]),
    Rule("top_word", ("n_words", "top_word"), lambda d: 4 * d["top_word"] > d["n_words"]),
    Rule("bullet_lines", ("lines", "n_bullet_lines"), lambda d: 10 * d["n_bullet_lines"] > 9 * len(d["lines"])),
    Rule("ellipsis_lines", ("lines", "n_ellipsis_lines"), lambda d: 10 * d["n_ellipsis_lines"] > 3 * len(d["lines"])),
    Rule("shouting", ("letters",), lambda d: 2 * d["letters"][0] > d["letters"][1]),
)
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _closure(names: Sequence[str]) -> list[str]:
    """``names`` and all they are made of, what others need first."""
    out: list[str] = []
    for name in names:
        for n in (*_closure(MEASURES[name][1]), name):
            if n not in out:
                out.append(n)
    return out


@dataclasses.dataclass(frozen=True)
class Estimates:
    """From the sample: seconds per document of each measure and test, and one bit a rule for each document."""

    measure_seconds: dict[str, float]
    test_seconds: dict[str, float]
    rejected: list[int]


def sample_of(rows: DataFrame, text_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts (never over twice as many), drawn alike over the whole table."""
    count = rows.count()
    share = min(1.0, sample_rows / max(1, count))
    return rows.select(text_of(f"`{text_col}`").alias("text")).sample(share, seed=7).limit(2 * sample_rows)


def estimate(sample: DataFrame, rules: Sequence[Rule] = RULES) -> Estimates:
    """Cost and selectivity of every rule, measured by the tasks that read the sample."""
    names = _closure([m for r in rules for m in r.measures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, nanos = [], []
            for text in batch.column(0).to_pylist():
                doc, spent, mask = Document(text), [], 0
                for name in names:
                    start = time.perf_counter_ns()
                    doc[name]
                    spent.append(time.perf_counter_ns() - start)
                for i, rule in enumerate(rules):
                    start = time.perf_counter_ns()
                    mask |= bool(rule.rejects(doc)) << i
                    spent.append(time.perf_counter_ns() - start)
                bits.append(mask)
                nanos.append(spent)
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(nanos, pa.list_(pa.int64()))], names=["bits", "nanos"])

    seen = sample.mapInArrow(run, "bits long, nanos array<long>").collect()  # at most twice SAMPLE_ROWS rows of numbers
    mean = np.mean([r["nanos"] for r in seen], axis=0) / 1e9 if seen else np.full(len(names) + len(rules), 1e-6)
    return Estimates(
        dict(zip(names, mean[: len(names)].tolist(), strict=True)),
        dict(zip([r.name for r in rules], mean[len(names) :].tolist(), strict=True)),
        [r["bits"] for r in seen],
    )


def plan(found: Estimates, rules: Sequence[Rule] = RULES, wanted: Sequence[str] = ()) -> list[Rule]:
    """``rules`` ordered by rejections per second among the documents that earlier rules leave.

    Measures of ``wanted`` are made for every document in any case and cost a
    rule nothing. Rules that reject nothing that is left follow by cost.
    """
    made = set(_closure(wanted))
    left = np.array(found.rejected, dtype=np.int64)
    rest = list(enumerate(rules))
    order = []
    while rest:

        def worth(item: tuple[int, Rule]) -> tuple[float, float, int]:
            i, rule = item
            cost = found.test_seconds[rule.name] + sum(found.measure_seconds[m] for m in _closure(rule.measures) if m not in made)
            return -int((left >> i & 1).sum()) / max(cost, 1e-9), cost, i

        best = min(rest, key=worth)
        rest.remove(best)
        order.append(best[1])
        made.update(_closure(best[1].measures))
        left = left[(left >> best[0] & 1) == 0]
    return order


def judge(
    rows: DataFrame,
    order: Sequence[Rule],
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    reported: Sequence[str] = REPORTED,
    base: Sequence[str] = tuple(r.name for r in BASE_RULES),
) -> DataFrame:
    """``keep``, the ``reported`` measures, ``base_failed``, ``kept``, ``rejected_by`` and ``n_tests`` of every row.

    Rules run in ``order`` up to the first that rejects; ``rejected_by`` names
    it (null if none) and ``n_tests`` counts the rules that ran, so both depend
    on the order, ``kept`` does not. ``base_failed`` holds if a rule named in
    ``base`` rejects the text, whichever rule ended its cascade.

    A null text is measured as an empty one, which has no words and fails
    ``few_words``. Long texts are measured whole, each alone. Equal texts get
    equal results, an empty table gives no rows. A kept column whose name is
    one of the results gets underscores before it.
    """
    results = [*reported, "base_failed", "kept", "rejected_by", "n_tests"]
    taken = rows.limit(0).select(*[F.lit(0).alias(c) for c in results])
    names = {c: free_name(taken, c) for c in keep}
    text = free_name(rows, "text_read")
    wanted = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], text_of(f"`{text_col}`").alias(text))
    ddl = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]]
        + [f"{m} long" for m in reported]
        + ["base_failed boolean, kept boolean, rejected_by string, n_tests int"]
    )
    base_rules = [r for r in order if r.name in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured: list[list[int]] = []
            failed, kept, by, tests = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                doc = Document(value.as_py())
                measured.append([doc[m] for m in reported])
                ran, stopped = 0, None
                for rule in order:
                    ran += 1
                    if rule.rejects(doc):
                        stopped = rule
                        break
                failed.append(any(r.rejects(doc) for r in base_rules))
                kept.append(stopped is None)
                by.append(stopped.name if stopped else None)
                tests.append(ran)
            columns = np.array(measured, dtype=np.int64).reshape(len(measured), len(reported))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(columns[:, i]) for i in range(len(reported))]
            arrays += [pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(by, pa.string()), pa.array(tests, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names.values(), *results])

    return wanted.mapInArrow(run, ddl)


def apply(
    rows: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, reported: Sequence[str] = REPORTED
) -> DataFrame:
    """``judge`` with the order that a sample of ``rows`` suggests."""
    order = plan(estimate(sample_of(rows, text_col), rules), rules, reported)
    return judge(rows, order, text_col, keep, reported)
