"""Split CSV files with quoted newlines, headers of many files, listings."""

import csv
import io
import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statgate.operators import quality as Q
from statgate.sources import csv_files as C
from statgate.sources import readers as S

CELLS = ["", "a", "plain text", "with,comma", 'with "quote"', "line\nbreak", "two\n\nbreaks", "\n", '"', "crlf\r\nin", "back\\slash", " sp ", "é😀", "x" * 50]


@pytest.fixture
def small_splits(spark):
    """Splits of 700 bytes, so that a small file is read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def as_text(rows, eol="\n", blank_every=0):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=eol)
    for i, r in enumerate(rows):
        w.writerow(r)
        if blank_every and i % blank_every == 1:
            out.write(eol)
    return out.getvalue()


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_a_file_with_quoted_newlines_is_read_by_many_tasks(spark, small_splits, eol):
    rnd = random.Random(4)
    rows = [[rnd.choice(CELLS) for _ in range(4)] for _ in range(400)]
    path = write(tempfile.mkdtemp(), "f.csv", as_text([["k\nx", "v", "w", "z"], *rows], eol, 17))
    assert C._lines(spark, path).rdd.getNumPartitions() > 20
    got = S.read_csv(spark, path)
    assert got.columns == ["k\nx", "v", "w", "z", "__malformed", "__file", "__row"]
    found = sorted((r["__row"], [c or "" for c in r[:4]], r["__malformed"]) for r in got.collect())
    with open(path, newline="", encoding="utf-8") as f:
        expected = [(i + 2, list(r.values()), None) for i, r in enumerate(csv.DictReader(f))]
    assert found == expected and len(expected) == 400


def test_a_record_longer_than_a_split_keeps_whole(spark, small_splits):
    long = "\n".join(f"line {i}" for i in range(900))
    path = write(tempfile.mkdtemp(), "f.csv", as_text([["a", "b"], ["1", long], ["2", "x"]]))
    got = {r["__row"]: (r.a, r.b) for r in S.read_csv(spark, path).collect()}
    assert got == {2: ("1", long), 3: ("2", "x")}


def test_quotes_that_never_close_gather_nothing(spark, small_splits):
    tail = "".join(f"{i},y\n" for i in range(500))
    path = write(tempfile.mkdtemp(), "f.csv", 'a,b\n1,x\n2,"open\n' + tail)
    got = S.read_csv(spark, path).collect()
    assert [(r.a, r.b) for r in got if r["__row"] == 2] == [("1", "x")]
    bad = [r for r in got if r["__row"] == 3]
    assert len(bad) == 501 and all(r["__malformed"] is not None and r.a is None for r in bad)


def test_files_of_other_headers_and_of_none(spark):
    d = tempfile.mkdtemp()
    paths = [write(d, "a.csv", "p,q\n1,2\n"), write(d, "b.csv", "q,p\n3,4\n5\n"), write(d, "empty.csv", ""), write(d, "blank.csv", "\na,b\n1,2\n"),
             write(d, "bom.csv", "﻿p,q\n6,7"), write(d, "only header.csv", "p,q")]
    rows = S.read_csv(spark, paths).collect()
    assert sorted((os.path.basename(r["__file"]), r["__row"], r.p, r.q, r["__malformed"]) for r in rows) == [
        ("a.csv", 2, "1", "2", None), ("b.csv", 2, "4", "3", None), ("b.csv", 3, None, "5", "5"), ("bom.csv", 2, "6", "7", None)]
    header = S.csv_header_table(spark, paths)
    names = {}
    for r in header.collect():
        names.setdefault(os.path.basename(r.file), []).append((r.ord, r.name))
    assert names["empty.csv"] == names["blank.csv"] == [(None, None)] and sorted(names["only%20header.csv"]) == [(1, "p"), (2, "q")]
    told = Q.quality_verdict(S.read_csv(spark, paths), header, value_column="q").collect()
    assert sorted(os.path.basename(r.file) for r in told if r.message == "CSV has no header row") == ["blank.csv", "empty.csv"]
    assert S.read_csv(spark, paths[2]).collect() == []


def test_headers_of_ten_thousand_files_without_their_bodies(spark):
    d = tempfile.mkdtemp()
    for i in range(10_000):
        write(d, f"{i}.csv", f'a,"b\n{i % 3}"\n')
    reader = C.HeaderReader({"paths": "[]", "filespertask": "256"})
    assert len(reader.partitions()) == 1
    headers = C.csv_headers(spark, d, files_per_task=500)
    assert headers.rdd.getNumPartitions() == 20
    assert {tuple(r.names): r["count"] for r in headers.groupBy("names").count().collect()} == {("a", "b\n0"): 3334, ("a", "b\n1"): 3333, ("a", "b\n2"): 3333}


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_the_first_record_reads_no_more_than_it_needs():
    stream = Counting(b'a,"b\n c"\r\n' + b"x" * 10_000_000)
    assert C.first_record(stream, 64) == 'a,"b\n c"' and stream.taken == 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CELLS), min_size=1, max_size=4), min_size=1, max_size=4), st.integers(1, 9), st.sampled_from(["\n", "\r\n"]))
def test_first_record_is_the_first_row_of_csv(rows, chunk, eol):
    text = as_text(rows, eol)
    assert C.record_names(C.first_record(io.BytesIO(text.encode()), chunk)) == next(csv.reader(io.StringIO(text, newline="")))


def test_headers_through_the_text_source_are_the_same(spark, monkeypatch):
    d = tempfile.mkdtemp()
    paths = [write(d, "a.csv", 'p,"q\nr"\n1,2\n'), write(d, "empty.csv", ""), write(d, "b.csv", "x")]
    opened = {r.file: r.names for r in C.csv_headers(spark, paths).collect()}
    monkeypatch.setattr(C, "OPENABLE", ())
    assert {r.file: r.names for r in C.csv_headers(spark, paths).collect()} == opened


def test_a_listing_holds_the_immediate_children_only(spark):
    root = os.path.join(tempfile.mkdtemp(), "in")
    for p in ("a.csv", "sub/b.csv", "sub/in/deep.csv", "x=1/c.csv"):
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        write(root, p, "abc")
    listed = S.list_objects(spark, root + "/")
    assert [(os.path.basename(r.path), r.size) for r in listed.collect()] == [("a.csv", 3)]
    assert S.list_objects(spark, root, recursive=True).agg(F.count("*")).first()[0] == 4
    empty = tempfile.mkdtemp()
    assert S.list_objects(spark, empty).collect() == []
