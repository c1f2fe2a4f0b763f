"""Delimited text cut by many tasks: the same records as one pass letter by letter, over random text and every size of split."""

import random

import pytest
from pyspark.sql import functions as F

from gatedframe.errors import QueryError
from gatedframe.model import RID
from gatedframe.sources import delimited, quoted
from gatedframe.sources.delimited import detect_delimiter, load_delimited, load_delimited_table
from gatedframe.workspace import Workspace


def letter_by_letter(text, separator):
    """Records of a text by the rules, a letter at a time; blank ones left out but for the first."""
    out, record, cell, inside, at = [], [], "", False, 0
    text = text.removeprefix("﻿")
    while at < len(text):
        c, following = text[at], text[at + 1 : at + 2]
        if inside:
            if c != '"':
                cell += c
            elif following == '"':
                cell, at = cell + '"', at + 1
            else:
                inside = False
        elif c == '"' and not cell:
            inside = True
        elif c == separator:
            record, cell = [*record, cell], ""
        elif c in "\r\n":
            out.append([*record, cell])
            record, cell, at = [], "", at + (c == "\r" and following == "\n")
        else:
            cell += c
        at += 1
    if cell or record:
        out.append([*record, cell])
    return [r for i, r in enumerate(out) if i == 0 or r != [""]]


def some_text(rng, size, lines=("\n", "\n", "\r\n", "\r")):
    parts = ['"', '"', '""', ";", ";", "a", "bc", " ", "é", "𝄞", '"x;y"', '"p\nq"', '"r\r\ns"', '""""', '"un', "z" * 30, *lines]
    return "".join(rng.choice(parts) for _ in range(size))


def cut(spark, path, split, separator=";"):
    """Records of a file read in splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        files = delimited._listed(spark, path, separator, None, None)
        for f in files:
            f.look(delimited._head(spark, f.path), separator)
        units = {f.key: f.unit for f in files}
        found, kept = quoted.records(quoted.file_lines(spark, path, units), {f.key: separator for f in files}, units)
        rows = found.collect()
        begun = kept[0].count()
        for table in kept:
            table.unpersist()
        by_file = {}
        for r in sorted(rows, key=lambda r: (r.key, r.start, r.idx)):
            by_file.setdefault(r.key, []).append(r.fields)
        places = sorted((r.key, r.start, r.idx) for r in rows)
        assert len(set(places)) == len(places)
        return by_file, begun
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", range(3))
def test_many_splits_are_one_pass(spark, tmp_path, seed):
    rng, wanted = random.Random(seed), {}
    for k in range(6):
        text = some_text(rng, rng.choice([1, 5, 40, 90]), [("\n",), ("\r",), ("\n", "\n", "\r\n", "\r")][k % 3]) + rng.choice(["", "\n", '"', '"open\n', ";", '""'])
        text = rng.choice(["", "", "﻿"]) + text
        (tmp_path / f"{k:02d}.csv").write_bytes(text.encode())
        wanted[f"{k:02d}.csv"] = letter_by_letter(text, ";")
    for split in (9, 1 << 20):
        got, begun = cut(spark, str(tmp_path), split)
        assert {k.rsplit("/", 1)[-1]: v for k, v in got.items()} == {k: v for k, v in wanted.items() if v}
        assert split > 64 or begun > 6


def test_text_of_the_driver_is_one_pass(spark):
    rng = random.Random(11)
    for k in range(6):
        text = some_text(rng, 60, [("\r",), ("\n", "\r\n", "\r")][k % 2])
        found, _ = quoted.text_records(spark, "t", text.encode(), ";", "\r" if "\n" not in text else "\n")
        assert [r.fields for r in found.orderBy("start", "idx").collect()] == letter_by_letter(text, ";")


def test_one_field_over_many_splits(spark, tmp_path):
    body = "line; of the field\n" * 2000
    (tmp_path / "long.csv").write_text(f'a;b\n1;"{body}";2\n3;4\n')
    got, begun = cut(spark, str(tmp_path / "long.csv"), 512)
    assert begun > 50 and list(got.values()) == [[["a", "b"], ["1", body, "2"], ["3", "4"]]]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b'a,b\n\xff\xfe,x\n"\xc3\n",y\nplain,z\n')
    d = Workspace(spark).load_file(str(tmp_path / "odd.csv"))
    assert [tuple(r) for r in d.df.orderBy(RID).select("c0", "c1").collect()] == [("��", "x"), ("�\n", "y"), ("plain", "z")]


def test_a_blank_first_line_is_the_header(spark):
    w = Workspace(spark)
    d = w.load_text("blank.csv", "\nx\n\ny,z\n")
    assert d.names == ["column_1"] and d.row_count == 2 and d.warnings == ["1 row had too many cells and was cut."]
    assert [(w.load_text("e.csv", t).names) for t in ("", '""', "﻿")] == [[]] * 3
    assert w.load_text("e.csv", '""\n').names == ["column_1"]


def test_rows_beyond_the_limit_load_by_parameter(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,note\n" + "".join(f'{i},"n {i}\n"\n' if i % 50 == 0 else f"{i},n\n" for i in range(100_050)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        cut_short, whole = load_delimited(spark, str(path))[0], load_delimited(spark, str(path), most_rows=None)[0]
        assert (cut_short.row_count, cut_short.source_row_count) == (100_000, 100_050) and "Only the first 100,000 of 100,050" in cut_short.warnings[0]
        assert whole.row_count == 100_050 and not whole.warnings
        assert cut_short.df.agg(F.max("c0")).first()[0] == 99_999 and whole.df.where(F.col(RID) == F.col("c0")).count() == 100_050
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(QueryError) as e:
        load_delimited(spark, str(path), most_bytes=1000)
    assert e.value.code == "file_too_large"


def jobs(spark, run):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    run()
    return len(tracker.getJobIdsForGroup(None)) - before


def test_many_files_need_no_more_jobs_than_few(spark, tmp_path):
    for folder, n in (("few", 2), ("many", 40)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"f{i:03d}.csv").write_text("\n".join([["n,day", "n;day"][i % 2], *(f"{k}{[',', ';'][i % 2]}2024-01-{k + 1:02d}" for k in range(9)), "x" if i == 1 else "7"]))
    found = {}
    counts = {f: jobs(spark, lambda f=f: found.update({f: load_delimited(spark, str(tmp_path / f))})) for f in ("few", "many", "few")}
    assert counts["many"] <= counts["few"] + 8  # no job for each file; adaptive plans take some more or fewer
    many = found["many"]
    assert [d.id for d in many] == [f"f{i:03d}" for i in range(40)] and {tuple((f.name, f.type) for f in d.fields) for d in many} == {(("n", "string"), ("day", "date")), (("n", "number"), ("day", "date"))}
    assert {d.row_count for d in many} == {10} and {tuple(d.warnings) for d in many} == {("1 row had too few cells and was filled with blanks.",)}
    assert many[7].df.where("c1 is not null").count() == 9


def test_parts_of_one_table(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.range(0, 5000, 1, 4).selectExpr("id", "concat('say \"', id, '\";\\n', id % 7) AS text", "id % 3 = 0 AS third")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    d = load_delimited_table(spark, path)
    assert [(f.name, f.type) for f in d.fields] == [("id", "number"), ("text", "string"), ("third", "boolean")] and d.row_count == 5000 and not d.warnings
    assert d.df.where((F.col("c1") == F.concat(F.lit('say "'), F.col("c0").cast("int"), F.lit('";\n'), (F.col("c0") % 7).cast("int"))) & (F.col("c2") == (F.col("c0") % 3 == 0)) & (F.col(RID) == F.col("c0"))).count() == 5000
    with pytest.raises(QueryError) as e:
        load_delimited_table(spark, path, separator="ab")
    assert e.value.code == "invalid_separator"


def test_kept_tables_go_with_the_last_dataset(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("n\n1\n2\n")
    w = Workspace(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for d in w.load_files(str(tmp_path)):
        assert d.df.count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    w.clear()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_detection_looks_at_quotes_over_lines_and_lone_cr_ends_none():
    assert detect_delimiter('a,b\n"x;;;\n;;;;",y\n') == ","
    assert detect_delimiter("a;b\r" * 30 + "|" * 100) == "|"
    assert detect_delimiter("a;b\n" * 20 + "|" * 100) == ";"
    assert detect_delimiter("a\tb;c") == "\t" and detect_delimiter("") == ","


def test_quotes_that_alternate_are_cut_by_whole_batches():
    import random

    import pyarrow as pa

    from gatedframe.sources import quoted

    def cut(text, chunk, one_by_one=False):
        lines = text.split(b"\n")
        ended = lines[-1] == b""
        cutter = quoted._Cutter(quoted.grammar(";", "\n"), ("k", 0), False, True, ended)
        if one_by_one:
            cutter._alternating = lambda values: None
        lines = lines[:-1] if ended else lines
        batches = [b for k in range(0, len(lines), chunk) for b in cutter.lines(pa.array(lines[k : k + chunk], pa.binary()))]
        return [r for b in [*batches, cutter.finished()] for r in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]

    rng = random.Random(11)
    whole = b'1;"a;""b""";"x\ny"\n\n"";c\n' * 50
    assert quoted._Cutter(quoted.grammar(";", "\n"), ("k", 0), False, True, True)._alternating(pa.array(whole.split(b"\n")[:-1], pa.binary()))[0] == 200
    for text in [whole, *(bytes(rng.choice(b'"";\n\na\xc3\xa9\r') for _ in range(rng.randrange(25))) for _ in range(400))]:
        assert cut(text, 7) == cut(text, 7, True)
