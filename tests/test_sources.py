import json
import os

import pytest
from pyspark.sql import functions as F

from lakeops.sources import files as fs
from lakeops.sources import segments as sg
from lakeops.sources.flatten import Flatten, flatten
from lakeops.streaming.loads import landed_json, load_available


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 500), ("b.txt", 7)):
        (tmp_path / name).write_text("".join(f"{name}-{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = fs.numbered_lines(spark, str(tmp_path)).select("value", "line_no", fs.BLOCK).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 507 and len({r[fs.BLOCK] for r in rows}) > 3
    assert all(int(r["value"].split("-")[1]) == r["line_no"] for r in rows)


def test_skip_header_cap_and_lineage(spark, tmp_path):
    for f in ("x", "y"):
        (tmp_path / f"{f}.csv").write_text("Report\nby hand\nid,name\n" + "".join(f'{i},"{f}, {i}"\n' for i in range(1, 10)))
    df = fs.read_delimited(spark, str(tmp_path), skip_starting_rows=2, max_rows=4, file_metadata=True)
    rows = sorted((r["df_file_name"], r["df_row_number"], r["id"], r["name"]) for r in df.collect())
    assert len(rows) == 8 and rows[0] == ("x.csv", 1, "1", "x, 1") and rows[-1] == ("y.csv", 4, "4", "y, 4")


def test_union_by_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,a\n1,x\n")
    (tmp_path / "2.csv").write_text("id,b\n2,y\n")
    rows = {r["id"]: (r["a"], r["b"]) for r in fs.union_by_header(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("x", None), "2": (None, "y")}


def test_union_by_quoted_headers_behind_blank_and_comment_lines(spark, tmp_path):
    (tmp_path / "1.csv").write_text('\n# old\n"a,1",b\n"x, y",2\n\n# end\n')
    (tmp_path / "2.csv").write_text("b,c\n3,z\n4\n")
    (tmp_path / "3.csv").write_text("\n")
    df = fs.union_by_header(spark, str(tmp_path), comment_char="#")
    assert sorted(df.columns) == ["a,1", "b", "c"]
    assert sorted((r["b"], r["a,1"], r["c"]) for r in df.collect()) == [("2", "x, y", None), ("3", None, "z"), ("4", None, None)]


def test_flatten_has_no_depth_limit_unless_asked(spark):
    value = "1"
    for i in range(14):
        value = f"named_struct('k', {value})"
    df = spark.sql(f"SELECT {value} AS r")
    assert flatten(df, Flatten(root_path="r")).columns == ["_".join("k" * 14)]
    assert flatten(df, Flatten(root_path="r", max_depth=3)).columns == ["k_k_k"]


def test_flatten_nested(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', array(1, 2), 'd', 'x')) AS r, 'f' AS df_file_name")
    out = flatten(df, Flatten(root_path="r", explode_paths=("b.c",), column_mappings={"b.d": "dee"}), keep=("df_file_name",))
    assert out.columns == ["a", "b_c", "dee", "df_file_name"] and sorted(r["b_c"] for r in out.collect()) == [1, 2]


X12_BODY = "ISA*00* *00* *ZZ*ME*ZZ*YOU*030910*1059*U*00401*1*0*T*>~\n\tGS*IN*A*B*1*1*1*X*1~\n\t\tST*810*0001~\n  REF*VN*one~REF*XX*two~\nSE*3*0001~ST*850*2~BEG*00*SA*PO1~SE*2*2~GE*2*1~IEA*1*1~\n"


def check_x12(rows):
    first = sg.materialize(rows, ["ref_2", "beg_3"], sg.X12, mode="concatenate").select(
        sg.header_column("ISA", 6).alias("isa"), sg.header_column("ST", 1).alias("st"), "component", "ref_2", "beg_3", F.size("segments").alias("n")
    )
    assert sorted(map(tuple, first.collect())) == [("ME", "810", ">", "one|two", None, 2), ("ME", "850", ">", None, "PO1", 1)]


def test_x12_text_with_mark_and_indents(spark):
    check_x12(sg.parse_messages(spark.createDataFrame([("﻿" + X12_BODY,)], "body string"), "body", sg.X12))


def test_x12_file_over_many_splits(spark, tmp_path):
    (tmp_path / "m.edi").write_text("﻿" + X12_BODY, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        check_x12(sg.read_x12_files(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_edifact_release_and_una(spark):
    body = "UNA:+.? 'UNB+A+B'UNH+1+X'FTX+a?+b??+c?'d'UNT+1+1'UNZ+1+1'"
    rows = sg.parse_messages(spark.createDataFrame([(body,)], "body string"), "body", sg.EDIFACT)
    out = sg.materialize(rows, ["ftx_1", "ftx_2"], sg.EDIFACT).first()
    assert (out["ftx_1"], out["ftx_2"]) == ("a+b?", "c'd")


def test_hl7_offset_and_escapes(spark):
    body = "MSH|^~\\&|LAB|S\rPID|1||P1||LAST\\T\\NAME^A\\S\\B\rMSH|^~\\&|LAB2|S\rPID|1||P2"
    rows = sg.parse_messages(spark.createDataFrame([(body,)], "body string"), "body", sg.HL7)
    out = sg.materialize(rows, ["msh_1", "msh_3", "pid_3", "pid_5"], sg.HL7).orderBy("txn_no").collect()
    assert [(r["msh_1"], r["msh_3"], r["pid_3"], r["pid_5"]) for r in out] == [("|", "LAB", "P1", "LAST&NAME^A^B"), ("|", "LAB2", "P2", None)]


def test_stream_load_is_replay_safe(spark, tmp_path):
    land, target = tmp_path / "land", str(tmp_path / "silver")
    os.makedirs(land)
    (land / "1.json").write_text('{"k": 1, "v": 1}\n{"k": 1, "v": 2}\n{"k": 2, "v": 5}\n')
    for step in ("a", "b", "a"):  # a new query state re-reads every file
        stream = landed_json(spark, str(land), "k long, v long")
        load_available(stream, target, str(tmp_path / f"state-{step}"), ["k"], ["v"])
        (land / "2.json").write_text('{"k": 2, "v": 9}\n{"k": 3, "v": 7}\n')
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, 2), (2, 5), (3, 7)]


@pytest.mark.parametrize("text,want", [("1,234.50", 1234.5), ("x", None)])
def test_number_text(spark, text, want):
    from lakeops.operators.checks import number

    assert spark.createDataFrame([(text,)], "t string").select(number(F.col("t"))).first()[0] == want


def test_quoted_header_blank_and_comment_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# made by hand\n"a,1",b\n\n1,x\n# note\n2,y\n3,z\n4,w\n')
    df = fs.read_delimited(spark, str(tmp_path), comment_char="#", max_rows=3, file_metadata=True)
    rows = sorted((r["df_row_number"], r["a,1"], r["b"]) for r in df.collect())
    assert df.columns[:2] == ["a,1", "b"] and rows == [(1, "1", "x"), (2, "2", "y"), (3, "3", "z")]


def test_x12_files_with_different_signs(spark, tmp_path):
    (tmp_path / "a.x12").write_text(X12_BODY)
    (tmp_path / "b.x12").write_text(X12_BODY.replace("*", "|").replace("~", "!").replace("ME", "WE"))
    rows = sg.read_x12_files(spark, str(tmp_path)).select(sg.header_column("ISA", 6).alias("isa"), sg.header_column("ST", 1).alias("st"))
    assert sorted(map(tuple, rows.collect())) == [("ME", "810"), ("ME", "850"), ("WE", "810"), ("WE", "850")]


def test_hl7_files_with_different_signs(spark, tmp_path):
    (tmp_path / "a.hl7").write_text("MSH|^~\\&|A|B\rPID|1|x^y\r")
    (tmp_path / "b.hl7").write_text("MSH#$~\\&#A#B\rPID#1#x$y\r")
    rows = sg.materialize(sg.read_hl7_files(spark, str(tmp_path)), ["pid_2", "msh_1"], sg.HL7).select("component", "pid_2", "msh_1")
    assert sorted(map(tuple, rows.collect())) == [("$", "x$y", "#"), ("^", "x^y", "|")]


def test_hl7_escapes_in_one_pass(spark):
    want = {"\\E\\F\\E\\": "\\F\\", "\\F\\E\\F\\": "|E|", "a\\b": "a\\b", "\\Q\\\\T\\": "\\Q\\&", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r["c"]: r["d"] for r in rows.withColumn("d", sg.unescaped(F.col("c"))).collect()} == want


def test_edifact_signs_of_the_message(spark):
    body = "UNA:*.! ~UNB*UNOA:2*A*B~UNH*1*X~FTX*AAI***it!~s !* !!~UNT*3*1~UNZ*1*1~"
    rows = sg.parse_messages(spark.createDataFrame([(body,)], "body string"), "body", sg.EDIFACT)
    assert sg.materialize(rows, ["ftx_4"], sg.EDIFACT).first()["ftx_4"] == "it~s * !"


def small_splits(spark, size, read):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [23, 100_000])
def test_edifact_files_in_ranges_like_whole_texts(spark, tmp_path, size):
    plain = "UNB+UNOA:2+O?'NEIL ??+B'" + "".join(f"UNH+{i}+ORDERS:D'FTX+a?+{i}??+c?'d?''BGM+220+{i}??'UNT+3+{i}'" for i in range(9)) + "UNZ+9+1'"
    other = "UNA:*.! ~\nUNB*UNOA:2*A!~A*B~\nUNH*1*X:D~FTX*it!~s !* !!*'~UNT*3*1~UNZ*1*1~\n"
    texts = {"a.edi": plain, "b.edi": "\n" * 8 + other, "c.edi": "UNA:+.? '" + plain, "empty.edi": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    columns = ["df_file_name", "txn_no", sg.header_column("UNB", 2).alias("unb_2"), "ftx_1", "ftx_2", "bgm_2"]

    def shown(rows):
        out = sg.materialize(rows, ["ftx_1", "ftx_2", "bgm_2"], sg.EDIFACT).select(*columns)
        return sorted(map(tuple, out.collect()), key=str)

    whole = spark.createDataFrame([(n, t.lstrip()) for n, t in texts.items() if t], "df_file_name string, body string")
    want = shown(sg.parse_messages(whole, "body", sg.EDIFACT))
    assert len(want) == 19 and any(r[3:] == ("it~s * !", "'", None) for r in want)
    assert small_splits(spark, size, lambda: shown(sg.read_edifact_files(spark, str(tmp_path)))) == want


def test_tradacoms_files_in_ranges(spark, tmp_path):
    text = "STX=ANA:1+5000:B?'s+S'" + "".join(f"MHD={i}+INV:9'TYP=07+A?+B?'{i}'MTR=3'" for i in range(6)) + "END=6'"
    (tmp_path / "t.edi").write_text(text)
    rows = small_splits(spark, 19, lambda: sg.materialize(sg.read_tradacoms_files(spark, str(tmp_path)), ["typ_2"], sg.TRADACOMS).select("txn_no", "typ_2").collect())
    assert sorted(map(tuple, rows)) == [(i + 1, f"A+B'{i}") for i in range(6)]


def test_x12_after_blank_lines_and_without_line_ends(spark, tmp_path):
    (tmp_path / "a.x12").write_text("\n" * 25 + X12_BODY)
    (tmp_path / "b.x12").write_text(X12_BODY.replace("\n", "").replace("\t", ""))
    rows = sg.read_x12_files(spark, str(tmp_path)).select("df_file_name", sg.header_column("ST", 1).alias("st"))
    assert sorted(map(tuple, rows.collect())) == [("a.x12", "810"), ("a.x12", "850"), ("b.x12", "810"), ("b.x12", "850")]
    (tmp_path / "c.x12").write_text("no envelope here")
    with pytest.raises(Exception, match="no x12 envelope"):
        sg.read_x12_files(spark, str(tmp_path)).count()


def test_hl7_after_blank_lines(spark, tmp_path):
    (tmp_path / "a.hl7").write_text("\n\r\nMSH|^~\\&|A|B\rPID|1|x^y\r")
    rows = sg.materialize(sg.read_hl7_files(spark, str(tmp_path)), ["pid_2"], sg.HL7).select("component", "pid_2")
    assert [tuple(r) for r in rows.collect()] == [("^", "x^y")]


def test_references_are_resolved_in_their_own_bundle(spark):
    from lakeops.sources.flatten import resolve_references

    def entry(url, kind, **more):
        return {"fullUrl": url, "resource": {"resourceType": kind, **more}}

    patient, other = entry("u1", "Patient", id="p1"), entry("u1", "Patient", id="p2")
    watch = lambda url, ref: entry(url, "Observation", subject={"reference": ref})
    bundles = [
        {"id": "a", "entry": [watch("o1", "u1"), patient, watch("o2", "gone")]},
        {"id": "b", "entry": [other, watch("o3", "u1"), entry("u2", "Observation", id="x"), watch("o4", "u2")]},
        {"id": "c"},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bundles] + [(None,)], "body string")
    rows = resolve_references(df, "body", "id string, subject struct<reference: string>", "Observation", "subject.reference", "Patient")
    got = {(r["bundle_id"], r["df_full_url"], r["target"] and r["target"]["id"]) for r in rows.collect()}
    assert got == {("a", "o1", "p1"), ("a", "o2", None), ("b", "o3", "p2"), ("b", "u2", None), ("b", "o4", None)}


@pytest.mark.parametrize("kind", ["x12", "edifact", "tradacoms", "hl7"])
def test_files_in_runs_of_few_parts_like_whole_texts(spark, tmp_path, monkeypatch, kind):
    # Runs of two parts and groups of two transactions: envelopes, counts and released ends cross them.
    monkeypatch.setattr(sg, "PARTS", 1)
    monkeypatch.setattr(sg, "TRANSACTIONS", 1)
    texts = {
        "x12": ["ISA*" + "*".join(["0"] * 14) + f"*P*:~GS*PO*{f}~" + "".join(f"ST*850*{i}~BEG*{i}~SE*3*{i}~" for i in range(7)) + "GE*1~GS*IN*9~ST*810*8~SE*2*8~IEA*1~" for f in (1, 2)],
        "edifact": [f"UNA:+.? 'UNB+X+B{f}'" + "".join(f"UNH+{i}+O'FTX+a?'UNH+b??'BGM+{i}?''UNT+3'" for i in range(7)) + "UNZ+7'" for f in (1, 2)],
        "tradacoms": [f"STX=A+B{f}'" + "".join(f"MHD={i}+I'SDT=a?'MHD=b??+{i}'MTR=3'" for i in range(7)) + "END=7'" for f in (1, 2)],
        "hl7": [f"FHS|^~\\&|F{f}\r" + "".join(f"MSH|^~\\&|L{i}\rPID|{i}\r" for i in range(7)) for f in (1, 2)],
    }[kind]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
    dialect = {"x12": sg.X12, "edifact": sg.EDIFACT, "tradacoms": sg.TRADACOMS, "hl7": sg.HL7}[kind]
    read = {"x12": sg.read_x12_files, "edifact": sg.read_edifact_files, "tradacoms": sg.read_tradacoms_files, "hl7": sg.read_hl7_files}[kind]
    whole = spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(texts)], "df_file_name string, body string")

    def rows(df):
        return sorted((r["df_file_name"], r["txn_no"], json.dumps(r["header"].asDict()), [tuple(s) for s in r["segments"]]) for r in df.collect())

    if kind == "hl7":  # FHS stands before the signs that a whole text is parsed by
        assert [(r[1], json.loads(r[2])["FHS"][1]) for r in rows(read(spark, str(tmp_path)))] == [(i + 1, f"F{f}") for f in (1, 2) for i in range(7)]
    else:
        assert rows(read(spark, str(tmp_path))) == rows(sg.parse_messages(whole, "body", dialect))
