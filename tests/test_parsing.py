"""The strict parser against an independent reading of the rules, and records assembled from lines."""

from hypothesis import given, settings
from hypothesis import strategies as st

from passageworks.operators import parsing
from passageworks.sources import readers


def plain(record):
    """Fields by a state machine, or None if the quoting is broken."""
    fields, at = [], 0
    while True:
        if record[at : at + 1] == '"':
            at += 1
            own = ""
            while True:
                end = record.find('"', at)
                if end < 0:
                    return None
                own += record[at:end]
                if record[end + 1 : end + 2] != '"':
                    break
                own += '"'
                at = end + 2
            at = end + 1
            if at < len(record) and record[at] != "\t":
                return None
        else:
            end = record.find("\t", at)
            end = len(record) if end < 0 else end
            own, at = record[at:end], end
        fields.append(own)
        if at >= len(record):
            return fields
        at += 1


def reason(record):
    if not record:
        return "columns"
    fields = plain(record)
    if fields is None:
        return "quoting"
    if len(fields) != 3:
        return "columns"
    number, text, _ = fields
    good = number.isascii() and number.isdigit() and len(number) <= 18 and text.strip() and not any(c == "�" or c < " " and c not in "\t\n\r" for c in text)
    return None if good else "value"


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from('1"\t\n\r a\x00\x1f�　é'), max_size=14))
def test_reasons(record):
    assert parsing.passage_of(record)[0] == reason(record)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**18 - 1), st.text(max_size=20), st.text(max_size=20))
def test_what_is_written_is_read(number, text, title):
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    why, i, got, name = parsing.passage_of(f"{number}\t{quoted(text)}\t{quoted(title)}")
    assert why == reason(f"{number}\t{quoted(text)}\t{quoted(title)}")
    if why is None:
        assert (i, got, name) == (number, text, title)


def test_table(spark):
    long = "x" * 300_000
    rows = [(1, '7\ta "b" c\t'), (2, None), (3, ""), (4, '7\t"a'), (None, "7\ta"), (6, f"7\t{long}\tT"), (6, f"7\t{long}\tT"), (8, "٣\ta\tb"), (9, '"7"\t"a\nb"\t"c"')]
    df = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "rec_no long, raw string, text string, id double")
    got = parsing.parse_passages(df).collect()
    assert sorted((r["rec_no"] or 0, r["reason"]) for r in got if r["reason"]) == [(0, "columns"), (2, "columns"), (3, "columns"), (4, "quoting"), (8, "value")]
    fine = sorted((r["rec_no"], r["id"], len(r["text"]), r["title"], r["raw"]) for r in got if not r["reason"])
    assert fine == [(1, 7, 7, "", None), (6, 7, 300_000, "T", None), (6, 7, 300_000, "T", None), (9, 7, 3, "c", None)]
    assert next(r["raw"] for r in got if r["rec_no"] == 4) == '7\t"a'
    assert parsing.parse_passages(df.limit(0)).count() == 0


def framed(spark, lines, size):
    return spark.createDataFrame([("f", i // size, i, x) for i, x in enumerate(lines)], "file string, block long, line_no long, line string")


def test_records_span_lines_and_blocks(spark):
    records = ['1\t"a\nb\n\nc"\tT', '2\tx "y\tT', '3\t"q ""\n"" z"\t"t\nu"', "4\tp\tq", '5\t"never\nends']
    lines = "\n".join(records).split("\n")
    for size in (1, 2, 3, 100):
        got = parsing.assemble_records(framed(spark, lines, size)).orderBy("line_no").collect()
        assert [r["raw"] for r in got] == records and [r["broken"] for r in got] == [False] * 4 + [True]
    assert parsing.assemble_records(framed(spark, lines, 2).limit(0)).count() == 0


def test_an_open_quote_swallows_no_rows(spark):
    fine = [f"{i}\ttext {i}\tT" for i in range(20, 40)]
    lines = ["1\ta\tA", '2\t"open', '3\t"x"\tT', "more", *fine, '50\t"two\nlines"\tT'.split("\n")[0], 'lines"\tT', "51\tlast\tT", '52\t"open too']
    expected = ["1\ta\tA", '2\t"open\n3\t"x"\tT', "more", *fine, '50\t"two\nlines"\tT', "51\tlast\tT", '52\t"open too']
    for size in (1, 2, 3, 5, 7, 100):
        got = parsing.assemble_records(framed(spark, lines, size)).orderBy("line_no").collect()
        assert [r["raw"] for r in got] == expected, size
    # a quote that nothing closes ends before the first of three proper records
    lines = ["1\ta\tA", '2\t"open', "more", *fine]
    for size in (1, 2, 4, 100):
        got = parsing.assemble_records(framed(spark, lines, size)).orderBy("line_no").collect()
        assert [r["raw"] for r in got] == ["1\ta\tA", '2\t"open\nmore', *fine] and [r["broken"] for r in got] == [False, True] + [False] * 20
    assert len(parsing.assemble_records(framed(spark, lines, 4), resync=0).collect()) == 2


def test_open_quotes_are_linear_and_bounded():
    """Forty thousand lines under one open quote, none of which is a record."""
    import time

    import pyarrow as pa

    reader = parsing._Assembler("\t", 3, 10_000)
    lines = ['1\t"open', *["x" * 100] * 40_000]
    table = pa.RecordBatch.from_pydict({"file": ["f"] * len(lines), "block": [0] * len(lines), "line_no": list(range(len(lines))), "line": lines})
    began = time.time()
    (summary,) = reader.summaries(iter([table]))
    assert summary["n"][0].as_py() == 40_001 and not summary["outside"][0].as_py() and len(summary["head"][0].as_py()) < 1_100_000
    known = reader.chain(pa.Table.from_batches([summary]))
    rest = {c: [known[c][0].as_py()] * len(lines) for c in ("skip", "ahead", "tail", "tail_ends")}
    out = [r for b in reader.records(iter([pa.RecordBatch.from_pydict(table.to_pydict() | rest)])) for r in b.to_pylist()]
    assert time.time() - began < 5
    assert out[0]["broken"] and out[0]["raw"].count("\n") == 9_999 and len(out) == 1 + 30_001


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1\ta\tb", '2\t"a', 'b"\tc', '3\t"x"\ty', "", '"', "4\tq\tr"]), max_size=14), st.integers(1, 4))
def test_blocks_do_not_matter(lines, size):
    """The records are those of one block, however the lines are split."""
    import pyarrow as pa

    def assembled(size):
        reader = parsing._Assembler("\t", 3, 10_000)
        rows = {"file": ["f"] * len(lines), "block": [i // size for i in range(len(lines))], "line_no": list(range(len(lines))), "line": lines}
        batch = pa.RecordBatch.from_pydict(rows, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("line_no", pa.int64()), ("line", pa.string())]))
        found = list(reader.summaries(iter([batch])))
        if not found:
            return []
        known = {r["__block"]: r for r in reader.chain(pa.Table.from_batches(found)).to_pylist()}
        for c in ("skip", "ahead", "tail", "tail_ends"):
            rows[c] = [known[b][c] for b in rows["block"]]
        return [(r["line_no"], r["raw"], r["broken"]) for b in reader.records(iter([pa.RecordBatch.from_pydict(rows)])) for r in b.to_pylist()]

    assert assembled(size) == assembled(100)


def test_files_are_read_in_splits(spark, tmp_path):
    records = [f'{i}\t"a ""{i}""\nb"\tT' if i % 7 == 0 else f"{i}\tplain {i}\t" for i in range(400)]
    (tmp_path / "a.tsv").write_text("id\ttext\ttitle\n" + "\n".join(records) + "\n")
    (tmp_path / "b.tsv").write_text("id\ttext\ttitle\n" + '9001\t"never closed\n' + "\n".join(records[1:7]) + "\nbad\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.load_passages(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    fine = [r for r in rows if r["reason"] is None]
    assert len({r["block"] for r in rows}) > 5
    assert sorted(r["id"] for r in fine) == sorted([*range(400), *range(1, 7)])
    assert {r["text"] for r in fine if r["id"] == 14} == {'a "14"\nb'}
    assert sorted(r["reason"] for r in rows if r["reason"]) == ["columns", "quoting"]
