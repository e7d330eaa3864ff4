"""Rows that fail to parse, set apart with the reason, beside the rows that load.

Method: records are assembled quote-aware from lines, each is parsed by
Python's strict ``csv`` reader inside a partition, and structural exceptions
are caught before the typed constructors of the fields see anything.
"""

from __future__ import annotations

import csv
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from passageworks.session import cut_lineage

#: What a passage's text may not contain, and the form of its id.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd]")
_ID = re.compile(r"[0-9]{1,18}")
_STAND_INS = [chr(x) for x in range(0xE000, 0xE100)]


def parse_fields(record: str, separator: str = "\t") -> list[str]:
    """Fields of one record; ``csv.Error`` if its quoting is broken."""
    return _fields(record, {"delimiter": separator, "quotechar": '"', "doublequote": True, "strict": True})


def _fields(record: str, how: dict) -> list[str]:
    """Line breaks are content here, since the record's own end is already gone; the reader would end a row at them, so unused characters stand in."""
    back: dict[int, str] = {}
    if "\n" in record or "\r" in record:
        free = (x for x in _STAND_INS if x not in record)
        for x in "\r\n":
            back[ord(stand := next(free, None) or _unused(record))] = x
            record = record.replace(x, stand)
    rows = list(csv.reader([record], **how))
    fields = rows[0] if rows else []
    return [x.translate(back) for x in fields] if back else fields


def _unused(record: str) -> str:
    seen = set(record)
    return next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in seen)


def passage_of(record: str | None) -> tuple[str | None, int | None, str | None, str | None]:
    """(reason, id, text, title) of a ``psgs_w100`` record; the reason is None for a proper row."""
    if not record:
        return "columns", None, None, None
    try:
        fields = parse_fields(record)
    except csv.Error:
        return "quoting", None, None, None
    if len(fields) != 3:
        return "columns", None, None, None
    number, text, title = fields
    if not _ID.fullmatch(number) or not text or text.isspace() or _FORBIDDEN.search(text):
        return "value", None, None, None
    return None, int(number), text, title


def parse_passages(df: DataFrame, key: str | list[str] = "rec_no", raw: str = "raw") -> DataFrame:
    """Every row of ``df`` once: its key columns, ``reason``, ``id bigint``, ``text``, ``title`` and, for
    a row that fails, ``raw`` as it came.

    ``reason`` is null for a proper row, else the first that applies:
    ``quoting``, ``columns`` (also null and empty records) or ``value``.
    Repeated rows each keep theirs, null keys stay null, a record may be of any
    length; columns of ``df`` that are not keys are left out whatever their
    names.  One scan and one Arrow pass, no shuffle: split the result by
    ``reason``, or write it partitioned by it.
    """
    keys = [key] if isinstance(key, str) else key
    fields = [("reason", T.StringType()), ("id", T.LongType()), ("text", T.StringType()), ("title", T.StringType()), ("raw", T.StringType())]
    clash = {n for n, _ in fields} & set(keys)
    if clash:
        raise ValueError(f"key columns may not be named {sorted(clash)}")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(*f) for f in fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            records = batch.column(n).to_pylist()
            parsed = [passage_of(x) for x in records]
            columns = [pa.array([p[i] for p in parsed], to_arrow_type(kind)) for i, (_, kind) in enumerate(fields[:4])]
            failed = pa.array([x if p[0] else None for x, p in zip(records, parsed)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns, failed], schema.names)

    return df.select(*keys, F.col(raw).cast("string").alias("__raw")).mapInArrow(run, schema)


def split_fields(df: DataFrame, names: list[str], raw: str = "raw", separator: str = "\t") -> DataFrame:
    """One string column per name from each record, read leniently: missing fields are null, surplus ones dropped.

    An empty field is an empty text.  Null and empty records give no row; other
    columns are left out.
    """
    lenient = {"delimiter": separator, "quotechar": '"', "doublequote": True, "strict": False}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            rows = [_fields(x, lenient) for x in batch.column(0).to_pylist() if x]
            columns = [pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(raw).cast("string").alias("__raw")).mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: A quote is taken as never closed where so many lines in a row are proper records by themselves.
RESYNC_LINES = 3
#: A record may have so many lines; beyond that its quote is taken as never closed.
LONGEST_RECORD = 10_000
#: What is known of all blocks is broadcast up to this size, else joined.
BROADCAST_CHARS = 64_000_000


def assemble_records(
    lines: DataFrame, file: str = "file", block: str = "block", number: str = "line_no", line: str = "line", separator: str = "\t", resync: int = RESYNC_LINES, longest: int = LONGEST_RECORD, ordered: bool = False
) -> DataFrame:
    """Records of ``lines``, which hold one physical line each: ``file``, ``block`` and ``line_no`` of its
    first line, ``raw``, and ``broken``, true if its quoted field never ends.

    A quoted field may span lines.  Whether a line begins inside quotes depends
    on every line before it, so each block of a file is read once for both
    beginnings.  What that tells is one small row per block: its ending state
    for either, and the lines that end a record begun before it.  These rows
    are chained over the blocks of a file, and then every block assembles its
    own records from its known state; the last takes its end from the chain.

    A quote that is never closed must not swallow the rows after it: inside
    quotes, ``resync`` lines in a row that are proper records by themselves
    (digits and two more fields) end the open record before the first of them,
    and it is ``broken``.  A quoted text that really holds such lines is cut
    there; ``resync=0`` turns this off.  A record of more than ``longest``
    lines is cut and ``broken`` as well, so that none grows without bound; one
    that crosses blocks may have twice as many.

    Blocks are any split of a file in line order; a null line counts as empty;
    an empty table gives an empty table.  ``ordered`` says that the lines of a
    block already lie together and in order, as a scan of files gives them:
    then no line is shuffled.  One job runs while the query is built; it
    writes the small rows to the shared folder.
    """
    rows = lines.select(F.col(file).cast("string").alias("file"), F.col(block).cast("long").alias("block"), F.col(number).cast("long").alias("line_no"), F.coalesce(F.col(line).cast("string"), F.lit("")).alias("line"))
    # sorts below a join are dropped by the optimizer, so that each pass sorts for itself
    in_order = lambda df: df if ordered else df.sortWithinPartitions("file", "block", "line_no")
    if not ordered:
        rows = rows.repartition("file", "block")
    reader = _Assembler(separator, resync, longest)
    ends = in_order(rows).mapInArrow(reader.summaries, "file string, block long, outside boolean, inside boolean, n long, lead int, trail int, head string, head_lines long, head_ends string")
    known = ends.groupBy("file").applyInArrow(lambda t: reader.chain(t), "__file string, __block long, skip long, ahead int, tail string, tail_ends boolean")
    known = cut_lineage(known)
    size = known.agg(F.count("*") * 64 + F.coalesce(F.sum(F.length("tail")), F.lit(0))).first()[0]
    condition = rows["file"].eqNullSafe(known["__file"]) & (rows["block"] == known["__block"])
    if size <= BROADCAST_CHARS:
        joined = in_order(rows.join(F.broadcast(known), condition))
    else:
        joined = rows.join(known, condition).repartition("file", "block").sortWithinPartitions("file", "block", "line_no")
    return joined.drop("__file", "__block").mapInArrow(reader.records, "file string, block long, line_no long, raw string, broken boolean")


class _Assembler:
    """The three passes of :func:`assemble_records`."""

    def __init__(self, separator: str, resync: int, longest: int):
        self.separator, self.resync, self.longest = separator, resync, longest
        gap = re.escape(separator)
        field = rf'(?:"(?:[^"]|"")*"|[^"{gap}][^{gap}]*|)'
        self._alone = re.compile(rf"[0-9]{{1,18}}{gap}{field}{gap}{field}\r?")

    def alone(self, line: str) -> bool:
        """Whether a line is a proper record by itself."""
        return self.resync > 0 and self._alone.fullmatch(line) is not None

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        return groupby(rows, key=lambda r: r[:2])

    def looked_ahead(self, rows: Iterator[tuple], ahead: int) -> Iterator[tuple[tuple, Callable[[], bool]]]:
        """Every row, and a function that tells whether ``resync`` proper records begin at it; ``ahead`` of them follow the last row."""
        window: deque = deque()

        def run(missing: int) -> bool:
            for item in window:
                if item[1] is None:
                    item[1] = self.alone(item[0][3])
                if not item[1]:
                    return False
            return self.resync > 0 and ahead >= missing

        for row in rows:
            window.append([row, None])
            if len(window) >= max(self.resync, 1):
                yield window[0][0], lambda: run(0)
                window.popleft()
        while window:
            yield window[0][0], lambda: run(self.resync - len(window))
            window.popleft()

    def summaries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), rows in self.blocks(batches):
            states, open_lines = [False, True], [0, 0]  # after the lines so far, if the block begins outside or inside quotes
            head, ends, head_lines, n, lead, last = [], "open", 0, 0, 0, deque(maxlen=max(self.resync, 1))
            for row, starts in self.looked_ahead(rows, 0):
                line = row[3]
                if n == lead < self.resync and self.alone(line):
                    lead += 1
                n += 1
                last.append(line)
                if ends == "open":
                    if starts():
                        ends, head_lines = "broken", n - 1
                    else:
                        head.append(line)
                both = states[0] == states[1] and open_lines[0] == open_lines[1]
                for i in (0,) if both else (0, 1):
                    if states[i] and (open_lines[i] >= self.longest or starts()):
                        states[i] = False
                    states[i] = inside_after(line, states[i], self.separator)
                    open_lines[i] = open_lines[i] + 1 if states[i] else 0
                if both:
                    states[1], open_lines[1] = states[0], open_lines[0]
                if ends == "open" and not states[1]:
                    ends, head_lines = "closed", n
                elif ends == "open" and len(head) >= self.longest:
                    ends, head_lines, states[1], open_lines[1] = "broken", n, False, 0
            trail = 0
            for line in reversed(last):
                if not self.alone(line):
                    break
                trail += 1
            row = (file, block, *states, n, lead, trail, "\n".join(head), n if ends == "open" else head_lines, ends)
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())
            names = ["file", "block", "outside", "inside", "n", "lead", "trail", "head", "head_lines", "head_ends"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def chain(self, table: pa.Table) -> pa.Table:
        blocks = table.sort_by("block").to_pylist()
        count = len(blocks)
        # proper records that follow a block's last line
        ahead = [0] * (count + 1)
        for i in range(count - 1, -1, -1):
            b = blocks[i]
            ahead[i] = b["lead"] + (ahead[i + 1] if b["lead"] == b["n"] else 0)
        inside, open_lines, skips, pieces, open_at_end = False, 0, [], [], []
        for i, b in enumerate(blocks):
            run = 0 < b["trail"] and 0 < self.resync <= b["trail"] + ahead[i + 1]  # the block ends with records for certain
            piece = None
            if not inside:
                skip, end, open_lines = 0, b["outside"] and not run, 0
            elif run and b["head_lines"] > b["n"] - b["trail"]:
                skip, end, open_lines = b["n"] - b["trail"], False, 0
                own = b["head"].split("\n")[: b["n"] - b["trail"]]
                piece = ("\n".join(own) if own else None, "broken")
            elif b["head_ends"] != "open":
                skip, end, open_lines = b["head_lines"], b["inside"] and not run, 0
                piece = (b["head"] if b["head_lines"] else None, b["head_ends"])
            else:
                open_lines += b["n"]
                end, skip = open_lines <= self.longest, b["n"]
                piece = (b["head"], "open" if end else "broken")
            skips.append(skip)
            pieces.append(piece)
            open_at_end.append(end)
            inside = end
        tails = []
        for i in range(count):
            parts, ends, j = [], None, i + 1
            # only where a record begins in this block and is open at its end
            while open_at_end[i] and skips[i] < blocks[i]["n"] and j < count and ends is None:
                text, how = pieces[j]
                parts += [] if text is None else [text]
                ends = None if how == "open" else how
                j += 1
            tails.append(("\n".join(parts) if parts else None, ends == "closed"))
        columns = ([b["file"] for b in blocks], [b["block"] for b in blocks], skips, ahead[1:], [t for t, _ in tails], [e for _, e in tails])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["__file", "__block", "skip", "ahead", "tail", "tail_ends"])

    def records(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for (file, block), rows in self.blocks(batches):
            first = next(rows)
            _, _, _, _, skip, ahead, tail, tail_ends = first
            own, begin, inside = [], 0, False
            for i, (row, starts) in enumerate(self.looked_ahead(chain([first], rows), ahead)):
                if i < skip:
                    continue
                if inside and (len(own) >= self.longest or starts()):
                    out.append((file, block, begin, "\n".join(own), True))
                    own, inside = [], False
                if not own:
                    begin = row[2]
                own.append(row[3])
                chars += len(row[3])
                inside = inside_after(row[3], inside, self.separator)
                if not inside:
                    out.append((file, block, begin, "\n".join(own), False))
                    own = []
                    if chars > 4_000_000:
                        yield self._batch(out)
                        out, chars = [], 0
            if own:
                out.append((file, block, begin, "\n".join(own if tail is None else [*own, tail]), not tail_ends))
        if out:
            yield self._batch(out)

    @staticmethod
    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["file", "block", "line_no", "raw", "broken"])


def inside_after(line: str, inside: bool, separator: str = "\t") -> bool:
    """Whether a quoted field is still open after ``line``."""
    if '"' not in line:
        return inside
    at, fresh = 0, not inside
    while True:
        if fresh and not inside:
            if line[at : at + 1] == '"':
                inside, at = True, at + 1
            fresh = False
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            if line[close + 1 : close + 2] == '"':
                at = close + 2
                continue
            inside, at = False, close + 1
        cut = line.find(separator, at)
        if cut < 0:
            return False
        at, fresh = cut + 1, True
