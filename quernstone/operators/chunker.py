"""Splits Markdown documents into heading-aware chunks.

`chunk` folds over a document's lines in the JVM; the fold finds boundaries, headings and fenced blocks only, and texts
are cut from the lines afterwards. `chunk_rows` is the same state machine in Python, for cross-checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_terms, trim_ws

MAX_LINES, MIN_LINES, BLANK_RUN = 120, 12, 4
_WS = r"[\t\n\f\r ]"
HEADING = rf"(?s)\A(#{{1,6}}){_WS}+(.+?){_WS}*\z"
FENCE_OPEN = rf"(?s)\A```(\w*){_WS}*\z"
FENCE_CLOSE = rf"(?s)\A```{_WS}*\z"
_HEAD = "array<struct<level:int,title:string>>"
_CODE = "array<struct<language:string,line:int,close:int>>"
_OUT = "array<struct<start_line:int,end_line:int,title:string,heading_path:array<string>>>"


def _seen(line: Column, at: Column) -> Column:
    """What the fold needs to know of a line. Most lines are told by their first character."""
    fence, heading = F.startswith(line, F.lit("```")), F.startswith(line, F.lit("#"))
    return F.struct(
        (at + 1).alias("no"),
        (fence & line.rlike(FENCE_CLOSE)).alias("shut"),
        (fence & line.rlike(FENCE_OPEN)).alias("open"),
        F.when(fence, F.regexp_extract(line, FENCE_OPEN, 1)).otherwise(F.lit("")).alias("language"),
        F.when(heading, F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0).alias("level"),
        F.when(heading, F.regexp_extract(line, HEADING, 2)).otherwise(F.lit("")).alias("title"),
        is_blank(line).alias("blank"),
    )


def _fold(max_lines: int, min_lines: int):
    def step(s: Column, x: Column) -> Column:
        inside, closing = s["in_code"], s["in_code"] & x["shut"]
        opening = ~inside & x["open"]
        heading = ~inside & ~x["open"] & (x["level"] > 0)
        plain = ~inside & ~x["open"] & (x["level"] == 0)
        run = F.when(x["blank"], s["blank"] + 1).otherwise(0)
        before = heading & (s["n"] >= min_lines)
        after = plain & ((s["n"] + 1 >= max_lines) | (run >= BLANK_RUN))
        solid = s["solid"] | ~x["blank"]
        path = F.transform(s["heads"], lambda h: h["title"])
        piece = lambda end: F.array(F.struct(s["start"].alias("start_line"), end.alias("end_line"), s["title"].alias("title"), path.alias("heading_path")))
        out = F.when(before & s["solid"], F.concat(s["out"], piece(x["no"] - 1))).when(after & solid, F.concat(s["out"], piece(x["no"]))).otherwise(s["out"])
        code = F.array(F.struct(s["language"].alias("language"), s["opened"].alias("line"), x["no"].alias("close")))
        return F.struct(
            F.when(before, x["no"]).when(after, x["no"] + 1).otherwise(s["start"]).alias("start"),
            F.when(before, F.lit(1)).when(after, F.lit(0)).otherwise(s["n"] + 1).alias("n"),
            F.when(heading | after, F.lit(0)).when(plain, run).otherwise(s["blank"]).alias("blank"),
            F.when(after, F.lit(False)).when(before, F.lit(True)).otherwise(solid).alias("solid"),
            F.when(opening, F.lit(True)).when(closing, F.lit(False)).otherwise(inside).alias("in_code"),
            F.when(opening, x["language"]).otherwise(s["language"]).alias("language"),
            F.when(opening, x["no"]).otherwise(s["opened"]).alias("opened"),
            F.when(heading, x["title"]).otherwise(s["title"]).alias("title"),
            F.when(heading, F.concat(F.filter(s["heads"], lambda h: h["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["title"].alias("title"))))).otherwise(s["heads"]).alias("heads"),
            F.when(closing, F.concat(s["codes"], code)).otherwise(s["codes"]).alias("codes"),
            out.alias("out"),
            x["no"].alias("last"),
        )

    return step


def chunk(docs: DataFrame, max_lines: int = MAX_LINES, min_lines: int = MIN_LINES) -> DataFrame:
    """Chunks of docs (doc_id, path, content): chunk_id, doc_id, path, title, heading_path, start_line, end_line, text,
    code_blocks, table_rows, has_code, terms.

    Zero limits mean the defaults. A null content counts as an empty one, which has no chunk."""
    max_lines, min_lines = max_lines or MAX_LINES, min_lines or MIN_LINES
    begin = F.struct(
        F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("blank"), F.lit(False).alias("solid"), F.lit(False).alias("in_code"), F.lit("").alias("language"), F.lit(0).alias("opened"),
        F.element_at(F.split("path", "/"), -1).alias("title"), F.array().cast(_HEAD).alias("heads"), F.array().cast(_CODE).alias("codes"), F.array().cast(_OUT).alias("out"), F.lit(0).alias("last"),
    )
    rows = docs.select("doc_id", "path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"))
    folded = rows.withColumn("s", F.aggregate(F.transform("lines", _seen), begin, _fold(max_lines, min_lines)))
    s = F.col("s")
    rest = F.array(F.struct(s["start"].alias("start_line"), s["last"].alias("end_line"), s["title"].alias("title"), F.transform(s["heads"], lambda h: h["title"]).alias("heading_path")))
    folded = folded.select("doc_id", "path", "lines", s["codes"].alias("codes"), F.when(s["in_code"], s["opened"]).alias("unclosed"), F.when((s["n"] > 0) & s["solid"], F.concat(s["out"], rest)).otherwise(s["out"]).alias("out"))
    one = folded.select("doc_id", "path", "lines", "codes", "unclosed", F.explode("out").alias("c")).select("doc_id", "path", "lines", "codes", "unclosed", "c.*")
    own = F.filter("codes", lambda c: (c["close"] >= F.col("start_line")) & (c["close"] <= F.col("end_line")))
    cut = F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    one = one.withColumns({"own": own, "cut": cut})
    coded = F.transform("own", lambda c: F.struct(c["language"].alias("language"), F.array_join(F.slice("lines", c["line"] + 1, c["close"] - c["line"] - 1), "\n").alias("code"), c["line"].alias("line")))
    cells = lambda line: F.filter(F.transform(F.split(trim_ws(line), "[|]"), trim_ws), lambda x: ~x.rlike(r"\A[-:]*\z"))
    outside = lambda r: ~F.exists("own", lambda c: (r["line"] >= c["line"]) & (r["line"] <= c["close"])) & (F.col("unclosed").isNull() | (r["line"] < F.col("unclosed")))
    numbered = F.transform("cut", lambda line, k: F.struct(line.alias("text"), (F.col("start_line") + k).alias("line")))
    barred = F.filter(numbered, lambda r: F.contains(r["text"], F.lit("|")) & F.startswith(trim_ws(r["text"]), F.lit("|")) & outside(r))
    rows = F.filter(F.transform(barred, lambda r: F.struct(cells(r["text"]).alias("cells"), r["line"].alias("line"))), lambda r: F.size(r["cells"]) > 0)
    text = trim_ws(F.array_join("cut", "\n"))
    out = one.select(F.format_string("%s:%d-%d", "doc_id", "start_line", "end_line").alias("chunk_id"), "doc_id", "path", "title", "heading_path", "start_line", "end_line", text.alias("text"), coded.alias("code_blocks"), rows.alias("table_rows"), (F.size("own") > 0).alias("has_code"))
    return out.withColumn("terms", normalize_terms(F.col("text")))


_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def chunk_rows(path: str, content: str, max_lines: int = MAX_LINES, min_lines: int = MIN_LINES) -> list[dict]:
    """The chunks of one document, without ids and terms."""
    heading, fence, shut = (re.compile(p, re.ASCII) for p in (HEADING.replace(r"\z", r"\Z"), FENCE_OPEN.replace(r"\z", r"\Z"), FENCE_CLOSE.replace(r"\z", r"\Z")))
    found, held, heads, codes, table = [], [], [], [], []
    title, start, blanks, code = path.rsplit("/", 1)[-1], 1, 0, None

    def flush(end: int) -> None:
        nonlocal held, codes, table, start
        if text := "\n".join(held).strip(_SPACES):
            found.append({"title": title, "heading_path": [t for _, t in heads], "start_line": start, "end_line": end, "text": text, "code_blocks": codes, "table_rows": table, "has_code": bool(codes)})
        held, codes, table, start = [], [], [], end + 1

    lines = content.split("\n")
    for no, line in enumerate(lines, 1):
        if code is not None:
            held.append(line)
            if shut.match(line):
                codes.append((code[0], "\n".join(code[2]), code[1]))
                code = None
            else:
                code[2].append(line)
        elif m := fence.match(line):
            held.append(line)
            code = (m[1], no, [])
        elif m := heading.match(line):
            if len(held) >= min_lines:
                flush(no - 1)
            heads = [h for h in heads if h[0] < len(m[1])] + [(len(m[1]), m[2])]
            title, blanks = m[2], 0
            held.append(line)
        else:
            bare = line.strip(_SPACES)
            if bare.startswith("|") and (cells := [c for p in bare.split("|") if (c := p.strip(_SPACES)).strip("-:")]):
                table.append((cells, no))
            blanks = 0 if bare else blanks + 1
            held.append(line)
            if len(held) >= max_lines or blanks >= BLANK_RUN:
                flush(no)
                blanks = 0
    if held:
        flush(len(lines))
    return found


def chunk_in_python(docs: DataFrame, max_lines: int = MAX_LINES, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, title, heading_path, start_line, end_line, text, has_code by chunk_rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["title", "heading_path", "start_line", "end_line", "text", "has_code"]
        for pdf in batches:
            rows = [{"doc_id": d, **{k: c[k] for k in columns}} for d, p, t in zip(pdf.doc_id, pdf.path, pdf.content, strict=True) for c in chunk_rows(p, t or "", max_lines, min_lines)]
            yield pd.DataFrame(rows, columns=["doc_id", *columns])

    return docs.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, title string, heading_path array<string>, start_line int, end_line int, text string, has_code boolean")
