"""A sink that replaces one file as a whole, and the exports written with it: CSV, JSON, reports and a region of a page.

    spark.dataSource.register(OneFile)
    lines.orderBy("place").select("line").write.format("onefile").mode("overwrite").option("path", path).save()

Tasks write parts beside the file, each under a name of its own try; the driver joins the parts of the tries that were committed, in order of partitions, in blocks of bounded size, and renames the result over
the file. A lost task is tried again, a failed write leaves the former file and removes its parts. The folder must be one that driver and executors share: any address that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import text as X
from ..functions.canonical import indented_json

BLOCK, TAIL = 1 << 20, 64
BOM = "\ufeff"
#: The columns of the CSV export, as name in the file and column of the events.
CSV_COLUMNS = {
    "대회명": "title", "출처": "source_name", "접수시작일": "registration_start", "접수마감일": "deadline", "접수기간 원문": "registration_text", "대회시작일": "event_start", "대회종료일": "event_end", "일정안내": "schedule_text",
    "주최기관": "organizer", "참가대상": "eligibility", "혜택": "benefits", "주제": "summary", "안내사이트": "website_url", "신청링크": "application_url", "상태": "status_label", "공고원문": "url", "상세확인일": "detail_checked_at",
    "접수시작시각": "registration_start_time", "접수마감시각": "deadline_time",
}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def refuse_broken(path: str, begins: str, ends: str) -> None:
    """Raise ValueError where there is a file that does not begin and end as its kind does: what it was meant to hold is not to be lost by replacing it."""
    files, name = located(path)
    info = files.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        return
    if info.type != pafs.FileType.File:
        raise ValueError(f"{path} is no file")
    with files.open_input_file(name) as stream:
        head = stream.read_at(len(begins.encode()), 0)
        tail = stream.read_at(min(TAIL, info.size), max(0, info.size - TAIL))
    if head != begins.encode() or not tail.endswith(ends.encode()):
        raise ValueError(f"{path} is broken: it is kept, and nothing is written")


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    lines: int


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.foot = options["path"], options.get("head", ""), options.get("foot", "")
        self.between, self.begins, self.ends = options.get("between", "\n"), options.get("begins"), options.get("ends", "")
        self.folder = f"{located(self.path)[1]}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, _ = located(self.path)
        files.create_dir(self.folder, recursive=True)
        part = Part(TaskContext.get().partitionId(), f"{self.folder}/{uuid.uuid4().hex}", 0)
        between = self.between.encode()
        with files.open_output_stream(part.name) as out:
            for batch in iterator:
                for line in batch.column(0):  # null lines are left out
                    if line.is_valid:
                        out.write((between if part.lines else b"") + line.as_py().encode())
                        part.lines += 1
        return part

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, target = located(self.path)
        files.create_dir(self.folder, recursive=True)
        try:
            if self.begins is not None:
                refuse_broken(self.path, self.begins, self.ends)
            whole = f"{self.folder}/whole"
            parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)
            with files.open_output_stream(whole) as out:
                out.write(self.head.encode())
                for i, part in enumerate(parts):
                    out.write(self.between.encode() if i else b"")
                    with files.open_input_stream(part.name) as stream:
                        while block := stream.read(BLOCK):
                            out.write(block)
                out.write(self.foot.encode())
            files.move(whole, target)
        finally:
            files.delete_dir(self.folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = located(self.path)
        if files.get_file_info(self.folder).type == pafs.FileType.Directory:
            files.delete_dir(self.folder)


class OneFile(DataSource):
    """Lines (the only column, text) into one file. Options: path; head, foot and between (texts around and between lines, a line end by default); begins and ends, how a former file of the kind must look."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        if not overwrite:
            raise ValueError("one file is replaced as a whole: write with mode overwrite")
        if [f.dataType.typeName() for f in schema.fields] != ["string"]:
            raise ValueError("lines are one column of texts")
        return OneFileWriter(self.options)


def write_lines(lines: DataFrame, path: str, **options: str) -> None:
    """Write a frame of lines, in its order, over the file at path."""
    lines.sparkSession.dataSource.register(OneFile)
    lines.write.format("onefile").mode("overwrite").options(path=path, **options).save()


def csv_line(*cells: Column) -> Column:
    """Cells as a line of CSV: no formula, quotes where a cell holds a comma, a quote or a line end; null is empty."""

    def quoted(cell: Column) -> Column:
        safe = X.csv_cell(F.coalesce(cell.cast("string"), F.lit("")))
        return F.when(safe.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return F.concat_ws(",", *map(quoted, cells))


def write_csv(events: DataFrame, order: list[Column], path: str) -> None:
    """The CSV export of events: a byte order mark, the 19 columns of `CSV_COLUMNS`, lines in order with carriage returns."""
    head = BOM + ",".join(CSV_COLUMNS) + "\r\n"
    lines = events.orderBy(*order).select(F.concat(csv_line(*[F.col(c) for c in CSV_COLUMNS.values()]), F.lit("\r\n")).alias("line"))
    write_lines(lines, path, head=head, between="", begins=head, ends="\r\n")


def write_json(rows: DataFrame, order: list[Column], path: str, name: str = "items", first: dict | None = None) -> None:
    """One JSON document: the few values of `first` as they stand, then the rows in order as the array `name`, indented by two."""
    told = "".join(f"  {json.dumps(k, ensure_ascii=False)}: " + json.dumps(v, ensure_ascii=False, indent=2).replace("\n", "\n  ") + ",\n" for k, v in (first or {}).items())
    lines = rows.orderBy(*order).select(F.concat(F.lit("\n    "), indented_json(F.struct("*"), rows.schema, depth=2)).alias("line"))
    # the array's end depends on whether it holds rows, which the lines tell: a document without rows has its own foot
    empty = rows.isEmpty()
    head, foot = "{\n" + told + f"  {json.dumps(name, ensure_ascii=False)}: [", ("]" if empty else "\n  ]") + "\n}\n"
    write_lines(lines, path, head=head, foot=foot, between=",", begins="{\n", ends="\n}\n")


def quality_lines(report: DataFrame) -> DataFrame:
    """place and line of the quality report in Markdown: report(place, name, status, deadline_known, denominator, deadline_time_known, deadline_coverage), one row a source."""
    name = F.replace(F.replace("name", F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" "))
    share = F.when(F.col("deadline_coverage").isNull(), "해당 없음").otherwise(F.concat(F.format_string("%.1f", F.col("deadline_coverage").cast("double")), F.lit("%")))
    cells = [name, F.col("status"), F.concat_ws(" / ", "deadline_known", "denominator"), F.col("deadline_time_known").cast("string"), share]
    return report.select("place", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_quality(report: DataFrame, path: str, basis: str) -> None:
    """The quality report in Markdown, sources in order of place."""
    head = f"## 날짜 확인 진단\n{basis}\n\n| 출처 | 목록 상태 | 마감 확인 / 대상 | 시각 확인 | 확인율 |\n|---|---|---|---|---|\n"
    foot = "\n접근 실패·동적 화면 미확인·기간 충돌·요청 예산 대기는 site/quality.json에서 구분합니다.\n실행한 범위의 진단이며 모든 공고의 완전성을 보증하지 않습니다.\n"
    lines = quality_lines(report).orderBy("place").select(F.concat("line", F.lit("\n")).alias("line"))
    write_lines(lines, path, head=head, foot=foot, between="", begins="## ", ends="\n")


def markdown_text(text: Column) -> Column:
    """A text that cannot leave its cell of a Markdown table, nor be read as a tag or a link."""
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("|", "\\|"), ("\n", " "), ("[", "\\["), ("]", "\\]"), ("`", "\\`")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def replace_region(lines: DataFrame, path: str, start: str, end: str) -> bool:
    """Put lines, in their order, between two marks of the file at path, and say whether it was done; a file without both marks, or none at all, stays as it is.

    The first region counts. The text around the marks goes through the driver; the lines, which may be many, do not.
    """
    files, name = located(path)
    if files.get_file_info(name).type != pafs.FileType.File:
        return False
    with files.open_input_stream(name) as stream:
        page = stream.read().decode()
    before, opened, rest = page.partition(start)
    _, closed, after = rest.partition(end)
    if not opened or not closed:
        return False
    write_lines(lines, path, head=before + start + "\n", foot="\n" + end + after, begins=before + start)
    return True
